"""The corpus pipeline: five stages from documents to packed sequences, each one operator of gridloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import written
from gridloom.llm.mixing import mix
from gridloom.llm.ngramjoin import one_of_each
from gridloom.llm.packing import pack_documents
from gridloom.llm.quality import with_quality
from gridloom.llm.secrets import without_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. One with null or empty text has too few words and goes; repeated rows are
    judged alike and stay or go together; ties at the threshold stay; a null id is no trusted one; an empty table, or
    one without trusted rows, leaves the base rules; columns of any name are carried along."""
    return with_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: that of the least id, a row without an id only where
    its group has no other, of repeated rows one. Documents without words, null or empty, link with nothing and all stay. An empty
    table stays empty; columns of any name are carried along."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their live-looking credentials masked; n_chars follows the text. Null text stays null, empty text empty;
    repeated rows are masked alike; a null owner is one owner; an empty table stays empty; columns of any name are carried along."""
    from pyspark.sql import functions as F

    out = without_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target wants, copies being equal rows. One without words, null or empty, is
    never taken; a null source is one source; rows of one id share one draw; an empty table stays empty; columns of any
    name are carried along."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the sequences. Null or empty text is one piece, the end id; repeated rows are pieces of
    their own, as the copies of the mixture are; an empty table gives no rows; other columns are ignored."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]

#: Hashes, network-free tokenizers and the packing search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table documents, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else written(out, name)
    return docs
