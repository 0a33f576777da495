"""Token ids in Parquet: list columns, dictionary or delta encoded, that are read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .encode import ByteLevel, Encoder, each_text, encoder

TOKENS_TYPE = "doc_id long, text_hash long, n_tokens long, tokens array<int>"
#: Bytes of ids in an Arrow batch, and rows of one of the small columns.
BATCH_BYTES = 4 << 20


def _encoding(kind: type[Encoder], path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(kind, path)
        rows: list[tuple[object, object, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            keys, hashes, ids = zip(*rows)
            lengths = np.array([len(b) // 4 for b in ids], np.int64)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(lengths), lists],
                ["doc_id", "text_hash", "n_tokens", "tokens"],
            )

        for b in batches:
            keys, hashes = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
            for i, h, text in zip(keys, hashes, each_text(b.column("text"))):
                ids = enc.ids(text) + end
                rows.append((i, h, ids))
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return run


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 2,
    kind: type[Encoder] = ByteLevel,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text_hash, n_tokens, tokens: the ids of each whole text, then end_id, in ascending (doc_id, text_hash) order.

    Null text is empty and has end_id alone; a null id comes first; repeated rows are rows of their own; an empty
    table gives no rows; other columns are ignored. One shuffle, of the texts, by ranges of ids."""
    C.require(docs, id_col, text_col)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        C.texts(docs, text_col).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("text_hash"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("doc_id", "text_hash", "text").mapInArrow(_encoding(kind, tokenizer_path, end_id), TOKENS_TYPE)


def write_tokens(
    tokens: DataFrame,
    path: str,
    *,
    encoding: str = "dictionary",
    row_group_mb: int = 32,
    page_kb: int = 256,
    page_rows: int = 2_000,
) -> None:
    """Parquet files with row groups of row_group_mb and pages of page_kb or page_rows rows at most, each with its
    entry in the page index, so that a few documents, or their metadata alone, are read without the rest."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    tokens.write.options(
        **{
            "parquet.block.size": row_group_mb << 20,
            "parquet.page.size": page_kb << 10,
            "parquet.page.row.count.limit": page_rows,
            "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
            "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
            "compression": "zstd",
        }
    ).parquet(path)


def read_tokens(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] = ("doc_id", "text_hash", "n_tokens", "tokens"),
    first_id: int | None = None,
    last_id: int | None = None,
) -> DataFrame:
    """The asked columns of the documents from first_id to last_id; both go into the scan."""
    df = spark.read.schema(TOKENS_TYPE).parquet(path)
    if first_id is not None:
        df = df.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        df = df.where(F.col("doc_id") <= last_id)
    return df.select(*columns)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = lists.offsets.to_numpy()
        crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "text_hash", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens gives; start is the number of ids of all documents before
    it in the files. Rows with one id stand as they do there, by text_hash; rows that have that in common, too, are alike."""
    rows = tokens.select("doc_id", "text_hash", "tokens").mapInArrow(_crc, "doc_id long, text_hash long, n_tokens long, ids_crc32 long")
    at = C.with_prefix(
        C.written(rows, "digests"),
        "doc_id",
        ("text_hash",),
        "n_tokens",
        spread=F.format_string("%03d", F.shiftright("text_hash", 56) + 128),
    )
    return at.select("doc_id", "start", "n_tokens", "ids_crc32")
