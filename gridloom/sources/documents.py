"""Manifests, directory pairs, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "sample_id string, dataset string, split string, scene_category string, is_quantitative boolean, t1_path string, t2_path string, gt_mask_path string, total_pixels bigint, changed_pixels bigint"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: a JSON list of samples, or an object with `samples`; missing categories are urban, and a sample with a truth
    mask counts as quantitative."""
    lists = spark.read.schema(
        SAMPLE + f", samples array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in SAMPLE.split(', '))}>>"
    ).json(path, multiLine=True)
    names = [c.split()[0] for c in SAMPLE.split(", ")]
    one = lists.withColumn(
        "s",
        F.explode(F.when(F.col("samples").isNotNull(), F.col("samples")).otherwise(F.array(F.struct(*names)))),
    ).select("s.*")
    return one.withColumns(
        {
            "scene_category": F.coalesce("scene_category", F.lit("urban")),
            "is_quantitative": F.coalesce("is_quantitative", F.col("gt_mask_path").isNotNull()),
        }
    )


def pair_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: files t1.* and t2.* of a folder, or of the same name in folders A and B: sample, t1, t2. Contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    side = F.when(name.rlike(r"^t1\."), "t1").when(name.rlike(r"^t2\."), "t2").when(folder.rlike("/A$"), "t1").when(folder.rlike("/B$"), "t2")
    sample = F.when(name.rlike(r"^t[12]\."), folder).otherwise(F.concat(F.regexp_replace(folder, "/[AB]$", "/"), name))
    return f.select(
        sample.alias("sample"),
        side.alias("side"),
        "path",
    ).where("side is not null").groupBy("sample").pivot("side", ["t1", "t2"]).agg(F.min("path")).where("t1 is not null and t2 is not null")


def write_json(df: DataFrame, path: str) -> None:
    """SNK1."""
    df.write.json(path)


def markdown(report: DataFrame, *keep: str) -> DataFrame:
    """SNK2: report rows (title, answer, status, confidence, tier, findings array<string>) as Markdown text, beside the columns in keep."""
    lines = F.concat(
        F.array(
            F.concat(F.lit("# "), F.col("title")),
            F.lit(""),
            F.col("answer"),
            F.lit(""),
            F.concat(F.lit("Status: "), F.col("status")),
            F.concat(F.lit("Confidence: "), F.format_string("%.2f", F.col("confidence")), F.lit(" ("), F.col("tier"), F.lit(")")),
        ),
        F.transform("findings", lambda x: F.concat(F.lit("- "), x)),
    )
    return report.select(*keep, F.concat_ws("\n", lines).alias("value"))
