"""Evaluation corpora: hash deduplication, leakage control, caps, splits, unions, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hash_order
from ..store import written
from .passages import leaks
from .ranks import ranked


def first_of_each(df: DataFrame, key: str, order: str | Column, *more: str) -> DataFrame:
    """AGG22, JN10: the row of each key with the least order. min_by combines before the shuffle, so a key that most
    rows share costs a row a task. more: further columns of the key, null being a value."""
    return df.groupBy(key, *more).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def without(df: DataFrame, quarantined: DataFrame, key: str) -> DataFrame:
    """JN10, JN12, SET3: rows whose key isn't quarantined."""
    return df.join(quarantined.select(key).distinct(), key, "left_anti")


def capped(df: DataFrame, stratum: str, n: int, seed: str, key: str) -> DataFrame:
    """WIN10: up to n rows of each stratum, in the order of a seeded hash. Rows beyond n of a task's own share are
    dropped before the shuffle, as Spark limits ranks early."""
    w = W.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")


def two_caps(df: DataFrame, kind: str, per_kind: int, total: int, order: str) -> DataFrame:
    """WIN9: in order, up to per_kind of each kind, and the first `total` of these: a report of fixed size. Ranks are cut
    before the shuffle, and the limit takes its rows in order."""
    w = W.partitionBy(kind).orderBy(order)
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_kind).drop("n").orderBy(order).limit(total)


def split(df: DataFrame, n_val: int, seed: str, key: str) -> DataFrame:
    """WIN11: the n_val rows of the least hash are val, the others train. The cut is found by an ordered limit, so no
    global window holds all rows."""
    cut = df.select(hash_order(seed, F.col(key)).alias("h")).orderBy("h").limit(n_val).agg(F.max("h").alias("cut"))
    # The cut is one row; a constant key joins it to all.
    return df.join(F.broadcast(cut), F.lit(True)).withColumn(
        "split",
        F.when(hash_order(seed, F.col(key)) <= F.col("cut"), "val").otherwise("train"),
    ).drop("cut")


def repeated(df: DataFrame, times: int) -> DataFrame:
    """SET4."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def statistics(df: DataFrame, *dims: str) -> DataFrame:
    """AGG16, AGG18: counts by each dimension and in all, in one pass by grouping sets."""
    return df.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.count(F.lit(1)).alias("n"))


def split_scenes(samples: DataFrame, split: str, scene: str) -> DataFrame:
    """AGG18: split, scene, n, place: each split's distinct scenes in order, a row a scene, with how many samples it has and
    its place in the split's list from 1. No list stands in a row, and no split in a task."""
    each = written(samples.groupBy(F.col(split).alias("split"), F.col(scene).alias("scene")).agg(F.count(F.lit(1)).alias("n")), "scenes")
    rows = written(ranked(each, F.asc_nulls_first("split"), F.asc_nulls_first("scene")), "places")
    before = rows.groupBy(F.col("split").alias("of")).agg((F.min("rank") - 1).alias("before"))
    rows = rows.join(F.broadcast(before), F.col("split").eqNullSafe(F.col("of")))  # a row a split
    return rows.select("split", "scene", "n", (F.col("rank") - F.col("before")).alias("place"))


def build(samples: DataFrame, quarantined: DataFrame, frozen: DataFrame, *, per_stratum: int, n_val: int, seed: str) -> DataFrame:
    """BEN3: an evaluation corpus of samples (doc_id, stratum, text): the first of equal texts, without those quarantined
    (doc_id) and those that hold a frozen passage (item_id, passage), up to per_stratum of each stratum, n_val of them for validation:
    doc_id, stratum, sha, split. Texts go no further than their hash."""
    rows = samples.select("doc_id", "stratum", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    rows = first_of_each(rows, "sha", "doc_id")
    rows = without(without(rows, quarantined, "doc_id"), leaks(samples.select("doc_id", "text"), frozen), "doc_id")
    return split(
        capped(rows, "stratum", per_stratum, seed, "doc_id"),
        n_val,
        seed + "v",
        "doc_id",
    ).select("doc_id", "stratum", "sha", "split")


def inventory(samples: DataFrame) -> DataFrame:
    """BEN4: by dataset of samples (dataset, doc_id, text): rows, invalid (without text), bytes, duplicates (rows whose text another
    row has too, in any dataset)."""
    rows = samples.select(
        "dataset",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        (F.coalesce(F.trim("text"), F.lit("")) == "").alias("invalid"),
    )
    by = rows.groupBy("dataset", "sha").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes").alias("bytes"),
        F.count_if("invalid").alias("invalid"),
    )
    every = by.groupBy(F.col("sha").alias("of")).agg(F.sum("n").alias("copies"))
    by = by.join(every, F.col("sha") == F.col("of"), "left")  # rows without a text have no copies
    return by.groupBy("dataset").agg(
        F.sum("n").alias("rows"),
        F.sum("invalid").alias("invalid"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.when(F.col("copies") > 1, F.col("n")).otherwise(0)).alias("duplicates"),
    )


def manifest_subset(samples: DataFrame, *, category: str | None = None, quantitative: bool | None = None) -> DataFrame:
    """FLT15: samples of a category, and those with or without a truth mask."""
    out = samples
    if category is not None:
        out = out.where(F.lower("scene_category") == category.lower())
    return out if quantitative is None else out.where(F.col("is_quantitative") == quantitative)


def manifest_counts(samples: DataFrame) -> DataFrame:
    """FLT15: by category, how many samples there are and how many are quantitative."""
    return samples.groupBy("scene_category").agg(F.count_if("is_quantitative").alias("quantitative"), F.count(F.lit(1)).alias("n"))
