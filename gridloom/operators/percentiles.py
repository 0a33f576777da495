"""Exact percentiles by narrowing histograms: no key's values meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import written


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = 1024) -> DataFrame:
    """keys and q, the array of the percentiles at the shares, between the two nearest values by their distance.

    Each wanted rank has an interval that holds it. A round counts the interval's values in `bins` parts, and the part
    with the rank, from its least to its largest value, is the next interval; it ends where both are one. Counts
    combine before their shuffle, so a round moves `bins` rows a key, rank and task at most. Nulls don't count."""
    key = F.struct(*keys).alias("key")  # in one column, so that no name of theirs meets one used here
    rows = df.select(key, F.col(value).cast("double").alias("v")).where("v is not null")
    whole = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "extent")
    wanted = [
        F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), f(F.lit(p) * (F.col("n") - 1)).cast("long").alias("rank"))
        for i, p in enumerate(shares)
        for up, f in ((0, F.floor), (1, F.ceil))
    ]
    state = written(whole.select("key", "lo", "hi", F.explode(F.array(*wanted)).alias("w")).select("key", "w.*", "lo", "hi"), "ranks")
    target = ["key", "i", "up"]
    while state.where("lo < hi").limit(1).count():
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        inside = rows.join(state.where("lo < hi"), "key").where("v between lo and hi")
        counts = inside.groupBy(*target, "rank", part.alias("bin")).agg(
            F.count(F.lit(1)).alias("k"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        )
        before = F.coalesce(F.sum("k").over(W.partitionBy(*target).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("before", before).where("before <= rank and rank < before + k").select(
            *target,
            (F.col("rank") - F.col("before")).alias("rank"),
            "lo",
            "hi",
        )
        state = written(state.where("lo = hi").unionByName(found), "ranks")
    at = state.join(whole.select("key", "n"), "key").groupBy("key", "n").agg(
        *[
            F.max(F.when((F.col("i") == i) & (F.col("up") == up), F.col("lo"))).alias(f"v{i}{up}")
            for i in range(len(shares))
            for up in (0, 1)
        ]
    )
    share = [F.lit(p) * (F.col("n") - 1) for p in shares]
    return at.select(
        "key.*",
        F.array(*[F.col(f"v{i}0") + (F.col(f"v{i}1") - F.col(f"v{i}0")) * (s - F.floor(s)) for i, s in enumerate(share)]).alias("q"),
    )
