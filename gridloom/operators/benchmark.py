"""Benchmark harnesses over pairs with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alignment as A
from . import change as CH
from . import scoring as S


def change_benchmark(mask: DataFrame, truth: DataFrame, samples: DataFrame) -> dict[str, DataFrame]:
    """BEN1: a detector's mask (scene, y, x) against truth (scene, y, x) over samples (scene, pixels, category, nuisance,
    quantitative): each sample's metrics and failure, their macro and micro means, and the failures' distribution.

    Masks are foreground only: what neither has is counted from the scene's pixels, so no background row is joined."""
    key = ["scene", "y", "x"]
    both = mask.select(*key, F.lit(1).alias("p")).join(truth.select(*key, F.lit(1).alias("t")), key, "full")
    n = both.groupBy("scene").agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    c = samples.join(n, "scene", "left").fillna(0, ["tp", "fp", "fn"]).withColumn(
        "tn",
        F.col("pixels") - F.col("tp") - F.col("fp") - F.col("fn"),
    )
    m = S.metrics_explicit(c)
    kind, severity = S.failure(F.col("category"), F.col("nuisance"), F.col("quantitative"), F.col("tp") + F.col("fp"))
    each = m.withColumn("failure", kind).withColumn("severity", severity)
    right = m.where("quantitative")
    return {"samples": each, "macro": S.macro(right), "micro": S.micro(right), "failures": S.failure_distribution(each, "failure", "ord")}


def format_audit(pairs: DataFrame, expected: DataFrame, height: int, width: int) -> DataFrame:
    """BEN2: scene, formats, change (what is expected), changed, ratio_pct, found, misaligned, correct, false_positive. A
    scene without an expectation passes if its shift is found."""
    zonal = CH.detect(pairs, height, width)["zonal"].select("scene", "changed", "ratio_pct")
    grey = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    numbered = expected.select("scene", F.xxhash64("scene").alias("id"))
    flat = pairs.join(F.broadcast(numbered), "scene").select(
        F.col("id").alias("scene"),
        "y",
        "x",
        grey(F.col("a")).alias("va"),
        grey(F.col("b")).alias("vb"),
    )
    shift = A.correlate(flat, height, width).select(
        F.col("scene").alias("id"),
        ((F.abs("dy") > 20) | (F.abs("dx") > 20)).alias("moved"),
        (F.col("score") < 0.60).alias("misaligned"),
    )
    t = expected.join(zonal, "scene").join(numbered, "scene").join(shift, "id")
    found = S.changed(F.col("changed"), F.col("ratio_pct"))
    return t.select(
        "scene",
        "formats",
        "change",
        "changed",
        "ratio_pct",
        found.alias("found"),
        "misaligned",
        F.when(F.col("change").isNull(), F.col("moved")).otherwise(found == F.col("change")).alias("correct"),
        F.coalesce(found & ~F.col("change"), F.lit(False)).alias("false_positive"),
    )
