"""Land cover of optical and SAR pairs: classes, regions by class, the report on what each sensor adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..functions import text as T
from . import change as CH

UNKNOWN = "unknown"


def classes(img: DataFrame, height: int, width: int) -> DataFrame:
    """CMP4 over scene, y, x, r, g, b, sar in 0..1: img with rough, class and prob."""
    rough = CH.roughness(img, height, width).withColumn("rough", F.round("rough", 6))
    t = img.join(rough.hint("merge"), ["scene", "y", "x"])
    i = P.indices(F.col("r"), F.col("g"), F.col("b"))
    label, prob = P.classify(
        F.col("r"),
        F.col("g"),
        F.col("b"),
        i["exg"],
        i["lightness"],
        i["blue_ratio"],
        i["red_ratio"],
        F.col("sar"),
        F.col("rough"),
    )
    return t.withColumn("class", label).withColumn("prob", prob)


def class_regions(k: DataFrame, height: int, width: int, *, least: int = 16, most: int = 20, digits: int = 4) -> DataFrame:
    """AGG4: scene, class, label, half-open bounding box, pixels, coverage_pct, confidence (mean probability over the
    region's own pixels) and means of r, g, b, sar, rough. Of a class's first `most` components those with `least` pixels;
    a class of fewer pixels has none. All classes are labelled at once, the class being part of the key."""
    known = k.where(F.col("class") != UNKNOWN)
    enough = known.groupBy("scene", "class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("scene", "class")
    key = known.join(enough.hint("merge"), ["scene", "class"], "left_semi").select(F.struct("scene", "class").alias("scene"), "y", "x")
    labelled = CH.components(key, width).select("scene.scene", "scene.class", "y", "x", "label").where(F.col("label") <= most)
    total = height * width
    mean = lambda c: F.round(F.avg(c), digits)
    r = labelled.join(k.drop("class").hint("merge"), ["scene", "y", "x"]).groupBy("scene", "class", "label").agg(
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max("x") + 1).alias("x1"),
        (F.max("y") + 1).alias("y1"),
        F.count(F.lit(1)).alias("pixels"),
        mean("prob").alias("confidence"),
        *[mean(c).alias(c) for c in ("r", "g", "b", "sar", "rough")],
    )
    return r.where(F.col("pixels") >= least).withColumn("coverage_pct", F.round(F.col("pixels") / total * 100.0, 3))


def histogram(k: DataFrame) -> DataFrame:
    """AGG2's counts as EVD5 takes them: scene, class, pixels, pct, prob."""
    n = k.groupBy("scene", "class").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg("prob"), 4).alias("prob"))
    return n.withColumn("pct", F.round(F.col("pixels") / F.sum("pixels").over(W.partitionBy("scene")) * 100.0, 2))


def confidence(k: DataFrame) -> DataFrame:
    """CMP5: scene, confidence."""
    return k.groupBy("scene").agg(F.round(F.least(F.greatest(F.avg("prob"), F.lit(0.60)), F.lit(0.95)), 4).alias("confidence"))


#: What each layer of the report is for.
LAYERS = [("Optical", "spectral"), ("SAR", "structural"), ("Fused", "cross_modal")]


def complementarity(k: DataFrame) -> DataFrame:
    """CMP6: scene, built, water, contrast (what the two sensors show together) and layers."""
    n = k.groupBy("scene").agg(
        F.count_if(F.col("class") == "built_structure").alias("built"),
        F.count_if(F.col("class") == "water_body").alias("water"),
    )
    layers = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("role")) for a, b in LAYERS])
    return n.select("scene", "built", "water", T.fusion_narrative(F.col("built"), F.col("water")).alias("contrast"), layers.alias("layers"))
