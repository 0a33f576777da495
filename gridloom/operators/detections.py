"""Boxes of one image: suppression, post-processing, tiling, spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..store import written
from .percentiles import exact_percentiles

_xy = lambda x: (x["x0"], x["y0"], x["x1"], x["y1"])


def pair_iou(boxes: DataFrame) -> DataFrame:
    """JN5: IoU of overlapping boxes of an image, i before j. Boxes meet through grid cells, so that far ones never pair;
    a pair is emitted in the one cell that holds the corner of its intersection."""
    cell = 128
    cut = lambda c: F.floor(F.col(c) / cell)
    cells = boxes.withColumn(
        "cx",
        F.explode(F.sequence(cut("x0"), cut("x1"))),
    ).withColumn("cy", F.explode(F.sequence(cut("y0"), cut("y1"))))
    other = cells.select("image", "cx", "cy", *[F.col(c).alias(f"{c}_b") for c in ("ord", "x0", "y0", "x1", "y1")])
    j = cells.join(other, ["image", "cx", "cy"]).where("ord < ord_b")
    j = j.where((F.floor(F.greatest("x0", "x0_b") / cell) == F.col("cx")) & (F.floor(F.greatest("y0", "y0_b") / cell) == F.col("cy")))
    score = B.iou(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"{c}_b") for c in ("x0", "y0", "x1", "y1")))
    return j.select("image", F.col("ord").alias("i"), F.col("ord_b").alias("j"), score.alias("iou")).where("iou > 0")


#: An image of more boxes isn't gathered in one row.
MAX_BOXES = 2_000
BOX = ["image", "ord", "x0", "y0", "x1", "y1", "score"]


def suppress(boxes: DataFrame, threshold: float = 0.70, max_boxes: int = MAX_BOXES) -> DataFrame:
    """JN6: greedy suppression by score, ties by ord. An image's boxes are folded in order, a box joining those kept
    unless it overlaps one; images of more than max_boxes go through _suppress_in_rounds, with the same result."""
    rows = boxes.select(*BOX)
    many = rows.groupBy("image").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_boxes).select("image")
    if not many.limit(1).count():
        return _suppress_in_place(rows, threshold)
    many = written(many, "many")
    return _suppress_in_place(
        rows.join(many, "image", "left_anti"),
        threshold,
    ).union(_suppress_in_rounds(rows.join(many, "image", "left_semi"), threshold))


def _suppress_in_place(boxes: DataFrame, threshold: float) -> DataFrame:
    item = F.struct((-F.col("score")).alias("k"), "ord", "x0", "y0", "x1", "y1", "score")
    sorted_ = boxes.groupBy("image").agg(F.sort_array(F.collect_list(item)).alias("all"))
    kept = F.aggregate(
        "all",
        F.filter("all", lambda x: F.lit(False)),
        lambda acc, b: F.when(F.exists(acc, lambda k: B.iou(_xy(b), _xy(k)) >= threshold), acc).otherwise(F.concat(acc, F.array(b))),
    )
    return sorted_.select("image", F.explode(kept).alias("b")).select("image", "b.ord", "b.x0", "b.y0", "b.x1", "b.y1", "b.score")


def _suppress_in_rounds(boxes: DataFrame, threshold: float) -> DataFrame:
    """Of the boxes left, those that overlap no better one stay, and what overlaps them goes; and so on. Only overlapping
    pairs are looked at; a round is a written table, and their number is that of the longest chain of ever better boxes."""
    boxes = written(boxes.select(*BOX), "boxes")
    rank = boxes.select("image", "ord", F.struct(-F.col("score"), F.col("ord")).alias("r"))
    pairs = pair_iou(boxes).where(F.col("iou") >= threshold).select("image", "i", "j")
    pairs = pairs.join(rank.toDF("image", "i", "ri"), ["image", "i"]).join(rank.toDF("image", "j", "rj"), ["image", "j"])
    better = written(
        pairs.select(
            "image",
            F.when(F.col("ri") < F.col("rj"), F.col("i")).otherwise(F.col("j")).alias("up"),
            F.when(F.col("ri") < F.col("rj"), F.col("j")).otherwise(F.col("i")).alias("ord"),
        ),
        "better",
    )
    left, kept = boxes.select("image", "ord"), boxes.select("image", "ord").limit(0)
    while True:
        open_ = better.join(left, ["image", "ord"], "left_semi").join(left.withColumnRenamed("ord", "up"), ["image", "up"], "left_semi")
        top = written(left.join(open_, ["image", "ord"], "left_anti"), "top")
        kept = written(kept.union(top), "kept")
        gone = better.join(top.withColumnRenamed("ord", "up"), ["image", "up"], "left_semi").select("image", "ord")
        left = written(left.join(top.union(gone), ["image", "ord"], "left_anti"), "left")
        if not left.limit(1).count():
            return boxes.join(kept, ["image", "ord"], "left_semi").select(*BOX)


def processed(boxes: DataFrame, w: float = 512.0, h: float = 512.0, least: float = 16.0) -> DataFrame:
    """CMP8: clamp, drop small and unsound boxes, mark degenerate ones, suppress."""
    names = ("x0", "y0", "x1", "y1")
    raw = tuple(F.col(c) for c in names)
    # Generated, so that the filter reads columns: the optimizer would put a projection's expressions for each of their
    # many uses, which took six times as long.
    both = F.struct(*[v.alias(n) for v, n in zip(B.clamped(*raw, F.lit(w), F.lit(h)), names)], *[v.alias(f"{n}_raw") for v, n in zip(raw, names)])
    t = boxes.select("image", "ord", "score", F.inline(F.array(both)))
    t = t.where(B.area(*raw) >= least).where(B.degeneracy(*[F.col(f"{n}_raw") for n in names], w, h).isNull())
    return suppress(t)


def grounding_metrics(best: DataFrame) -> DataFrame:
    """AGG15 over image, iou (null: no prediction), degenerate: mean and exact median over predictions, shares over all."""
    best = written(best, "best")
    median = exact_percentiles(best.withColumn("all", F.lit(0)), ["all"], "iou", [0.5]).agg(F.round(F.max(F.get("q", F.lit(0))), 4).alias("median_iou"))
    out = best.agg(
        F.round(F.avg("iou"), 4).alias("mean_iou"),
        F.round(F.avg((F.coalesce("iou", F.lit(0.0)) >= 0.5).cast("double")) * 100.0, 2).alias("success_pct"),
        F.round(F.avg(F.col("iou").isNull().cast("double")) * 100.0, 2).alias("empty_pct"),
        F.round(F.avg(F.col("degenerate").cast("double")) * 100.0, 2).alias("degenerate_pct"),
    )
    # Two tables of one row.
    out = out.join(F.broadcast(median), F.lit(True))
    return out.select("mean_iou", "median_iou", "success_pct", "empty_pct", "degenerate_pct")
