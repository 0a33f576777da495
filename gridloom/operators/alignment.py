"""Phase correlation of image pairs (numpy, one pair a task group), the pair normaliser, resizing and tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHIFT = "scene long, dy int, dx int, peak double, psr double, ncc double, consensus double, score double"


def phase_shift(a: np.ndarray, b: np.ndarray) -> dict:
    """WIN5: the whole-pixel shift of b against a, and how sure it is. A flat image scores 0.20."""
    if a.std() < 1e-9 or b.std() < 1e-9:
        return {"dy": 0, "dx": 0, "peak": 0.0, "psr": 0.0, "ncc": 0.0, "consensus": 0.0, "score": 0.20}
    fa, fb = np.fft.fft2(a - a.mean()), np.fft.fft2(b - b.mean())
    cross = fb * np.conj(fa)
    r = np.real(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))
    y, x = np.unravel_index(np.argmax(r), r.shape)
    peak = float(r[y, x])
    h, w = r.shape
    dy, dx = int(y - h if y > h // 2 else y), int(x - w if x > w // 2 else x)
    around = np.ones_like(r, bool)
    around[np.ix_([(y + k) % h for k in range(-3, 4)], [(x + k) % w for k in range(-3, 4)])] = False
    rest = r[around]
    psr = float((peak - rest.mean()) / max(rest.std(), 1e-9)) if rest.size else 0.0
    c = np.roll(b, (-dy, -dx), (0, 1))
    ncc = float(np.corrcoef(a.ravel(), c.ravel())[0, 1])
    consensus = float(np.mean(np.sign(a - a.mean()) == np.sign(c - c.mean())))
    score = 0.55 * min(1.0, max(peak / 0.65, psr / 60.0)) + 0.35 * consensus + 0.10 * max(0.0, ncc)
    if abs(dy) > 0.1 * h or abs(dx) > 0.1 * w:
        score *= 0.5
    return {
        "dy": dy,
        "dx": dx,
        "peak": peak,
        "psr": psr,
        "ncc": ncc,
        "consensus": consensus,
        "score": round(min(0.999, max(0.001, score)), 4),
    }


def correlate(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """scene, y, x, va, vb -> SHIFT. A scene is a tile of bounded size (height x width), so its group fits a task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((height, width)), np.zeros((height, width))
        a[p["y"], p["x"]], b[p["y"], p["x"]] = p["va"], p["vb"]
        return pd.DataFrame([{"scene": p["scene"].iloc[0], **phase_shift(a, b)}])[[c.split()[0] for c in SHIFT.split(", ")]]

    return pairs.groupBy("scene").applyInPandas(run, SHIFT)


def pair_score(shift: DataFrame, overlap: DataFrame) -> DataFrame:
    """WIN6: with overlap known, half of each; else the phase score. overlap: scene, share (null: no map grid)."""
    s = shift.join(overlap, "scene", "left")
    score = F.when(
        F.col("share").isNotNull(),
        F.greatest(F.lit(0.10), 0.5 * F.col("score") + 0.5 * F.col("share")),
    ).otherwise(F.col("score"))
    grade = F.when(score >= 0.85, "excellent").when(score >= 0.70, "good").when(score >= 0.35, "moderate").otherwise("poor")
    return s.select("scene", "dy", "dx", F.round(score, 4).alias("score"), grade.alias("grade"))


def _weights(n: int, m: int) -> Column:
    """For target places `i` of m over n source places: array of struct(s, k), the triangle's weights about the centre.
    Smaller targets widen the triangle, so that every source place counts."""
    scale = n / m
    wide = max(1.0, scale)
    centre = (F.col("i") + 0.5) * scale
    low, high = F.greatest(F.lit(0), F.floor(centre - wide + 0.5)), F.least(F.lit(n), F.floor(centre + wide + 0.5))
    k = lambda s: F.greatest(F.lit(0.0), 1.0 - F.abs((s + 0.5 - centre) / wide))
    return F.transform(F.sequence(low, high - 1), lambda s: F.struct(s.cast("int").alias("s"), k(s).alias("k")))


def resize_bilinear(img: DataFrame, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """MAP9: scene, y, x, v of images of one size at another, by a triangle over columns, then over lines, each rounded to
    whole numbers. Each target place takes few source places: two equi-joins with tables as long as an image's side."""
    spark = img.sparkSession
    rows = img.select("scene", "y", "x", "v")
    for axis, other, n, m in (("x", "y", size[1], target[1]), ("y", "x", size[0], target[0])):
        table = spark.range(m).select(F.col("id").cast("int").alias("i")).select("i", F.explode(_weights(n, m)).alias("w")).select(
            "i",
            F.col("w.s").alias(axis),
            F.col("w.k").alias("k"),
        )
        rows = rows.join(F.broadcast(table), axis).groupBy("scene", other, "i").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("v"))
        rows = rows.select("scene", other, F.col("i").alias(axis), F.floor(F.round("v", 9) + 0.5).alias("v"))
    return rows.select("scene", "y", "x", "v")


def tile_starts(length: int, tile: int) -> list[int]:
    """WIN7. Where tiles begin; the last one ends at the edge."""
    return [max(0, min(at + tile, length) - tile) for at in range(0, length, tile)]


def tiled(img: DataFrame, height: int, width: int, tile: int, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """WIN7: scene, y, x, v. The model gets each tile's pixels (scene, ty, tx and img's columns) and gives a value `v` for
    each; where tiles overlap, the values are averaged."""
    starts = lambda c, n: F.explode(F.filter(F.lit(tile_starts(n, tile)), lambda s: (F.col(c) >= s) & (F.col(c) < s + tile)))
    out = model(img.withColumn("ty", starts("y", height)).withColumn("tx", starts("x", width)))
    return out.groupBy("scene", "y", "x").agg(F.avg("v").alias("v"))


def training_tiles(
    img: DataFrame,
    height: int,
    width: int,
    tile: tuple[int, int],
    *,
    least_changed: int = 50,
    most_still: int = 40,
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """WIN8: scene, ty, tx, pixels, changed and the measures of the tiles that don't overlap and lie wholly in the image
    (scene, y, x, changed): all with least_changed changed pixels, and of the others each scene's first most_still in
    order of lines and columns."""
    whole = img.where((F.col("y") < height // tile[0] * tile[0]) & (F.col("x") < width // tile[1] * tile[1]))
    at = [F.floor(F.col(c) / n).alias(f"t{c}") for c, n in zip("yx", tile)]
    tiles = whole.groupBy("scene", *at).agg(F.count(F.lit(1)).alias("pixels"), F.count_if("changed").alias("changed"), *[m.alias(n) for n, m in (measures or {}).items()])
    still = F.col("changed") < least_changed
    first = W.partitionBy("scene", still).orderBy("ty", "tx")
    return tiles.withColumn("n", F.row_number().over(first)).where(~still | (F.col("n") <= most_still)).drop("n")
