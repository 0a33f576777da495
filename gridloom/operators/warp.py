"""Pairs on one grid: the second image resampled to the first one's pixels, for grids of one map system (see tiles)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written
from . import tiles as T
from .tile_filters import with_scene

#: Columns of a pair's grids: the upper left corner, the pixels' size on the ground, and the number of pixels, of both.
GRIDS = ("left1", "top1", "px1", "py1", "width1", "height1", "left2", "top2", "px2", "py2", "width2", "height2")


def windows(grids: DataFrame) -> DataFrame:
    """scene, share1, share2 (of each image's ground that both cover), the window of the first image's pixels that both
    cover (off_y, off_x, new_height, new_width), and by, ay, bx, ax: line y of the window has its centre at line
    by + ay * (y + 0.5) of the second image, columns alike. One row a scene of which both images share some ground.

    The window begins with the pixel that holds the corner of the shared ground; its length is the nearest whole number."""
    right = lambda i: F.col(f"left{i}") + F.col(f"width{i}") * F.col(f"px{i}")
    low = lambda i: F.col(f"top{i}") - F.col(f"height{i}") * F.col(f"py{i}")
    g = grids.select(
        "scene", *GRIDS, F.greatest("left1", "left2").alias("x0"), F.least(right(1), right(2)).alias("x1"), F.greatest(low(1), low(2)).alias("y0"), F.least("top1", "top2").alias("y1")
    ).where("x0 < x1 and y0 < y1")
    area = lambda i: F.col(f"width{i}") * F.col(f"px{i}") * F.col(f"height{i}") * F.col(f"py{i}")
    both = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    g = g.withColumns(
        {
            "share1": F.round(both / area(1), 4),
            "share2": F.round(both / area(2), 4),
            "off_x": F.floor((F.col("x0") - F.col("left1")) / F.col("px1")).cast("int"),
            "off_y": F.floor((F.col("top1") - F.col("y1")) / F.col("py1")).cast("int"),
            "new_width": F.floor((F.col("x1") - F.col("x0")) / F.col("px1") + 0.5).cast("int"),
            "new_height": F.floor((F.col("y1") - F.col("y0")) / F.col("py1") + 0.5).cast("int"),
        }
    )
    g = g.withColumns(
        {
            "ax": F.col("px1") / F.col("px2"),
            "ay": F.col("py1") / F.col("py2"),
            "bx": (F.col("left1") + F.col("off_x") * F.col("px1") - F.col("left2")) / F.col("px2"),
            "by": (F.col("top2") - F.col("top1") + F.col("off_y") * F.col("py1")) / F.col("py2"),
        }
    )
    return g.where("new_width > 0 and new_height > 0").select("scene", "share1", "share2", "off_y", "off_x", "new_height", "new_width", "by", "ay", "bx", "ax")


def cropped(tiles: DataFrame, windows_: DataFrame, *, layers: int, kind: str = "<f8") -> DataFrame:
    """The windows (scene, off_y, off_x, new_height, new_width) of the tiles' first layers; windows_ is a written table."""
    at = with_scene(tiles, windows_.select("scene", "off_y", "off_x", "new_height", "new_width"))
    return T.regridded(
        at,
        lambda y, n, oy, ox: y + oy,
        lambda x, n, oy, ox: x + ox,
        lambda s, y, x, ys, xs, size, p, oy, ox: _filled(s, y + oy, x + ox, ys, xs)[:layers],
        params=("off_y", "off_x"),
        layers=layers,
        kind=kind,
    )


def _filled(samples: np.ndarray, y: np.ndarray, x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """samples of lines ys and columns xs at lines y and columns x; 0 where there are none."""
    out = np.zeros((len(samples), len(y), len(x)), samples.dtype)
    i, j = np.isin(y, ys), np.isin(x, xs)
    out[:, np.flatnonzero(i)[:, None], np.flatnonzero(j)] = samples[:, np.searchsorted(ys, y[i])[:, None], np.searchsorted(xs, x[j])]
    return out


def _neighbours(at: np.ndarray, b: float, a: float) -> tuple[np.ndarray, np.ndarray]:
    """Where target places lie among the source's, and the place before."""
    v = b + a * (at + 0.5)
    return v, np.floor(v - 0.5).astype(np.int64)


def _sums(samples: np.ndarray, at: np.ndarray, sources: np.ndarray, n: int, b: float, a: float) -> np.ndarray:
    """The two neighbours' weighted sum along the last axis; nothing for places outside."""
    v, i = _neighbours(at, b, a)
    f = v - 0.5 - i
    total = 0.0
    for k, w in ((i, 1.0 - f), (i + 1, f)):
        w = np.where((k >= 0) & (k < n) & (v >= 0) & (v < n), w, 0.0)
        total = total + samples[..., np.clip(np.searchsorted(sources, k), 0, max(len(sources) - 1, 0))] * w
    return total


def _between(samples: np.ndarray, at: np.ndarray, sources: np.ndarray, n: int, b: float, a: float) -> np.ndarray:
    """The two neighbours' weighted mean along the last axis; one that lies outside is left out."""
    v, i = _neighbours(at, b, a)
    f = v - 0.5 - i
    total, weight = 0.0, 0.0
    for k, w in ((i, 1.0 - f), (i + 1, f)):
        w = np.where((k >= 0) & (k < n), w, 0.0)
        total = total + samples[..., np.clip(np.searchsorted(sources, k), 0, max(len(sources) - 1, 0))] * w
        weight = weight + w
    inside = (v >= 0) & (v < n) & (weight > 0)
    return np.where(inside, total / np.where(inside, weight, 1.0), 0.0)


def warped(tiles: DataFrame, windows_: DataFrame, *, layers: int, kind: str = "<f8", seen: bool = False) -> DataFrame:
    """JN1, JN2: the tiles' first layers on the windows' grids (scene, new_height, new_width, by, ay, bx, ax): each pixel's
    centre is mapped back, and its four neighbours weigh by their nearness; those outside the image are left out, and a
    centre outside it gives 0. With seen, the layer after these has 1 for the pixels that are there, and the others are left
    out, too. Whole-number kinds round. windows_ is a written table. One shuffle, of the lines and
    columns that are needed."""

    def kernel(samples, lines, columns, ys, xs, size, p, by, ay, bx, ax) -> np.ndarray:
        if not len(ys) or not len(xs):
            return np.zeros((layers, p.h, p.w))
        if seen:
            # Values that aren't there are 0, and the last layer's sum is the others' weight.
            wide = _sums(samples[: layers + 1].astype(float), columns, xs, size[1], bx, ax)
            sums = np.moveaxis(_sums(np.moveaxis(wide, -2, -1), lines, ys, size[0], by, ay), -1, -2)
            out = np.where(sums[-1] > 0, sums[:-1] / np.where(sums[-1] > 0, sums[-1], 1.0), 0.0)
            return np.floor(out + 0.5) if np.dtype(kind).kind in "iu" else out
        wide = _between(samples[:layers].astype(float), columns, xs, size[1], bx, ax)
        out = np.moveaxis(_between(np.moveaxis(wide, -2, -1), lines, ys, size[0], by, ay), -1, -2)
        return np.floor(out + 0.5) if np.dtype(kind).kind in "iu" else out

    at = with_scene(tiles, windows_.select("scene", "new_height", "new_width", "by", "ay", "bx", "ax"))
    both = lambda i: np.concatenate([i, i + 1])
    return T.regridded(
        at,
        lambda y, n, by, ay, bx, ax: both(_neighbours(y, by, ay)[1]),
        lambda x, n, by, ay, bx, ax: both(_neighbours(x, bx, ax)[1]),
        kernel,
        params=("by", "ay", "bx", "ax"),
        layers=layers,
        kind=kind,
    )


def stacked(one: DataFrame, two: DataFrame) -> DataFrame:
    """Tiles of both tables' layers, one's first; grids and kinds are alike. Tables dealt by their key are not shuffled."""

    @F.arrow_udf("binary")
    def run(a, b):
        import pyarrow as pa

        return pa.array([x.as_py() + y.as_py() for x, y in zip(a, b)], pa.binary())

    met = one.join(two.select(*T.KEYS, F.col("data").alias("other"), F.col("layers").alias("more")), list(T.KEYS))
    return met.select(*T.KEYS, "height", "width", "side", (F.col("layers") + F.col("more")).alias("layers"), "kind", run("data", "other").alias("data"))


def aligned(one: DataFrame, two: DataFrame, grids: DataFrame, *, layers: int, kind: str = "<f8", seen: bool = False) -> tuple[DataFrame, DataFrame]:
    """JN1: tiles of the first image's window and of the second image on its grid, `layers` of each, and the windows.
    grids is a table of GRIDS, a row a scene; scenes without shared ground are in neither. With seen, both have a layer more,
    1 for the pixels that are there, and the first one's follows its layers."""
    w = written(windows(grids), "windows")
    return stacked(cropped(one, w, layers=layers + seen, kind=kind), warped(two, w, layers=layers, kind=kind, seen=seen)), w


def grade(score: Column) -> Column:
    return F.when(score >= 0.85, "excellent").when(score >= 0.70, "good").when(score >= 0.35, "moderate").otherwise("poor")
