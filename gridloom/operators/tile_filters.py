"""Neighbourhood filters, resizing and change detection on tables of tiles (see tiles).

With `seen`, a last layer has 1 where the scene has a pixel and 0 elsewhere; the result has such a layer, too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..store import written
from . import tiles as T
from .change import thresholds_of

#: Scenes whose numbers are broadcast to the tiles at most, some 50 bytes each; beyond, they meet by a shuffle.
MAX_SCENES = 200_000


def with_scene(tiles: DataFrame, per_scene: DataFrame) -> DataFrame:
    """tiles beside the columns of per_scene, a row a scene; per_scene is a written table."""
    few = per_scene.limit(MAX_SCENES + 1).count() <= MAX_SCENES
    return tiles.join(F.broadcast(per_scene) if few else per_scene, "scene")


# --- filters of a window ---


def _rough(window: np.ndarray, p: T.Place, radius: int, seen: bool) -> np.ndarray:
    """Border pixels count twice where the window is cut off by the scene's end."""
    pad = ((radius - p.top, radius - p.bottom), (radius - p.left, radius - p.right))
    v = np.pad(window[0].astype(float), pad, "symmetric")
    size = 2 * radius + 1

    def summed(a: np.ndarray) -> np.ndarray:
        a = sum(a[:, k : k + p.w] for k in range(size))
        return sum(a[k : k + p.h] for k in range(size))

    mean, square = summed(v) / size**2, summed(v * v) / size**2
    rough = np.sqrt(np.maximum(0.0, square - mean * mean))
    return np.stack([rough, summed(np.pad(window[1].astype(float), pad, "symmetric")) > 0]) if seen else rough


def roughness(tiles: DataFrame, *, radius: int = 2, seen: bool = False) -> DataFrame:
    """WIN1: the local standard deviation of the first layer in a square, mirrored at the scene's border. What isn't there
    counts as 0; with `seen`, a pixel is there if any of its square is, for which tiles without pixels have to be given."""
    return T.filtered(tiles, lambda window, p: _rough(window, p, radius, seen), radius, layers=1 + seen)


def _square(m: np.ndarray, grow: bool) -> np.ndarray:
    """Dilation or erosion of 0/1 by 3 x 3; what lies outside is 0. Columns first, then lines."""
    take = np.maximum if grow else np.minimum
    for axis in (0, 1):
        wide = np.pad(m, [(1, 1) if a == axis else (0, 0) for a in (0, 1)])
        n = m.shape[axis]
        cut = lambda k: wide[k : k + n] if axis == 0 else wide[:, k : k + n]  # noqa: B023, E731
        m = take(take(cut(0), cut(1)), cut(2))
    return m


def _cleaned(window: np.ndarray, p: T.Place) -> np.ndarray:
    m = window[0]
    for grow in (False, True, True, False):
        m = _square(m, grow)
    return m


def opened_closed(masks: DataFrame) -> DataFrame:
    """WIN2: 3 x 3 opening, then closing, of 0/1 masks. Four steps reach four pixels, so that one exchange serves all."""
    return T.filtered(masks, _cleaned, 4, kind="|u1")


def _opened_classes(window: np.ndarray, p: T.Place) -> np.ndarray:
    c = window[0]
    full = c != 0
    wide = np.pad(c, ((0, 1), (0, 1)))
    for dy, dx in ((0, 1), (1, 0), (1, 1)):
        full &= wide[dy : dy + c.shape[0], dx : dx + c.shape[1]] == c
    out = np.zeros_like(c)
    # A full square keeps its four pixels.
    for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
        y, x = np.nonzero(full)
        out[y + dy, x + dx] = c[y, x]
    return np.stack([out, *window[1:]])


def opened_classes(classes: DataFrame, *, seen: bool = False) -> DataFrame:
    """WIN3: opening of each class of numbers above 0 by a 2 x 2 square; what no square of its class covers becomes 0."""
    return T.filtered(classes, _opened_classes, 1, layers=1 + seen, kind="<i4")


# --- other sizes ---


def _triangle(at: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For target places `at` of m over n source places: sources (len(at), k) and weights; sources outside weigh nothing."""
    scale = n / m
    wide = max(1.0, scale)
    centre = (at + 0.5) * scale
    first = np.floor(centre - wide + 0.5).astype(np.int64)
    last = np.floor(centre + wide + 0.5).astype(np.int64)
    s = first[:, None] + np.arange(int((last - first).max(initial=0)))
    k = np.maximum(0.0, 1.0 - np.abs((s + 0.5 - centre[:, None]) / wide))
    return s, np.where((s >= 0) & (s < n) & (s < last[:, None]), k, 0.0)


def _weighed(samples: np.ndarray, at: np.ndarray, sources: np.ndarray, n: int, m: int, seen: bool = False) -> np.ndarray:
    """The weighted mean along the last axis, rounded to whole numbers; with seen, of what the last layer has 1 for."""
    s, k = _triangle(at, n, m)
    i = np.minimum(np.searchsorted(sources, np.clip(s, 0, n - 1)), len(sources) - 1)
    total = sum(samples[..., i[:, j]] * k[:, j] for j in range(k.shape[1]))
    if seen:
        # The values that aren't there are 0, and the last layer's sum is the others' weight.
        there = total[-1] > 0
        mean = np.floor(np.round(total[:-1] / np.where(there, total[-1], 1.0), 9) + 0.5)
        return np.concatenate([np.where(there, mean, 0.0), there[None]])
    return np.floor(np.round(total / k.sum(1), 9) + 0.5)


def resize_bilinear(tiles: DataFrame, target: tuple[int, int], *, layers: int = 1, kind: str = "<f8", seen: bool = False) -> DataFrame:
    """MAP9: scenes of one size, of so many layers, at another, by a triangle over columns, then over lines, each rounded to whole numbers. A
    smaller target widens the triangle, so a target tile then takes all samples of its ground."""
    sized = tiles.withColumns({"new_height": F.lit(target[0]), "new_width": F.lit(target[1])})

    def kernel(samples: np.ndarray, lines, columns, ys, xs, size: tuple[int, int], p: T.Place) -> np.ndarray:
        wide = _weighed(samples.astype(float), columns, xs, size[1], target[1], seen)
        return np.moveaxis(_weighed(np.moveaxis(wide, -2, -1), lines, ys, size[0], target[0], seen), -1, -2)

    need = [lambda at, n, m=m: _triangle(at, n, m)[0].ravel() for m in target]
    return T.regridded(sized, *need, kernel, layers=layers + seen, kind=kind)


# --- change ---


def distances(pairs: DataFrame) -> DataFrame:
    """MAP3 and the distance of CMP1: a layer of change vectors' lengths, of tiles whose layers are one time's bands, then
    the other's, and with an odd number of layers `seen`: what isn't there has the distance -1. pairs is a written table, as
    it is read for the scenes' maxima first."""
    def most(a: np.ndarray, p: T.Place) -> list[float]:
        n = len(a) // 2
        return [a[:n].max(), a[n : 2 * n].max()]

    most_ = pairs.select("scene", T.measured(pairs, most).alias("m")).groupBy("scene").agg(
        *[F.max(F.get("m", F.lit(i))).alias(n) for i, n in enumerate(("ma", "mb"))]
    )

    def kernel(a: np.ndarray, p: T.Place, ma: float, mb: float) -> np.ndarray:
        n = len(a) // 2
        step = a[n : 2 * n] / (mb if mb > 1.0 else 1.0) - a[:n] / (ma if ma > 1.0 else 1.0)
        d = np.sqrt((step * step).sum(0))
        return np.where(a[-1] > 0, d, -1.0) if len(a) % 2 else d

    return T.mapped(with_scene(pairs, written(most_, "maxima")), kernel, params=("ma", "mb"))


def cuts(distance: DataFrame, *, bins: int = 128, **options) -> DataFrame:
    """AGG6, AGG7: scene, top, total, mu, sigma, threshold of tiles of distances, a written table: two scans, in which a tile gives
    its maximum, then its histogram. top is the scene's greatest distance, by which differences are scaled to 0..1, total
    the number of pixels that are there."""
    top = distance.select("scene", T.measured(distance, lambda a, p: [a.max(), np.count_nonzero(~(a < 0))]).alias("m"))
    top = top.groupBy("scene").agg(F.greatest(F.max(F.get("m", F.lit(0))), F.lit(1e-6)).alias("top"), F.sum(F.get("m", F.lit(1))).cast("long").alias("total"))
    top = written(top, "tops")

    def histogram(a: np.ndarray, p: T.Place, top: float) -> list[float]:
        d = a[~(a < 0)] / top
        at = np.minimum((d * bins).astype(np.int64), bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, d, bins), np.bincount(at, d * d, bins)])

    scaled = with_scene(distance, top)
    each = scaled.select("scene", T.measured(scaled, histogram, params=("top",)).alias("h"))
    each = each.select("scene", F.explode(F.arrays_zip(*[F.slice("h", k * bins + 1, bins).alias(n) for k, n in enumerate(("n", "d1", "d2"))], F.sequence(F.lit(0), F.lit(bins - 1)).alias("bin"))).alias("h"))
    hist = each.where("h.n > 0").groupBy("scene", "h.bin").agg(F.sum("h.n").cast("long").alias("n"), F.sum("h.d1").alias("d1"), F.sum("h.d2").alias("d2"))
    return written(top.join(thresholds_of(hist, bins=bins, **options), "scene"), "cuts")


def masks(distance: DataFrame, cuts_: DataFrame) -> DataFrame:
    """MAP21: 0/1 tiles of the pixels whose difference reaches their scene's threshold."""
    kernel = lambda a, p, top, threshold: (a / top >= threshold).astype(np.uint8)
    return T.mapped(with_scene(distance, cuts_), kernel, kind="|u1", params=("top", "threshold"))


def zonal(mask: DataFrame, cuts_: DataFrame | None = None, *, a: float = 10.0, e: float = -10.0) -> DataFrame:
    """AGG1: scene, total, changed, ratio_pct, area_m2, area_ha, warning of 0/1 tiles; total from cuts, where it is given."""
    counts = mask.select("scene", T.measured(mask, lambda m, p: [m.size, np.count_nonzero(m)]).alias("n"))
    z = counts.groupBy("scene").agg(*[F.sum(F.get("n", F.lit(i))).cast("long").alias(n) for i, n in enumerate(("total", "changed"))])
    if cuts_ is not None:
        z = z.drop("total").join(cuts_.select("scene", "total"), "scene")
    pct = F.round(F.col("changed") / F.col("total") * 100.0, 4)
    m2, ha = B.metric_area(F.col("changed"), F.lit(a), F.lit(e))
    note = F.when(F.col("changed") == 0, "no_change").when(pct >= 98.0, "full_image").when(pct >= 50.0, "extreme")
    return z.select("scene", "total", "changed", pct.alias("ratio_pct"), m2.alias("area_m2"), ha.alias("area_ha"), note.alias("warning"))


def detect(pairs: DataFrame) -> dict[str, DataFrame]:
    """CMP1, CMP3 on tiles: distance, cuts, raw and cleaned mask, zonal statistics of all scenes. pairs is a written table;
    the cleaned mask moves 0/1 tiles once, to deal them by their key, and their edges once."""
    distance = written(distances(pairs), "distances")
    cuts_ = cuts(distance)
    raw = masks(distance, cuts_)
    mask = written(opened_closed(T.partitioned(raw)), "mask")
    return {"distance": distance, "cuts": cuts_, "raw": raw, "mask": mask, "zonal": zonal(mask, cuts_)}
