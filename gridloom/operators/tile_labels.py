"""Four-connected components of masks in tiles: a disjoint-set forest inside each tile, then one over the tiles' borders,
block by block of 2, 4, 8, ... tiles a side, so that the rounds are the logarithm of a scene's tiles a side, whatever
shapes are in it, and a group holds what crosses the middle of its block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written
from . import tiles as T
from .ranks import ranked


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' sets after the unions of a and b."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    out = np.array(parent, np.int64)
    while True:
        up = out[out]
        if (up == out).all():
            return out
        out = up


def label(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 in raster order of the components' first pixels, 0 outside the mask. Runs of a line are the forest's nodes."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1]
    n = len(y)
    # The runs of the line above that a run touches stand side by side.
    key0, key1 = (y - 1) * (w + 1) + x0, (y - 1) * (w + 1) + x1
    first = np.searchsorted(y * (w + 1) + x1, key0, "right")
    last = np.searchsorted(y * (w + 1) + x0, key1, "left")
    many = np.maximum(last - first, 0)
    a = np.repeat(np.arange(n), many)
    b = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    _, number = np.unique(roots(n, a, b), return_inverse=True)
    out = np.zeros(h * (w + 1), np.int64)
    np.add.at(out, y * (w + 1) + x0, number + 1)
    np.add.at(out, y * (w + 1) + x1, -(number + 1))
    return np.cumsum(out).reshape(h, w + 1)[:, :w]


def _labelled(a: np.ndarray, p: T.Place) -> np.ndarray:
    return label(a[0] != 0)


def _firsts(a: np.ndarray, p: T.Place) -> np.ndarray:
    """The place in the scene, y * width + x, of each label's first pixel."""
    flat = a[0].ravel()
    found, at = np.unique(flat, return_index=True)
    at = at[found > 0]
    return (at // p.w + p.y0) * p.width + at % p.w + p.x0


_BORDER = "array<struct<across: boolean, y: int, x: int, after: boolean, ids: array<bigint>>>"


def _borders(labels: DataFrame) -> DataFrame:
    """scene, level, by, bx, a, b: components that touch over a border of two tiles. Only the tiles' outer lines are shuffled.
    level, by, bx name the least block of 2^level tiles a side that holds both."""

    @F.arrow_udf(_BORDER)
    def run(*columns: pa.Array) -> pa.Array:
        rows, out = T._Rows(columns), []
        for (ty, tx, *_), (p, _, a) in zip(rows.meta, rows):
            ids = np.concatenate([[-1], _firsts(a, p)])[a[0]]
            part = []
            if ty:
                part.append((False, ty - 1, tx, True, ids[0]))
            if p.y0 + p.h < p.height:
                part.append((False, ty, tx, False, ids[-1]))
            if tx:
                part.append((True, ty, tx - 1, True, ids[:, 0]))
            if p.x0 + p.w < p.width:
                part.append((True, ty, tx, False, ids[:, -1]))
            out.append([dict(zip(("across", "y", "x", "after", "ids"), (*r[:4], r[4].tolist()))) for r in part])
        names = [("across", pa.bool_()), ("y", pa.int32()), ("x", pa.int32()), ("after", pa.bool_()), ("ids", pa.list_(pa.int64()))]
        return pa.array(out, pa.list_(pa.struct(names)))

    each = labels.select("scene", F.explode(run(*T._OWN)).alias("s")).select("scene", "s.*")
    met = each.groupBy("scene", "across", "y", "x").agg(*[F.max(F.when(F.col("after") == after, F.col("ids"))).alias(n) for n, after in (("a", False), ("b", True))])
    pairs = met.select("scene", "across", "y", "x", F.explode(F.arrays_zip("a", "b")).alias("p")).select("scene", "across", "y", "x", "p.a", "p.b")
    pairs = pairs.where("a >= 0 and b >= 0").distinct()
    # Two neighbours meet in the block at whose level their numbers' highest differing bit is gone.
    side = F.when(F.col("across"), F.col("x")).otherwise(F.col("y"))
    level = F.length(F.bin(side.bitwiseXOR(side + 1).cast("long")))
    pairs = pairs.withColumn("level", level)
    return pairs.select("scene", "level", *[F.expr(f"shiftright({c}, level)").alias(f"b{c}") for c in "yx"], "a", "b")


def _joined(key: tuple, group: pa.Table) -> pa.Table:
    a, b = group["a"].to_numpy(), group["b"].to_numpy()
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    to = ids[roots(len(ids), at[: len(a)], at[len(a) :])]
    moved = to != ids
    return pa.table({"scene": pa.array(np.full(int(moved.sum()), key[0].as_py(), np.int64)), "was": pa.array(ids[moved]), "root": pa.array(to[moved])})


def border_roots(labels: DataFrame) -> tuple[DataFrame, int]:
    """(scene, comp, root) of the components that are joined to one that begins before them over tiles' borders, both being
    first pixels' places, and the rounds that it took. labels is a written table of label tiles."""
    edges = written(_borders(labels), "borders")
    levels = edges.agg(F.max("level").alias("m")).first()["m"] or 0
    known = None
    for level in range(1, levels + 1):
        now = edges.where(F.col("level") == level).groupBy("scene", "by", "bx").applyInArrow(_joined, "scene long, was long, root long")
        now = written(now, "roots")
        if known is None:
            known = now.withColumnRenamed("was", "comp")
        else:
            up = known.join(now.select("scene", F.col("was").alias("root"), F.col("root").alias("to")), ["scene", "root"], "left")
            known = written(up.select("scene", "comp", F.coalesce("to", "root").alias("root")).union(now.select("scene", F.col("was").alias("comp"), "root")), "known")
        if level < levels:
            edges = edges.where(F.col("level") > level)
            for c in "ab":
                to = now.select("scene", F.col("was").alias(c), "root")
                edges = edges.join(to, ["scene", c], "left").withColumn(c, F.coalesce("root", c)).drop("root")
            edges = written(edges.where("a <> b").select("scene", "level", "by", "bx", "a", "b").distinct(), "borders")
    if known is None:
        known = edges.select("scene", F.col("a").alias("comp"), F.col("b").alias("root"))
    return known, levels


def components(masks: DataFrame) -> DataFrame:
    """WIN4, on tiles: label tiles of four-connected components of 0/1 tiles, numbered from 1 in raster order of their first
    pixel. What is shuffled are tiles' outer lines, components' first pixels, and the tiles once, to meet their numbers."""
    labels = written(T.mapped(masks, _labelled, kind="<i4"), "tile_labels")
    known, _ = border_roots(labels)

    @F.arrow_udf("array<bigint>")
    def firsts(*columns: pa.Array) -> pa.Array:
        return pa.array([_firsts(a, p) for p, _, a in T._Rows(columns)], pa.list_(pa.int64()))

    comps = labels.select(*T.KEYS, F.posexplode(firsts(*T._OWN)).alias("k", "comp"))
    comps = comps.join(known, ["scene", "comp"], "left").select(*T.KEYS, "k", F.coalesce("root", "comp").alias("root"))
    comps = written(comps, "components")
    # Numbers over all scenes, less those of the scenes before; as many rows as components.
    numbers = written(ranked(written(comps.select("scene", "root").distinct(), "roots"), F.col("scene"), F.col("root")), "numbers")
    begin = numbers.groupBy("scene").agg((F.min("rank") - 1).alias("begin"))
    numbers = numbers.join(begin, "scene").select("scene", "root", (F.col("rank") - F.col("begin")).alias("number"))
    of_tile = comps.join(numbers, ["scene", "root"]).groupBy(*T.KEYS).agg(F.sort_array(F.collect_list(F.struct("k", "number"))).alias("numbers"))

    def kernel(a: np.ndarray, p: T.Place, numbers: list | None) -> np.ndarray:
        return np.array([0, *(x["number"] for x in numbers or ())], np.int64)[a[0]]

    return T.mapped(labels.join(of_tile.hint("shuffle_hash"), list(T.KEYS), "left"), kernel, kind="<i8", params=("numbers",))


def label_pixels(labels: DataFrame) -> DataFrame:
    """scene, y, x, label of the labelled pixels."""
    return T.to_pixels(labels, ["label"], only="label").withColumn("label", F.col("label").cast("long"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["scene", "label", "x0", "y0", "x1", "y1", "pixels"]
    for b in batches:
        rows = T._Rows(tuple(b.column(c) for c in T._OWN))
        for scene, (p, _, a) in zip(b.column("scene").to_pylist(), rows):
            y, x = np.nonzero(a[0])
            label_, at, n = np.unique(a[0][y, x], return_inverse=True, return_counts=True)
            ends = []
            for v, start, ufunc in ((x, p.w, np.minimum), (y, p.h, np.minimum), (x, -1, np.maximum), (y, -1, np.maximum)):
                e = np.full(len(label_), start)
                ufunc.at(e, at, v)
                ends.append(e)
            cols = [np.full(len(label_), scene), label_, ends[0] + p.x0, ends[1] + p.y0, ends[2] + p.x0 + 1, ends[3] + p.y0 + 1, n]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)


def boxes(labels: DataFrame) -> DataFrame:
    """AGG3's boxes: scene, label, x0, y0, x1, y1 (half-open), pixels of label tiles; a tile gives a row a label that it holds."""
    part = labels.select("scene", *T._OWN).mapInArrow(_sizes, "scene long, label long, x0 long, y0 long, x1 long, y1 long, pixels long")
    ends = [F.min(c).alias(c) for c in ("x0", "y0")] + [F.max(c).alias(c) for c in ("x1", "y1")]
    return part.groupBy("scene", "label").agg(*ends, F.sum("pixels").alias("pixels"))
