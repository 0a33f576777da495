"""Rasters in tiles: a row is a tile's array. Filters run vectorised inside a tile on its window, the tile and a margin of
its neighbours' edges, and one shuffle moves those edges alone; another grid of the same ground takes one shuffle of the
samples that it needs.

A tile table has KEYS (scene, ty, tx), META and `data`, the array (layers, lines, columns) in raster order. Tiles are side x
side pixels, those at the right and lower edge what is left. All tiles of a scene are there; a missing one counts as zeros."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("scene", "ty", "tx")
#: The scene's size, the tiles' side, and how a sample is written (a numpy type).
META = ("height", "width", "side", "layers", "kind")
TYPE = "scene long, ty int, tx int, height int, width int, side int, layers int, kind string, data binary"
SIDE = 256


class Place(NamedTuple):
    """A tile in its scene, and how many lines and columns of its window lie around it."""

    y0: int
    x0: int
    h: int
    w: int
    height: int
    width: int
    top: int = 0
    left: int = 0
    bottom: int = 0
    right: int = 0

    def inner(self, window: np.ndarray) -> np.ndarray:
        """The tile's part of an array of the window's size."""
        return window[..., self.top : self.top + self.h, self.left : self.left + self.w]


def _place(ty: int, tx: int, height: int, width: int, side: int, radius: int = 0) -> Place:
    y0, x0 = ty * side, tx * side
    h, w = min(side, height - y0), min(side, width - x0)
    return Place(y0, x0, h, w, height, width, min(radius, y0), min(radius, x0), min(radius, height - y0 - h), min(radius, width - x0 - w))


def _array(scalar: pa.BinaryScalar, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), kind).reshape(shape)


class _Rows:
    """The columns of a batch of tiles as places and arrays."""

    def __init__(self, columns: tuple[pa.Array, ...]):
        *meta, self.data = columns
        self.meta = list(zip(*(c.to_pylist() for c in meta)))

    def __iter__(self) -> Iterator[tuple[Place, str, np.ndarray]]:
        for (ty, tx, height, width, side, layers, kind), data in zip(self.meta, self.data):
            p = _place(ty, tx, height, width, side)
            yield p, kind, _array(data, kind, (layers, p.h, p.w))


_OWN = ("ty", "tx", *META, "data")


def partitioned(tiles: DataFrame) -> DataFrame:
    """tiles dealt by their key, so that the filters that follow shuffle nothing but edges."""
    return tiles.repartition(*KEYS)


def from_pixels(px: DataFrame, values: list[str], height: int, width: int, *, side: int = SIDE, kind: str = "<f8", scenes: DataFrame | None = None) -> DataFrame:
    """Tiles of pixel rows (scene, y, x, values): a layer a value. A pixel that isn't there is zero; a value of ones, as the
    last layer, tells these from others (`seen` of the filters). One shuffle, a tile a group. scenes: table of the scenes (one
    row each) all of whose tiles come, those without pixels too."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        scene, ty, tx = (k.as_py() for k in key)
        p = _place(ty, tx, height, width, side)
        out = np.zeros((len(values), p.h, p.w), kind)
        group = group.filter(pc.is_valid(group["y"]))
        y, x = group["y"].to_numpy() - p.y0, group["x"].to_numpy() - p.x0
        for k, v in enumerate(values):
            out[k, y, x] = group[v].to_numpy()
        row = {"scene": scene, "ty": ty, "tx": tx, "height": height, "width": width, "side": side, "layers": len(values), "kind": kind}
        return pa.Table.from_pylist([{**row, "data": out.tobytes()}], schema=_SCHEMA)

    rows = px.select("scene", F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx"), "y", "x", *values)
    if scenes is not None:
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // side)))
        none = scenes.select("scene", each(height).alias("ty")).select("scene", "ty", each(width).alias("tx"))
        rows = rows.unionByName(none, allowMissingColumns=True)
    return rows.groupBy(*KEYS).applyInArrow(run, TYPE)


_SCHEMA = pa.schema(
    [("scene", pa.int64()), *[(c, pa.int32()) for c in ("ty", "tx", "height", "width", "side", "layers")], ("kind", pa.string()), ("data", pa.binary())]
)


def to_pixels(tiles: DataFrame, names: list[str], *, only: str | None = None) -> DataFrame:
    """scene, y, x and a column of doubles a layer; of the pixels where `only` isn't zero, if that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _Rows(tuple(b.column(c) for c in _OWN))
            for scene, (p, _, a) in zip(b.column("scene").to_pylist(), rows):
                y, x = np.nonzero(a[names.index(only)]) if only else (i.ravel() for i in np.indices(a.shape[1:]))
                cols = [np.full(len(y), scene, np.int64), (y + p.y0).astype(np.int32), (x + p.x0).astype(np.int32), *(v[y, x].astype(float) for v in a)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["scene", "y", "x", *names])

    return tiles.select("scene", *_OWN).mapInArrow(run, "scene long, y int, x int, " + ", ".join(f"{n} double" for n in names))


def _out(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _typed(a: np.ndarray, layers: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(a.reshape(layers, *a.shape[-2:]), kind)


def _replaced(tiles: DataFrame, layers: int, kind: str, data: Column, *more: str) -> DataFrame:
    own = [F.lit(layers).alias("layers"), F.lit(kind).alias("kind"), data.alias("data")]
    return tiles.select(*KEYS, "height", "width", "side", *own, *more)


def mapped(tiles: DataFrame, kernel: Callable[..., np.ndarray], *, layers: int = 1, kind: str = "<f8", params: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """kernel(array, place, *params) of each tile alone: no shuffle. params: columns whose values the kernel gets."""

    @F.arrow_udf("binary")
    def run(*columns: pa.Array) -> pa.Array:
        rows = _Rows(columns[: len(_OWN)])
        given = zip(*(c.to_pylist() for c in columns[len(_OWN) :])) if params else ((),) * len(rows.meta)
        return _out([_typed(kernel(a, p, *more), layers, kind) for (p, _, a), more in zip(rows, given)])

    return _replaced(tiles, layers, kind, run(*_OWN, *params), *keep)


def measured(tiles: DataFrame, kernel: Callable[..., list[float]], *, params: tuple[str, ...] = ()) -> Column:
    """An array of numbers, kernel(array, place, *params), of each tile: what scenes are summed up from."""

    @F.arrow_udf("array<double>")
    def run(*columns: pa.Array) -> pa.Array:
        rows = _Rows(columns[: len(_OWN)])
        given = zip(*(c.to_pylist() for c in columns[len(_OWN) :])) if params else ((),) * len(rows.meta)
        return pa.array([[float(v) for v in kernel(a, p, *more)] for (p, _, a), more in zip(rows, given)], pa.list_(pa.float64()))

    return run(*_OWN, *params)


def _cut(n: int, radius: int, side: int) -> slice:
    """What a neighbour on that side takes of n lines."""
    return slice(0, radius) if side < 0 else slice(n - radius, n) if side > 0 else slice(0, n)


def _strips(tiles: DataFrame, radius: int) -> DataFrame:
    """KEYS and strips (dy, dx, bytes): what each tile gets of its up to eight neighbours' edges, dy and dx being where they lie."""

    # The receivers' whole key comes from here, so that nothing is pushed below the tiles' exchange, which both uses share.
    @F.arrow_udf("array<struct<scene: bigint, ty: int, tx: int, strip: struct<dy: int, dx: int, strip: binary>>>")
    def run(scene: pa.Array, *columns: pa.Array) -> pa.Array:
        rows, out = _Rows(columns), []
        for scene_, (ty, tx, *_), (p, _, a) in zip(scene.to_pylist(), rows.meta, rows):
            part = []
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    inside = (dy < 0 < p.y0 or dy == 0 or dy > 0 and p.y0 + p.h < p.height) and (dx < 0 < p.x0 or dx == 0 or dx > 0 and p.x0 + p.w < p.width)
                    if inside and (dy or dx):
                        strip = a[:, _cut(p.h, radius, dy), _cut(p.w, radius, dx)].tobytes()
                        part.append({"scene": scene_, "ty": ty + dy, "tx": tx + dx, "strip": {"dy": -dy, "dx": -dx, "strip": strip}})
            out.append(part)
        strip_type = pa.struct([("dy", pa.int32()), ("dx", pa.int32()), ("strip", pa.binary())])
        return pa.array(out, pa.list_(pa.struct([("scene", pa.int64()), ("ty", pa.int32()), ("tx", pa.int32()), ("strip", strip_type)])))

    each = tiles.select(F.explode(run("scene", *_OWN)).alias("s")).select("s.*")
    return each.groupBy(*KEYS).agg(F.collect_list("strip").alias("strips"))


def filtered(
    tiles: DataFrame, kernel: Callable[..., np.ndarray], radius: int, *, layers: int = 1, kind: str = "<f8", params: tuple[str, ...] = (), keep: tuple[str, ...] = ()
) -> DataFrame:
    """kernel(window, place, *params) of each tile, the window being the tile with up to `radius` pixels of its scene around
    it; the kernel gives an array of the tile's size, or of the window's, of which the tile's part is taken.

    tiles is dealt by its key (partitioned, or what filtered and regridded give). One shuffle, of the edges; radius is at
    most the tiles' side."""

    @F.arrow_udf("binary")
    def run(*columns: pa.Array) -> pa.Array:
        n = len(_OWN)
        rows, strips = _Rows(columns[:n]), columns[n]
        given = zip(*(c.to_pylist() for c in columns[n + 1 :])) if params else ((),) * len(rows.meta)
        out = []
        for (p, k, a), got, meta, more in zip(rows, strips, rows.meta, given):
            if radius > meta[4]:
                raise ValueError(f"a radius of {radius} is more than a tile of {meta[4]}")
            p = _place(*meta[:5], radius)
            window = np.zeros((len(a), p.top + p.h + p.bottom, p.left + p.w + p.right), k)
            p.inner(window)[:] = a
            ys, xs = (
                {-1: slice(0, before), 0: slice(before, before + size), 1: slice(before + size, before + size + after)}
                for before, size, after in ((p.top, p.h, p.bottom), (p.left, p.w, p.right))
            )
            for s in got.as_py() or ():
                part = window[:, ys[s["dy"]], xs[s["dx"]]]
                # A neighbour that is cut off by the scene's end gives what it has.
                lines = part.shape[1] if s["dy"] else p.h
                part[:] = np.frombuffer(s["strip"], k).reshape(len(a), lines, -1)
            value = kernel(window, p, *more)
            out.append(_typed(value if value.shape[-2:] == (p.h, p.w) else p.inner(value), layers, kind))
        return _out(out)

    strips = _strips(tiles, radius).hint("shuffle_hash")
    joined = tiles.join(strips, list(KEYS), "left")
    return _replaced(joined, layers, kind, run(*_OWN, "strips", *params), *keep)


# --- another grid of the same ground ---


class _Needs:
    """The source places that target places first to last - 1 need, ascending; remembered, as many tiles of a scene ask alike."""

    def __init__(self, of: Callable[..., np.ndarray]):
        self.of, self.known = of, {}

    def __call__(self, first: int, last: int, length: int, more: tuple) -> np.ndarray:
        key = (first, last, length, more)
        if key not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            at = np.unique(self.of(np.arange(first, last), length, *more))
            self.known[key] = at[(at >= 0) & (at < length)]
        return self.known[key]


def regridded(
    tiles: DataFrame,
    rows: Callable[..., np.ndarray],
    cols: Callable[..., np.ndarray],
    kernel: Callable[..., np.ndarray],
    *,
    size: tuple[str, str] = ("new_height", "new_width"),
    params: tuple[str, ...] = (),
    layers: int = 1,
    kind: str = "<f8",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Tiles of a grid of `size`, each from the source's lines rows(lines, height, *params) and columns cols(columns, width,
    *params) that its own lines and columns need: kernel(samples, lines, columns, source_rows, source_cols, (height, width),
    place, *params), height and width being the source's.

    samples is (layers, len(source_rows), len(source_cols)). size, params and keep are columns with one value a scene.
    One shuffle, of the samples that are needed; the result is dealt by its key. Tiles no source tile has a sample for
    come as well, from none."""
    n = len(_OWN)
    need_rows, need_cols = _Needs(rows), _Needs(cols)

    @F.arrow_udf("array<struct<ty: int, tx: int, y: int, x: int, h: int, w: int, crop: binary>>")
    def crops(*columns: pa.Array) -> pa.Array:
        own = _Rows(columns[:n])
        given = list(zip(*(c.to_pylist() for c in columns[n:])))
        out = []
        for (p, _, a), meta, (oh, ow, *more) in zip(own, own.meta, given):
            side, part = meta[4], []
            first = p.y0 == 0 and p.x0 == 0

            def spans(needed: _Needs, length: int, new: int, at: int, size: int) -> list[tuple[int, int, np.ndarray]]:
                found = []
                for t in range(-(-new // side)):
                    every = needed(t * side, min(new, (t + 1) * side), length, tuple(more))
                    i, j = np.searchsorted(every, (at, at + size))
                    found.append((t, int(i), every[i:j] - at))
                return found

            for ty, y, ys in spans(need_rows, p.height, oh, p.y0, p.h):
                for tx, x, xs in spans(need_cols, p.width, ow, p.x0, p.w):
                    if len(ys) and len(xs):
                        part.append({"ty": ty, "tx": tx, "y": y, "x": x, "h": len(ys), "w": len(xs), "crop": a[:, ys[:, None], xs].tobytes()})
                    elif first:
                        part.append({"ty": ty, "tx": tx, "y": 0, "x": 0, "h": 0, "w": 0, "crop": b""})
            out.append(part)
        ints = [(c, pa.int32()) for c in ("ty", "tx", "y", "x", "h", "w")]
        return pa.array(out, pa.list_(pa.struct([*ints, ("crop", pa.binary())])))

    @F.arrow_udf("binary")
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        *meta, found = columns
        for (ty, tx, height, width, side, n_layers, kind_in, oh, ow, *more), got in zip(zip(*(c.to_pylist() for c in meta)), found):
            p = _place(ty, tx, oh, ow, side)
            lines, columns_ = np.arange(p.y0, p.y0 + p.h), np.arange(p.x0, p.x0 + p.w)
            ys, xs = need_rows(p.y0, p.y0 + p.h, height, tuple(more)), need_cols(p.x0, p.x0 + p.w, width, tuple(more))
            samples = np.zeros((n_layers, len(ys), len(xs)), kind_in)
            for c in got.as_py():
                samples[:, c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]] = np.frombuffer(c["crop"], kind_in).reshape(n_layers, c["h"], c["w"])
            out.append(_typed(kernel(samples, lines, columns_, ys, xs, (height, width), p, *more), layers, kind))
        return _out(out)

    scene = list(dict.fromkeys([*META, *size, *params, *keep]))
    each = tiles.select("scene", *scene, F.explode(crops(*_OWN, *size, *params)).alias("c"))
    each = each.select("scene", "c.ty", "c.tx", *scene, F.struct("c.y", "c.x", "c.h", "c.w", "c.crop").alias("crop"))
    # One value a scene, so that any row's serves.
    met = each.groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in scene], F.collect_list("crop").alias("crops"))
    data = run("ty", "tx", *META, *size, *params, "crops")
    more = [c for c in (*size, *params, *keep) if c in keep]
    return met.select(
        *KEYS, F.col(size[0]).cast("int").alias("height"), F.col(size[1]).cast("int").alias("width"), "side", F.lit(layers).alias("layers"), F.lit(kind).alias("kind"), data.alias("data"), *more
    )
