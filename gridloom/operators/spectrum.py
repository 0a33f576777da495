"""Phase correlation of scenes of any size: a Fourier transform along lines, a shuffle that turns bands of lines to bands of
columns, one along columns, and the inverse alike, so that no task holds a scene (see tiles)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written
from . import tiles as T
from .tile_filters import with_scene
from .warp import stacked

#: Bytes of a band of lines or columns that a task transforms at once.
BAND_BYTES = 32 << 20
#: Pixels around the peak that its surroundings leave out.
NEAR = 3

_ROWS = "scene long, height int, width int, band int, at long, lines int, data binary"


def _thick(length: int, layers: int) -> int:
    """Lines of that length in a band."""
    return max(1, BAND_BYTES // (16 * layers * length))


def _pieces(scene: int, height: int, width: int, a: np.ndarray, first: int, at: int, thick: int) -> Iterator[list]:
    """A block's (layers, lines, columns) parts by band of lines; its first line and column are given."""
    i = 0
    while i < a.shape[1]:
        band = (first + i) // thick
        n = min((band + 1) * thick - first, a.shape[1]) - i
        # Lines within the band stand before the columns' place in one number.
        yield [scene, height, width, band, (first + i - band * thick) << 40 | at, n, np.ascontiguousarray(a[:, i : i + n])]
        i += n


def _batch(rows: list[list]) -> pa.RecordBatch:
    ints = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    cols = list(zip(*rows))
    arrays = [pa.array(c, t) for c, t in zip(cols, ints)] + [pa.array([x.tobytes() for x in cols[6]], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["scene", "height", "width", "band", "at", "lines", "data"])


def _band(group: pa.Table, layers: int, length: int, kind: str) -> tuple[np.ndarray, int, int, int]:
    """(layers, lines, length) of a band's pieces, and the scene's size and the band's number."""
    height, width, band = (group[c][0].as_py() for c in ("height", "width", "band"))
    at, lines = group["at"].to_numpy(), group["lines"].to_numpy()
    out = np.zeros((layers, int(((at >> 40) + lines).max()), length), kind)
    for k, (i, n) in enumerate(zip(at.tolist(), lines.tolist())):
        part = np.frombuffer(group["data"][k].as_buffer(), kind).reshape(layers, n, -1)
        y, x = i >> 40, i & ((1 << 40) - 1)
        out[:, y : y + n, x : x + part.shape[2]] = part
    return out, height, width, band


def _bands_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = T._Rows(tuple(b.column(c) for c in T._OWN))
        for scene, (p, _, a) in zip(b.column("scene").to_pylist(), rows):
            yield _batch(list(_pieces(scene, p.height, p.width, a.astype(float), p.y0, p.x0, _thick(p.width, 2))))


def _along_lines(key: tuple, group: pa.Table) -> pa.Table:
    """A band of lines of both images, transformed, as pieces of bands of columns."""
    width = group["width"][0].as_py()
    a, height, width, band = _band(group, 2, width, "<f8")
    f = np.swapaxes(np.fft.fft(a, axis=2), 1, 2)
    return pa.Table.from_batches([_batch(list(_pieces(key[0].as_py(), height, width, f, 0, band * _thick(width, 2), _thick(height, 2))))])


def _across(key: tuple, group: pa.Table) -> pa.Table:
    """A band of columns: the transform's end, the phases' difference, and the inverse's begin, as pieces of bands of lines."""
    height = group["height"][0].as_py()
    f, height, width, band = _band(group, 2, height, "<c16")
    f = np.fft.fft(f, axis=2)
    if band == 0:
        f[:, 0, 0] = 0  # the means
    cross = f[1] * np.conj(f[0])
    r = np.fft.ifft(cross / np.maximum(np.abs(cross), 1e-12), axis=1)
    return pa.Table.from_batches([_batch(list(_pieces(key[0].as_py(), height, width, r.T[None], 0, band * _thick(height, 2), _thick(width, 2))))])


def _back(key: tuple, group: pa.Table) -> pa.Table:
    """A band of lines of the correlation."""
    width = group["width"][0].as_py()
    r, height, width, band = _band(group, 1, width, "<c16")
    r = np.real(np.fft.ifft(r[0], axis=1))
    return pa.Table.from_batches([_batch([[key[0].as_py(), height, width, band, band * _thick(width, 2), len(r), r]])])


def correlation(pairs: DataFrame) -> DataFrame:
    """scene, height, width, band, at (first line), lines, data of the phase correlation of tiles of two layers: three
    shuffles of the samples, each to bands of BAND_BYTES."""
    bands = lambda df, f: df.groupBy("scene", "band").applyInArrow(f, _ROWS)
    pieces = pairs.select("scene", *T._OWN).mapInArrow(_bands_of_tiles, _ROWS)
    return bands(bands(bands(pieces, _along_lines), _across), _back)


def _read(columns: tuple[pa.Array, ...]) -> Iterator[tuple[np.ndarray, int, int, int]]:
    height, width, at, lines, data = columns
    for h, w, y0, n, d in zip(height.to_pylist(), width.to_pylist(), at.to_pylist(), lines.to_pylist(), data):
        yield np.frombuffer(d.as_buffer(), "<f8").reshape(n, w), h, w, y0


def _peaks(r: DataFrame) -> DataFrame:
    """scene, peak, py, px, n, mean and deviation of the correlation outside the peak's surroundings; r is a written table."""
    own = ("height", "width", "at", "lines", "data")

    @F.arrow_udf("struct<value: double, before: bigint>")
    def most(*columns: pa.Array) -> pa.Array:
        found = []
        for a, _, w, y0 in _read(columns):
            k = int(np.argmax(a))
            found.append({"value": float(a.ravel()[k]), "before": -(y0 * w + k)})
        return pa.array(found, pa.struct([("value", pa.float64()), ("before", pa.int64())]))

    @F.arrow_udf("array<double>")
    def rest(py: pa.Array, px: pa.Array, *columns: pa.Array) -> pa.Array:
        out = []
        for cy, cx, (a, h, w, y0) in zip(py.to_pylist(), px.to_pylist(), _read(columns)):
            keep = np.ones(a.shape, bool)
            span = np.arange(-NEAR, NEAR + 1)
            ys = (cy + span) % h - y0
            ys = ys[(ys >= 0) & (ys < len(a))]
            keep[np.ix_(ys, (cx + span) % w)] = False
            v = a[keep]
            out.append([float(v.size), float(v.sum()), float((v * v).sum())])
        return pa.array(out, pa.list_(pa.float64()))

    top = r.groupBy("scene", "width").agg(F.max(most(*own)).alias("m"))
    place = -F.col("m.before")
    top = written(top.select("scene", F.col("m.value").alias("peak"), F.expr("-m.before div width").alias("py"), (place % F.col("width")).alias("px")), "peaks")
    at = with_scene(r.select("scene", *own), top)
    sums = at.select("scene", rest("py", "px", *own).alias("s")).groupBy("scene").agg(*[F.sum(F.get("s", F.lit(i))).alias(n) for i, n in enumerate(("n", "s1", "s2"))])
    mean = F.try_divide("s1", "n")
    sums = sums.select("scene", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide("s2", "n") - mean * mean)).alias("deviation"))
    return top.join(sums, "scene")


def _summed(tiles: DataFrame, kernel, names: tuple[str, ...], params: tuple[str, ...] = ()) -> DataFrame:
    each = tiles.select("scene", "height", "width", T.measured(tiles, kernel, params=params).alias("s"))
    return each.groupBy("scene", "height", "width").agg(*[F.sum(F.get("s", F.lit(i))).alias(n) for i, n in enumerate(names)])


def _wrapped(at: Column, length: Column) -> Column:
    return F.when(at > F.floor(length / 2), at - length).otherwise(at).cast("int")


def shifts(pairs: DataFrame) -> DataFrame:
    """WIN5: scene, dy, dx, peak, psr, ncc, consensus, score: the whole-pixel shift of the second layer against the first, and
    how sure it is, of tiles of two layers; a flat image scores 0.20. pairs is a written table.

    The second image, moved back, is compared with the first in tiles: one more shuffle of its samples."""
    means = _summed(pairs, lambda a, p: [a[0].size, a[0].sum(), a[1].sum()], ("size", "sa", "sb"))
    means = written(means.select("scene", (F.col("sa") / F.col("size")).alias("ma"), (F.col("sb") / F.col("size")).alias("mb")), "means")
    centred = with_scene(pairs, means)
    spread = _summed(centred, lambda a, p, ma, mb: [a[0].size, ((a[0] - ma) ** 2).sum(), ((a[1] - mb) ** 2).sum()], ("size", "va", "vb"), ("ma", "mb"))
    peaks = written(_peaks(written(correlation(pairs), "correlation")).join(spread, "scene").join(means, "scene"), "peaks")

    moved = with_scene(pairs, peaks.select("scene", "py", "px")).withColumns({"new_height": F.col("height"), "new_width": F.col("width")})
    second = T.regridded(
        moved,
        lambda y, n, py, px: (y + py) % n,
        lambda x, n, py, px: (x + px) % n,
        lambda s, y, x, ys, xs, size, p, py, px: s[1][np.searchsorted(ys, (y + py) % size[0])[:, None], np.searchsorted(xs, (x + px) % size[1])],
        params=("py", "px"),
    )
    first = T.mapped(T.partitioned(pairs), lambda a, p: a[0])
    both = with_scene(stacked(first, second), means)

    def compared(a: np.ndarray, p: T.Place, ma: float, mb: float) -> list[float]:
        x, y = a[0] - ma, a[1] - mb
        return [(x * y).sum(), (np.sign(x) == np.sign(y)).sum()]

    like = _summed(both, compared, ("product", "agree"), ("ma", "mb")).select("scene", "product", "agree")
    s = peaks.join(like, "scene")
    flat = (F.sqrt(F.col("va") / F.col("size")) < 1e-9) | (F.sqrt(F.col("vb") / F.col("size")) < 1e-9)
    s = s.withColumns(
        {
            "dy": _wrapped(F.col("py"), F.col("height")),
            "dx": _wrapped(F.col("px"), F.col("width")),
            "psr": F.when(F.col("n") > 0, (F.col("peak") - F.col("mean")) / F.greatest("deviation", F.lit(1e-9))).otherwise(0.0),
            "ncc": F.try_divide(F.col("product"), F.sqrt(F.col("va") * F.col("vb"))),
            "consensus": F.col("agree") / F.col("size"),
        }
    )
    score = 0.55 * F.least(F.lit(1.0), F.greatest(F.col("peak") / 0.65, F.col("psr") / 60.0)) + 0.35 * F.col("consensus") + 0.10 * F.greatest(F.lit(0.0), F.col("ncc"))
    far = (F.abs("dy") > 0.1 * F.col("height")) | (F.abs("dx") > 0.1 * F.col("width"))
    score = F.round(F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.when(far, score * 0.5).otherwise(score))), 4)
    zero = lambda c, t="double": F.when(flat, F.lit(0).cast(t)).otherwise(F.col(c)).alias(c)
    return s.select("scene", zero("dy", "int"), zero("dx", "int"), *[zero(c) for c in ("peak", "psr", "ncc", "consensus")], F.when(flat, 0.20).otherwise(score).alias("score"))
