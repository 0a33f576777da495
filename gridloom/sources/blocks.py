"""SRC2 as a Spark data source: rasters' blocks (strips or tiles), a row a block and band, read by ranges of bytes.

A partition is a share of a file's blocks, planned from the files' sizes alone; it reads the header's pages and then the
blocks that its share and the pushed filters leave: band = / in, and y0, y1, x0, x1 with < <= > >=."""

from __future__ import annotations

import operator
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from ..operators import tiles as T
from .ranges import Ranged, listed
from .raster import Tiff, png_blocks

FORMAT = "gridloom_raster"
#: The file, its size in samples, the block's samples: lines y0 to y1 - 1, columns x0 to x1 - 1.
BLOCK = "path string, height int, width int, n_bands int, band int, y0 int, y1 int, x0 int, x1 int, kind string, data binary"
SAMPLES = "path string, band int, y int, x int, value double"
#: Bytes of a file that a task takes.
SHARE_BYTES = 32 << 20

_COMPARED = {LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge}


class Share(InputPartition):
    def __init__(self, path: str, k: int, n: int):
        super().__init__(k)
        self.path, self.k, self.n = path, k, n


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern")
        self.share_bytes = int(options.get("sharebytes", SHARE_BYTES))
        self.bands: set[int] | None = None
        self.limits: list[tuple[str, str, object]] = []
        #: For tests: bytes that read took of the last file.
        self.took = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Blocks and bands are left out here; what is within a block Spark has nothing to filter by, so that only other
        filters are left to it."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "band" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.bands = asked if self.bands is None else self.bands & asked
            elif name in ("y0", "y1", "x0", "x1") and type(f) in _COMPARED:
                self.limits.append((name, type(f).__name__, f.value))
            elif not isinstance(f, IsNotNull):  # no column is ever null
                yield f

    def partitions(self) -> list[Share]:
        return [Share(p, k, n) for p, size in listed(self.path, self.pattern) for n in [max(1, -(-size // self.share_bytes))] for k in range(n)]

    def _wanted(self, y: int, x: int, h: int, w: int) -> bool:
        at = {"y0": y, "y1": y + h, "x0": x, "x1": x + w}
        compared = {t.__name__: f for t, f in _COMPARED.items()}
        return all(compared[how](at[name], value) for name, how, value in self.limits)

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        """The share's blocks; a file that can't be read gives none, one that is cut off those before the cut."""
        try:
            with Ranged(share.path) as data:
                try:
                    yield from self._png(share, data) if data[:8] == b"\x89PNG\r\n\x1a\n" else self._tiff(share, data)
                finally:
                    self.took = data.read
        except (ValueError, struct.error, zlib.error, IndexError, OSError, OverflowError):
            return

    def _bands(self, n: int) -> list[int]:
        return [b for b in range(1, n + 1) if self.bands is None or b in self.bands]

    def _tiff(self, share: Share, data: Ranged) -> Iterator[pa.RecordBatch]:
        t = Tiff(data)
        bands, places = self._bands(t.n_bands), list(t.places())
        for k in range(len(places) * share.k // share.n, len(places) * (share.k + 1) // share.n):
            if bands and self._wanted(*places[k]):
                yield _batch(share.path, t.height, t.width, t.n_bands, bands, *places[k][:2], t.block(k, bands))

    def _png(self, share: Share, data: Ranged) -> Iterator[pa.RecordBatch]:
        """A stream is read by the first share alone."""
        if share.k:
            return
        width, height = struct.unpack(">II", data[16:24])
        for y, a in png_blocks(data):
            bands = self._bands(len(a))
            if bands and self._wanted(y, 0, a.shape[1], width):
                yield _batch(share.path, height, width, len(a), bands, y, 0, a[[b - 1 for b in bands]])


def _batch(path: str, height: int, width: int, n_bands: int, bands: list[int], y: int, x: int, a: np.ndarray) -> pa.RecordBatch:
    kind, h, w = a.dtype.newbyteorder("<").str, a.shape[1], a.shape[2]
    same = lambda v, t: pa.array([v] * len(bands), t)
    ints = [same(height, pa.int32()), same(width, pa.int32()), same(n_bands, pa.int32()), pa.array(bands, pa.int32())]
    ends = [same(v, pa.int32()) for v in (y, y + h, x, x + w)]
    rows = pa.array([np.ascontiguousarray(p, kind).tobytes() for p in a], pa.binary())
    return pa.RecordBatch.from_arrays([same(path, pa.string()), *ints, *ends, same(kind, pa.string()), rows], [c.split()[0] for c in BLOCK.split(", ")])


class RasterBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("gridloom_raster") known, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterBlocks)


def read_blocks(
    spark: SparkSession,
    path: str,
    *,
    bands: list[int] | None = None,
    window: tuple[int, int, int, int] | None = None,
    pattern: str | None = None,
    share_bytes: int = SHARE_BYTES,
) -> DataFrame:
    """SRC2: rows of BLOCK of the files at path; of bands, from 1, and of blocks that touch the window (y0, x0, y1, x1), if
    these are given. Files that can't be read give none (see raster.inspect)."""
    register(spark)
    r = spark.read.format(FORMAT).option("shareBytes", str(share_bytes))
    df = (r.option("pattern", pattern) if pattern else r).load(path)
    if bands is not None:
        df = df.where(F.col("band").isin(bands))
    if window is not None:
        y0, x0, y1, x1 = window
        df = df.where((F.col("y1") > y0) & (F.col("y0") < y1) & (F.col("x1") > x0) & (F.col("x0") < x1))
    return df


def read_bands(spark: SparkSession, path: str, bands: list[int] | None = None, pattern: str | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """SRC2 as rows of SAMPLES: the samples of the files' bands, of the window alone if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a = np.frombuffer(r["data"], r["kind"]).reshape(r["y1"] - r["y0"], -1)
                y0, x0, y1, x1 = window or (0, 0, r["height"], r["width"])
                top, left = max(y0 - r["y0"], 0), max(x0 - r["x0"], 0)
                a = a[top : max(y1 - r["y0"], 0), left : max(x1 - r["x0"], 0)]
                y, x = np.indices(a.shape)
                cols = [(y.ravel() + r["y0"] + top).astype(np.int32), (x.ravel() + r["x0"] + left).astype(np.int32), a.ravel().astype(float)]
                head = [pa.array([r["path"]] * a.size, pa.string()), pa.array(np.full(a.size, r["band"], np.int32))]
                yield pa.RecordBatch.from_arrays([*head, *map(pa.array, cols)], ["path", "band", "y", "x", "value"])

    return read_blocks(spark, path, bands=bands, window=window, pattern=pattern).mapInArrow(run, SAMPLES)


def to_tiles(blocks: DataFrame, scenes: DataFrame, bands: list[int], *, side: int = T.SIDE, kind: str = "<f8") -> DataFrame:
    """Tiles of the files' bands, a layer each in the order given; scenes (path, scene) names them and is few rows a file,
    joined by path. One shuffle, of the blocks' pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["scene", "ty", "tx", "height", "width", "layer", "y", "x", "h", "w", "data"]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                a = np.frombuffer(r["data"], r["kind"]).reshape(r["y1"] - r["y0"], -1)
                for ty in range(r["y0"] // side, (r["y1"] - 1) // side + 1):
                    for tx in range(r["x0"] // side, (r["x1"] - 1) // side + 1):
                        y, x = max(ty * side, r["y0"]), max(tx * side, r["x0"])
                        part = a[y - r["y0"] : (ty + 1) * side - r["y0"], x - r["x0"] : (tx + 1) * side - r["x0"]]
                        data = np.ascontiguousarray(part, kind).tobytes()
                        rows.append((r["scene"], ty, tx, r["height"], r["width"], bands.index(r["band"]), y - ty * side, x - tx * side, *part.shape, data))
            if rows:
                types = [pa.int64(), *[pa.int32()] * 9, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        scene, ty, tx = (k.as_py() for k in key)
        height, width = group["height"][0].as_py(), group["width"][0].as_py()
        p = T._place(ty, tx, height, width, side)
        out = np.zeros((len(bands), p.h, p.w), kind)
        for r in group.select(["layer", "y", "x", "h", "w", "data"]).to_pylist():
            out[r["layer"], r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["data"], kind).reshape(r["h"], r["w"])
        row = {"scene": scene, "ty": ty, "tx": tx, "height": height, "width": width, "side": side, "layers": len(bands), "kind": kind, "data": out.tobytes()}
        return pa.Table.from_pylist([row], schema=T._SCHEMA)

    pieces = blocks.where(F.col("band").isin(bands)).join(scenes.select("path", F.col("scene").cast("long").alias("scene")), "path")
    pieces = pieces.mapInArrow(cut, "scene long, ty int, tx int, height int, width int, layer int, y int, x int, h int, w int, data binary")
    return pieces.groupBy(*T.KEYS).applyInArrow(joined, T.TYPE)
