"""UDF1. The built-in specialists as table functions of SQL, over tables of tiles.

    select * from change_statistics(table(select * from tiles) partition by scene)
    select * from class_shares(table(select * from tiles) partition by scene)

A row is a tile (see operators.tiles), and a partition a scene, of which only sums are kept: a table function sees a tile at a
time. What a scene's tiles are held against (its maxima, its threshold) stands beside them, as tile_filters.cuts gives it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .runtime import shared

#: What a tile's row must have, whatever else it has.
TILE = ("scene", "ty", "tx", "height", "width", "side", "layers", "kind", "data")


@dataclass
class Checked(AnalyzeResult):
    """The result's schema, and nothing else to pass on."""

    columns: tuple[str, ...] = field(default=())


def _analyzed(table: AnalyzeArgument, needs: tuple[str, ...], schema: StructType) -> Checked:
    if not table.isTable:
        raise ValueError("a table is needed: table(...) partition by scene")
    missing = [c for c in needs if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table has no columns {missing}")
    return Checked(schema=schema, columns=needs)


def _array(row) -> np.ndarray:
    h = min(row["side"], row["height"] - row["ty"] * row["side"])
    return np.frombuffer(row["data"], row["kind"]).reshape(row["layers"], h, -1)


class ChangeStatistics:
    """CHANGE_DETECT: scene, total, changed, ratio_pct, largest of tiles of distances beside their scene's top and threshold.
    Distances below 0 are no pixels."""

    NEEDS = (*TILE, "top", "threshold")

    def __init__(self, analyzed: Checked | None = None):
        self.scene, self.total, self.changed, self.largest = None, 0, 0, 0.0

    @staticmethod
    def analyze(tiles: AnalyzeArgument) -> Checked:
        s = StructType().add("scene", LongType()).add("total", LongType()).add("changed", LongType()).add("ratio_pct", DoubleType()).add("largest", DoubleType())
        return _analyzed(tiles, ChangeStatistics.NEEDS, s)

    def eval(self, row):
        d = _array(row)[0]
        d = d[~(d < 0)] / row["top"]
        self.scene = row["scene"]
        self.total += d.size
        self.changed += int(np.count_nonzero(d >= row["threshold"]))
        self.largest = max(self.largest, float(d.max(initial=0.0)))

    def terminate(self):
        if self.total:
            yield self.scene, self.total, self.changed, self.changed / self.total * 100.0, self.largest


class ClassShares:
    """OPTICAL_SAR_FUSION: scene, class, pixels, pct of tiles of class numbers, 0 being unknown; a second layer has 1 for
    the pixels that are there. The classes' names are the
    model here: each worker loads them once."""

    NEEDS = TILE

    def __init__(self, analyzed: Checked | None = None):
        self.scene, self.counts = None, np.zeros(0, np.int64)

    @staticmethod
    def analyze(tiles: AnalyzeArgument) -> Checked:
        s = StructType().add("scene", LongType()).add("class", StringType()).add("pixels", LongType()).add("pct", DoubleType())
        return _analyzed(tiles, ClassShares.NEEDS, s)

    def eval(self, row):
        a = _array(row)
        n = np.bincount(a[0][a[1] > 0] if len(a) > 1 else a[0].ravel(), minlength=len(self.counts))
        n[: len(self.counts)] += self.counts
        self.scene, self.counts = row["scene"], n

    def terminate(self):
        with shared("class_names", _names) as names:
            for k in np.flatnonzero(self.counts).tolist():
                yield self.scene, names[k], int(self.counts[k]), float(self.counts[k]) / float(self.counts.sum()) * 100.0


def _names() -> list[str]:
    from ..operators.fusion import UNKNOWN

    return [UNKNOWN, *CLASSES]


# Land cover classes, by number from 1.
CLASSES = ("water_body", "built_structure", "vegetation_or_cropland", "road_or_infrastructure", "bare_ground_or_soil")

FUNCTIONS = {"change_statistics": ChangeStatistics, "class_shares": ClassShares}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, udtf(f))
