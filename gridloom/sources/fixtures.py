"""SRC14. Scenes made by arithmetic, alike on every run: bi-temporal pairs with and without change, and optical-SAR pairs.

A scene is a colour with a fixed texture, on which shapes are painted. A shape is a condition on y and x in SQL that
Spark and any other engine read alike, so that the same scene can be made elsewhere for comparison."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 256
TEXTURE = "((y * 7 + x * 13) % 11 - 5)"

Shape = tuple[str, tuple]


@dataclass(frozen=True)
class Pair:
    """What T1 shows, what T2 shows beside it, a shift of all of T2's values, a step that T2's values are cut to, and a move of T2."""

    base: tuple[int, int, int]
    first: tuple[Shape, ...] = ()
    second: tuple[Shape, ...] = ()
    shift: tuple[int, int, int] = (0, 0, 0)
    step: int = 1
    move: tuple[int, int] = (0, 0)
    formats: str = "PNG -> PNG"
    change: bool | None = True


def block(y0: int, y1: int, x0: int, x1: int, colour: tuple) -> Shape:
    return f"y >= {y0} and y < {y1} and x >= {x0} and x < {x1}", colour


def houses(places: list[tuple[int, int]], h: int, w: int, shade: int, roof: tuple, dark: tuple) -> tuple[Shape, ...]:
    """Roofs, each with a shadow below it."""
    return tuple(s for y, x in places for s in (block(y, y + h, x, x + w, roof), block(y + h, y + h + shade, x, x + w, dark)))


# Colours and places of the scenes, their formats, and whether a change is to be found.
_STATIC = houses([(30, 30), (30, 150), (150, 30), (150, 150)], 45, 55, 7, (200, 200, 210), (40, 40, 45))
PAIRS = {
    "00_core": Pair((70, 140, 60), second=(block(90, 170, 90, 170, (210, 215, 220)),), formats="TIFF -> TIFF"),
    "01_building": Pair(
        (140, 130, 115),
        second=houses([(40, 40), (40, 140), (140, 40), (140, 140)], 50, 60, 10, (210, 215, 220), (40, 40, 45)),
    ),
    "02_vegetation": Pair((35, 95, 40), second=(("(y - 128) * (y - 128) + (x - 128) * (x - 128) <= 4225", (175, 140, 95)),)),
    "03_water": Pair((160, 145, 120), second=(("y >= 110", (25, 65, 125)),)),
    "04_roads": Pair((110, 130, 90), second=(("y >= x - 6 and y < x + 6", (55, 55, 60)),)),
    "05_construction": Pair((90, 120, 80), second=(block(60, 200, 50, 210, (185, 150, 100)),), formats="JPEG -> JPEG"),
    "06_no_change": Pair((120, 120, 120), first=_STATIC, change=False),
    "07_seasonal": Pair((90, 120, 80), shift=(35, 10, -15), change=False),
    "08_compression": Pair((120, 120, 120), first=_STATIC, step=6, formats="JPEG -> JPEG", change=False),
    "09_misalignment": Pair((120, 120, 120), first=_STATIC, move=(45, 55), change=None),
    "10_cross_format": Pair((110, 125, 95), second=(block(70, 180, 70, 180, (215, 220, 225)),), formats="PNG -> TIFF"),
    "11_flood": Pair((150, 115, 75), second=(block(64, 192, 64, 192, (25, 65, 135)),), formats="TIFF -> TIFF"),
    "12_harvest": Pair((60, 150, 50), second=(block(50, 200, 50, 200, (150, 115, 75)),), formats="JPEG -> TIFF"),
}

#: Optical colour and backscatter, 0 to 255 and 0 to 1: T1's shapes over both.
OPTICAL_SAR = {
    "standard": (
        (160, 150, 130),
        "0.28",
        (
            block(0, 80, 0, 80, (25, 65, 135, "0.03")),
            block(30, 90, 120, 200, (170, 170, 175, "case when y % 3 = 0 then 0.40 else 0.85 end")),
            block(120, 180, 120, 200, (170, 170, 175, "case when y % 3 = 0 then 0.40 else 0.85 end")),
            block(100, 200, 10, 100, (40, 120, 45, "0.42")),
            block(200, 250, 120, 240, (185, 150, 100, "0.26")),
        ),
    ),
    "built": ((160, 150, 130), "0.28", (block(60, 180, 60, 180, (150, 150, 150, "case when y % 2 = 0 then 0.82 else 0.35 end")),)),
    "smooth": ((160, 150, 130), "0.28", (block(60, 180, 60, 180, (150, 150, 150, "0.10")),)),
    "water": ((160, 150, 130), "0.18", (block(60, 180, 60, 180, (25, 65, 135, "0.18")),)),
    "vegetation": ((160, 150, 130), "0.18", (block(60, 180, 60, 180, (40, 120, 45, "0.18")),)),
}


def _painted(base: str, shapes: tuple[Shape, ...], band: int) -> str:
    """The last shape that holds is on top."""
    cases = " ".join(f"when {cond} then {colour[band]}" for cond, colour in reversed(shapes))
    return f"case {cases} else {base} end" if cases else base


def values(p: Pair, band: int, time: int) -> str:
    """A band of a pair at a time, 0 or 1, in SQL: whole numbers from 0 to 255."""
    shown = _painted(f"{p.base[band]} + {TEXTURE}", p.first + (p.second if time else ()), band)
    if time and any(p.move):
        moved = {"y": f"((y + {SIDE - p.move[0]}) % {SIDE})", "x": f"((x + {SIDE - p.move[1]}) % {SIDE})"}
        shown = re.sub(r"\b[yx]\b", lambda m: moved[m[0]], shown)
    if not time or p.shift == (0, 0, 0) and p.step == 1:
        return shown
    return f"least(255, greatest(0, ({shown}) + {p.shift[band]} - (({shown}) + {p.shift[band]}) % {p.step}))"


def pairs(spark: SparkSession) -> DataFrame:
    """scene, y, x, a, b: both times of each pixel, three bands each."""
    at = spark.range(SIDE * SIDE).select(F.floor(F.col("id") / SIDE).cast("int").alias("y"), (F.col("id") % SIDE).cast("int").alias("x"))
    out = None
    for name, p in PAIRS.items():
        bands = [F.array(*[F.expr(values(p, k, t)).cast("double") for k in range(3)]) for t in (0, 1)]
        one = at.select(F.lit(name).alias("scene"), "y", "x", bands[0].alias("a"), bands[1].alias("b"))
        out = one if out is None else out.unionAll(one)
    return out


def expected(spark: SparkSession) -> DataFrame:
    """scene, formats, change (null where no verdict is asked for)."""
    return spark.createDataFrame([(n, p.formats, p.change) for n, p in PAIRS.items()], "scene string, formats string, change boolean")


def optical_sar(spark: SparkSession) -> DataFrame:
    """scene, y, x, r, g, b, sar in 0..1."""
    at = spark.range(SIDE * SIDE).select(F.floor(F.col("id") / SIDE).cast("int").alias("y"), (F.col("id") % SIDE).cast("int").alias("x"))
    out = None
    for name in OPTICAL_SAR:
        one = at.select(F.lit(name).alias("scene"), "y", "x", *[F.expr(v).alias(c) for c, v in optical_sar_values(name).items()])
        out = one if out is None else out.unionAll(one)
    return out


def optical_sar_values(name: str) -> dict[str, str]:
    base, sar, shapes = OPTICAL_SAR[name]
    out = {c: f"cast({_painted(str(base[k]), shapes, k)} as double) / cast(255.0 as double)" for k, c in enumerate("rgb")}
    return out | {"sar": f"cast({_painted(sar, shapes, 3)} as double)"}


def sql(kind: str) -> str:
    """The same rows as pairs or optical_sar in standard SQL, for comparison with another engine; it asks for a table
    `gr` of all y and x."""
    if kind == "pairs":
        band = lambda p, t: "[" + ", ".join(f"cast({values(p, k, t)} as double)" for k in range(3)) + "]"
        return " union all ".join(f"select '{n}' as scene, y, x, {band(p, 0)} as a, {band(p, 1)} as b from gr" for n, p in PAIRS.items())
    return " union all ".join(
        f"select '{n}' as scene, y, x, " + ", ".join(f"{v} as {c}" for c, v in optical_sar_values(n).items()) + " from gr"
        for n in OPTICAL_SAR
    )
