"""Box algebra over columns x0, y0, x1, y1 (top-left origin, y down)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(*cs: Column) -> Column:
    ok = F.lit(True)
    for c in cs:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def area(x0, y0, x1, y1) -> Column:
    """MAP12. 0 for a box that isn't finite or is inverted."""
    return F.when(finite(x0, y0, x1, y1) & (x1 > x0) & (y1 > y0), (x1 - x0) * (y1 - y0)).otherwise(0.0)


def valid(x0, y0, x1, y1, w, h) -> Column:
    """MAP13."""
    return finite(x0, y0, x1, y1) & (x0 >= 0) & (y0 >= 0) & (x1 <= w) & (y1 <= h) & (x0 < x1) & (y0 < y1)


def degeneracy(x0, y0, x1, y1, w, h) -> Column:
    """MAP14. Why a box says nothing, the first reason that holds; null for a sound one."""
    share = area(x0, y0, x1, y1) / (w * h)
    return (
        F.when(~finite(x0, y0, x1, y1), "non_finite").when((x1 < x0) | (y1 < y0), "inverted").when(area(x0, y0, x1, y1) <= 0, "zero_area") .when(
            share >= 0.98,
            F.concat(F.lit("full_image_coverage_"), F.floor(share * 100).cast("string"), F.lit("pct")),
        ) .when(((x1 - x0) >= 0.99 * w) & ((y1 - y0) >= 0.99 * h), "full_image_fallback")
    )


def clamped(x0, y0, x1, y1, w, h) -> tuple[Column, ...]:
    """MAP15. Into the image, at least one pixel wide and high, two decimals."""
    a, b = F.greatest(F.lit(0.0), F.least(x0, w - 1.0)), F.greatest(F.lit(0.0), F.least(y0, h - 1.0))
    c, d = F.greatest(a + 1.0, F.least(x1, w)), F.greatest(b + 1.0, F.least(y1, h))
    return tuple(F.round(v, 2) for v in (a, b, c, d))


def iou(a: tuple, b: tuple) -> Column:
    """JN5. Intersection over union, four decimals; 0 without a union."""
    pos = lambda v: F.greatest(F.lit(0.0), v)
    inter = pos(F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * pos(F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    size = lambda t: pos(t[2] - t[0]) * pos(t[3] - t[1])
    union = size(a) + size(b) - inter
    return F.when(union <= 0, 0.0).otherwise(F.round(inter / union, 4))


def ring(x0, y0, x1, y1, t: tuple) -> Column:
    """MAP10. The closed ring TL, TR, BR, BL, TL in map coordinates, X = a x + b y + c, Y = d x + e y + f, as text."""
    a, b, c, d, e, f = t
    point = lambda x, y: F.format_string("%.4f %.4f", F.round(a * x + b * y + c, 4), F.round(d * x + e * y + f, 4))
    return F.concat_ws(", ", point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def metric_area(pixels: Column, a: Column, e: Column) -> tuple[Column, Column]:
    """MAP22. Square metres, two decimals, and hectares, four."""
    m2 = pixels * F.abs(a) * F.abs(e)
    return F.round(m2, 2), F.round(m2 / 10_000.0, 4)


def oriented_to_axis(corners: Column, w: float, h: float) -> Column:
    """MAP17. An array of four corners x, y, x, y, ... in 0..1 as xmin, ymin, xmax, ymax in pixels, one decimal."""
    unit = F.transform(corners, lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    xs, ys = F.filter(unit, lambda _, i: i % 2 == 0), F.filter(unit, lambda _, i: i % 2 == 1)
    return F.array(*[F.round(f(c) * size, 1) for f in (F.array_min, F.array_max) for c, size in ((xs, w), (ys, h))])


def padded_crop(
    x0: Column,
    y0: Column,
    x1: Column,
    y1: Column,
    w: int,
    h: int,
    share: float = 0.15,
    least: float = 10.0,
) -> tuple[Column, Column, Column, Column, Column]:
    """MAP19. The box with `share` of its sides added, `least` pixels at least, in the image; and whether it is large enough."""
    px, py = F.greatest(F.lit(least), share * (x1 - x0)), F.greatest(F.lit(least), share * (y1 - y0))
    a, b = F.floor(F.greatest(F.lit(0.0), x0 - px)), F.floor(F.greatest(F.lit(0.0), y0 - py))
    c, e = F.floor(F.least(F.lit(float(w)), x1 + px)), F.floor(F.least(F.lit(float(h)), y1 + py))
    return a, b, c, e, (c - a >= least) & (e - b >= least)


def centre_crop(y: Column, x: Column, height: int, width: int, side: int) -> tuple[Column, Column, Column]:
    """MAP23. Whether a pixel is in the square about the centre, and its line and column there."""
    top, left = max(0, (height - side) // 2), max(0, (width - side) // 2)
    inside = (y >= top) & (y < min(height, top + side)) & (x >= left) & (x < min(width, left + side))
    return inside, (y - top).cast("int"), (x - left).cast("int")
