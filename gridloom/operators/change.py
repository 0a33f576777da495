"""Change detection on aligned pairs, morphology, components and zonal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import pixels as P
from ..store import written as _written

#: Pixels of a line in one number; side of the cells through which regions meet pixels.
BITS, CELL = 64, 64


def difference(pair: DataFrame) -> DataFrame:
    """MAP3 and the distance of CMP1: scene, y, x, d in 0..1. Two small aggregates a scene, joined back by scene."""
    most = pair.groupBy("scene").agg(F.max(F.array_max("a")).alias("ma"), F.max(F.array_max("b")).alias("mb"))
    d = pair.join(most, "scene").select(
        "scene",
        "y",
        "x",
        P.cva_distance(
            F.transform("a", lambda v: P.by_scene_max(v, F.col("ma"))),
            F.transform("b", lambda v: P.by_scene_max(v, F.col("mb"))),
        ).alias("d"),
    )
    top = d.groupBy("scene").agg(F.max("d").alias("top"))
    return d.join(top, "scene").select("scene", "y", "x", (F.col("d") / F.greatest("top", F.lit(1e-6))).alias("d"))


def thresholds(diff: DataFrame, *, bins: int = 128, **options) -> DataFrame:
    """AGG6, AGG7: scene, mu, sigma, threshold of differences in 0..1; see thresholds_of."""
    bin_ = F.least(F.floor(F.col("d") * bins), F.lit(bins - 1)).alias("bin")
    hist = diff.groupBy("scene", bin_).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d1"), F.sum(F.col("d") * F.col("d")).alias("d2"))
    return thresholds_of(hist, bins=bins, **options)


def thresholds_of(hist: DataFrame, *, sigmas: float = 1.5, least: float = 0.15, most: float = 0.65, bins: int = 128) -> DataFrame:
    """scene, mu, sigma, threshold of histograms (scene, bin, n, d1, d2), d1 and d2 being the sums of the differences and of
    their squares. Otsu's cut (the middle of the first best bin) where the difference is spread (mu > 0.10 and sigma > 0.08),
    else mu + sigmas * sigma; clamped. A scene's histogram is at most `bins` rows."""
    run, all_ = W.partitionBy("scene").orderBy("bin"), W.partitionBy("scene")
    h = hist.select(
        "scene",
        "bin",
        "n",
        "d1",
        "d2",
        F.sum("n").over(run).alias("w0"),
        F.sum(F.col("bin") * F.col("n")).over(run).alias("s0"),
        F.sum("n").over(all_).alias("w"),
        F.sum(F.col("bin") * F.col("n")).over(all_).alias("s"),
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    between = F.when(w1 > 0, F.struct((F.col("w0") * w1 * gap * gap).alias("between"), (-F.col("bin")).alias("first")))
    # Mean and deviation come from the bins' own sums, so that one pass and one shuffle give all.
    stats = h.groupBy("scene").agg(
        (F.sum("d1") / F.sum("n")).alias("mu"),
        (F.sum("d2") / F.sum("n")).alias("square"),
        F.max(between).alias("best"),
    )
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mu") * F.col("mu")))
    stats = stats.select("scene", "mu", sigma.alias("sigma"), (-F.col("best.first")).alias("bin"))
    cut = F.coalesce((F.col("bin") + 0.5) / bins, F.lit(0.35))
    raw = F.when((F.col("mu") > 0.10) & (F.col("sigma") > 0.08), cut).otherwise(F.col("mu") + sigmas * F.col("sigma"))
    return stats.select("scene", "mu", "sigma", F.greatest(F.lit(least), F.least(F.lit(most), raw)).alias("threshold"))


def raw_mask(diff: DataFrame, cuts: DataFrame) -> DataFrame:
    """MAP21: the foreground's scene, y, x, d."""
    return diff.join(cuts.select("scene", "threshold"), "scene").where("d >= threshold").select("scene", "y", "x", "d")


def _around(mask: DataFrame, ys: range, xs: range) -> DataFrame:
    near = [F.struct((F.col("y") + dy).cast("int").alias("y"), (F.col("x") + dx).cast("int").alias("x")) for dy in ys for dx in xs]
    return mask.select("scene", F.explode(F.array(*near)).alias("p")).select("scene", "p.y", "p.x")


def erode(mask: DataFrame, ys: range = range(-1, 2), xs: range = range(-1, 2)) -> DataFrame:
    """Pixels all of whose neighbours in the window are in the mask; what lies outside the scene is not."""
    back = _around(mask, range(-ys.stop + 1, -ys.start + 1), range(-xs.stop + 1, -xs.start + 1))
    return back.groupBy("scene", "y", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(ys) * len(xs)).select("scene", "y", "x")


def dilate(mask: DataFrame, height: int, width: int, ys: range = range(-1, 2), xs: range = range(-1, 2)) -> DataFrame:
    return _around(mask, ys, xs).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()


def words(mask: DataFrame) -> DataFrame:
    """scene, y, w, b: the mask as numbers of BITS pixels of a line each; numbers of none are left out."""
    bit = F.expr(f"shiftleft(1L, cast(x % {BITS} as int))")
    return mask.groupBy("scene", "y", F.floor(F.col("x") / BITS).cast("int").alias("w")).agg(F.bit_or(bit).alias("b"))


def pixels_of(w: DataFrame) -> DataFrame:
    """scene, y, x of the bits that are set."""
    set_ = F.filter(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda i: F.expr("b").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0,
    )
    return w.select("scene", "y", F.explode(F.transform(set_, lambda i: (F.col("w") * BITS + i).cast("int"))).alias("x"))


def _square(w: DataFrame, height: int, width: int, radius: int, grow: bool) -> DataFrame:
    """The erosion or dilation of words by a square of `radius` pixels about the centre. Each number goes to the lines
    and numbers around it: some rows for BITS pixels, combined before the one shuffle. What lies outside is not in the mask."""
    last, lines = (width - 1) // BITS, range(-radius, radius + 1)
    near = [F.struct(F.lit(dy).alias("dy"), F.lit(dw).alias("dw")) for dy in lines for dw in (-1, 0, 1)]
    rows = w.select("scene", "y", "w", "b", F.explode(F.array(*near)).alias("p"))
    rows = rows.select("scene", (F.col("y") + F.col("p.dy")).alias("y"), (F.col("w") + F.col("p.dw")).alias("w"), "p.*", "b")
    rows = rows.where(F.col("y").between(0, height - 1) & F.col("w").between(0, last))
    at = {(dy, dw): f"v{i}{j}" for i, dy in enumerate(lines) for j, dw in enumerate((-1, 0, 1))}
    none = F.lit(0).cast("long")
    found = rows.groupBy("scene", "y", "w").agg(
        *[F.coalesce(F.bit_or(F.when((F.col("dy") == dy) & (F.col("dw") == dw), F.col("b"))), none).alias(n) for (dy, dw), n in at.items()]
    )

    def line(dy: int) -> Column:
        # What came with dw = 1 is the number on the left, whose last bits are next to this one's first.
        own, left, right = at[dy, 0], at[dy, 1], at[dy, -1]
        sides = []
        for k in range(1, radius + 1):
            sides.append(f"(shiftleft({own}, {k}) | shiftrightunsigned({left}, {BITS - k}))")
            sides.append(f"(shiftrightunsigned({own}, {k}) | shiftleft({right}, {BITS - k}))")
        return F.expr((" | " if grow else " & ").join([own, *sides]))

    out = line(-radius)
    for dy in lines[1:]:
        out = out.bitwiseOR(line(dy)) if grow else out.bitwiseAND(line(dy))
    inside = (1 << ((width - 1) % BITS + 1)) - 1
    inside = inside - (1 << 64) if inside >> 63 else inside
    out = F.when(F.col("w") == last, out.bitwiseAND(F.lit(inside).cast("long"))).otherwise(out)
    return found.select("scene", "y", "w", out.alias("b")).where("b != 0")


def opened_closed(mask: DataFrame, height: int, width: int) -> DataFrame:
    """WIN2: 3 x 3 opening, then closing, on numbers of BITS pixels. The two dilations between are one of twice the radius;
    that the first is cut off at the border changes nothing, as what is nearest to it lies inside."""
    w = words(mask)
    for radius, grow in ((1, False), (2, True), (1, False)):
        w = _square(w, height, width, radius, grow)
    return pixels_of(w)


def opened_2x2(mask: DataFrame, height: int, width: int) -> DataFrame:
    """WIN3: opening by a 2 x 2 square: the pixels that some full square of the mask covers."""
    m = mask.select("scene", "y", "x")
    return dilate(erode(m, range(0, 2), range(0, 2)), height, width, range(0, 2), range(0, 2)).intersect(m)


def components(mask: DataFrame, width: int) -> DataFrame:
    """WIN4: scene, y, x, label of four-connected components, numbered from 1 in raster order of their first pixel.

    Runs of a line are found by a window, so that labels travel along runs and not pixels; runs that touch in the next
    line pass the least label on, and each round also takes its label's label. A round is a written table; their
    number grows with the logarithm of a component's extent in lines for most shapes. Runs and labels meet by shuffles: a
    broadcast a join and round would pass many times the table through the driver."""
    w = W.partitionBy("scene", "y").orderBy("x")
    runs = mask.select("scene", "y", "x").withColumn("g", F.col("x") - F.row_number().over(w))
    runs = _written(
        runs.groupBy("scene", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).withColumn(
            "id",
            (F.col("y") * width + F.col("x0")).cast("long"),
        ),
        "runs",
    )
    up = runs.select("scene", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("id").alias("uid"))
    touch = runs.join(up.hint("merge"), ["scene", "y"]).where("x0 <= u1 and u0 <= x1").select("scene", "id", "uid")
    edges = _written(touch.union(touch.select("scene", F.col("uid").alias("id"), F.col("id").alias("uid"))), "edges")
    labels = runs.select("scene", "id", F.col("id").alias("label"))
    while True:
        near = edges.join(
            labels.select("scene", F.col("id").alias("uid"), F.col("label").alias("o")).hint("merge"),
            ["scene", "uid"],
        ).groupBy("scene", "id").agg(F.min("o").alias("o"))
        new = _written(
            labels.join(near.hint("merge"), ["scene", "id"], "left").select(
                "scene",
                "id",
                F.col("label").alias("was"),
                F.least("label", "o").alias("to"),
            ),
            "nearer",
        )
        new = new.join(
            new.select("scene", F.col("id").alias("to"), F.col("to").alias("label")).hint("merge"),
            ["scene", "to"],
        ).select("scene", "id", "was", "label")
        new = _written(new, "jumped")
        labels = new.select("scene", "id", "label")
        if new.where("was != label").limit(1).count() == 0:
            break
    # Numbers go to the labels alone, of which there are as many as components.
    numbers = _written(
        labels.select("scene", "label").distinct().withColumn("number", F.row_number().over(W.partitionBy("scene").orderBy("label"))),
        "numbers",
    )
    out = runs.join(labels.hint("merge"), ["scene", "id"]).join(numbers.hint("merge"), ["scene", "label"]).withColumn("label", F.col("number"))
    return out.select("scene", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def regions(labelled: DataFrame, diff: DataFrame, *, least: int = 16, most: int = 50, by_area: bool = False) -> DataFrame:
    """AGG3, FLT13, SRT1: scene, label, half-open bounding box, pixels, mean difference over the bounding box. Of the
    first `most` labels (or of the largest, by_area) those with `least` pixels."""
    r = labelled.groupBy("scene", "label").agg(
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max("x") + 1).alias("x1"),
        (F.max("y") + 1).alias("y1"),
        F.count(F.lit(1)).alias("pixels"),
    )
    order = [F.desc("pixels"), F.col("label")] if by_area else [F.col("label")]
    r = r.withColumn(
        "rank",
        F.row_number().over(W.partitionBy("scene").orderBy(*order)),
    ).where((F.col("rank") <= most) & (F.col("pixels") >= least))
    # Regions and pixels meet in coarse cells, so a pixel sees the regions near it only.
    cut = lambda c: F.floor(F.col(c) / CELL)
    cells = r.withColumn(
        "cy",
        F.explode(F.sequence(cut("y0"), F.floor((F.col("y1") - 1) / CELL))),
    ).withColumn("cx", F.explode(F.sequence(cut("x0"), F.floor((F.col("x1") - 1) / CELL))))
    inside = cells.join(
        diff.select("scene", "y", "x", "d", cut("y").alias("cy"), cut("x").alias("cx")),
        ["scene", "cy", "cx"],
    ).where("y >= y0 and y < y1 and x >= x0 and x < x1")
    mean = inside.groupBy("scene", "label").agg(F.round(F.avg("d"), 4).alias("mean_d"))
    return r.drop("rank").join(mean, ["scene", "label"])


def zonal(diff: DataFrame, mask: DataFrame, *, a: float = 10.0, e: float = -10.0) -> DataFrame:
    """AGG1: scene, total, changed, ratio_pct, area_m2, area_ha, warning."""
    total = diff.groupBy("scene").agg(F.count(F.lit(1)).alias("total"))
    n = mask.groupBy("scene").agg(F.count(F.lit(1)).alias("n"))
    z = total.join(n, "scene", "left").select("scene", "total", F.coalesce("n", F.lit(0)).cast("long").alias("changed"))
    pct = F.round(F.col("changed") / F.col("total") * 100.0, 4)
    m2, ha = B.metric_area(F.col("changed"), F.lit(a), F.lit(e))
    note = F.when(F.col("changed") == 0, "no_change").when(pct >= 98.0, "full_image").when(pct >= 50.0, "extreme")
    return z.select("scene", "total", "changed", pct.alias("ratio_pct"), m2.alias("area_m2"), ha.alias("area_ha"), note.alias("warning"))


def detect(pair: DataFrame, height: int, width: int) -> dict[str, DataFrame]:
    """CMP1, CMP3: difference, thresholds, raw and cleaned mask, zonal statistics of all scenes."""
    diff = _written(difference(pair), "difference")
    cuts = thresholds(diff)
    raw = raw_mask(diff, cuts)
    clean = opened_closed(raw, height, width)
    return {"difference": diff, "thresholds": cuts, "raw": raw, "mask": clean, "zonal": zonal(diff, clean)}


#: Pixels that a mask must have to count as a finding.
FEW = 16


def differing(pair: DataFrame) -> DataFrame:
    """scene, n: pixels of which any band differs."""
    return pair.where(F.col("a") != F.col("b")).groupBy("scene").agg(F.count(F.lit(1)).alias("n"))


def with_fallback(neural: DataFrame, cva: DataFrame, pair: DataFrame) -> DataFrame:
    """CMP2: scene, y, x, source: the neural mask; where that has few pixels, though FEW pixels or more differ, the CVA
    mask, if that has them. Both are foreground only."""
    n = lambda df, name: df.groupBy("scene").agg(F.count(F.lit(1)).alias(name))
    use = differing(pair).where(F.col("n") >= FEW).join(n(cva, "cva"), "scene").join(n(neural, "own"), "scene", "left")
    use = use.where((F.col("cva") >= FEW) & (F.coalesce("own", F.lit(0)) < FEW)).select("scene")
    own = neural.join(use, "scene", "left_anti").select("scene", "y", "x", F.lit("neural").alias("source"))
    return own.unionByName(cva.join(use, "scene", "left_semi").select("scene", "y", "x", F.lit("cva").alias("source")))


def is_still(changed: Column, regions: Column) -> Column:
    """CMP7. Whether there is nothing to interpret: no changed pixel, or no region."""
    return (F.coalesce(changed, F.lit(0)) == 0) | (F.coalesce(regions, F.lit(0)) == 0)


def roughness(img: DataFrame, height: int, width: int, value: str = "sar", radius: int = 2) -> DataFrame:
    """WIN1: local standard deviation in a square, mirrored at the border (the edge pixel counts twice). Each pixel goes
    to the windows that it counts in; sums combine before the shuffle."""
    rows = img.select("scene", "y", "x", F.col(value).alias("v"))
    span = lambda c, n: F.filter(
        F.flatten(F.transform(F.array(F.col(c), -1 - F.col(c), 2 * n - 1 - F.col(c)), lambda q: F.sequence(q - radius, q + radius))),
        lambda q: (q >= 0) & (q < n),
    )
    wide = rows.select("scene", "y", F.explode(span("x", width)).alias("x"), "v").groupBy("scene", "y", "x").agg(
        F.sum("v").alias("s"),
        F.sum(F.col("v") * F.col("v")).alias("q"),
    )
    both = wide.select(
        "scene",
        F.explode(span("y", height)).alias("y"),
        "x",
        "s",
        "q",
    ).groupBy("scene", "y", "x").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    n = float((2 * radius + 1) ** 2)
    return both.select(
        "scene",
        "y",
        "x",
        F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - (F.col("s") / n) * (F.col("s") / n))).alias("rough"),
    )
