"""Scenes in tiles: filters with their neighbours' edges, components, other grids. Tiles are small here, so that the scenes of
the test tables have several; each query has the SQL of its pixel form where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..operators import fusion as U
from ..operators import spectrum as SP
from ..operators import tile_filters as TF
from ..operators import tile_labels as TL
from ..operators import tiles as T
from ..operators import warp as WP
from ..plans import functions as FN
from ..store import written
from . import SQL, query
from . import imagery as I

SIDE = 12
BANDS = 4


def _tiles(px: DataFrame, values: list[str], kind: str = "<f8") -> DataFrame:
    return T.from_pixels(px, values, I.H, I.WIDTH, side=SIDE, kind=kind)


def _seen(px: DataFrame, values: list[str], kind: str = "<f8", scenes: DataFrame | None = None) -> DataFrame:
    """_tiles with a last layer that tells which pixels are there: the last scene of a table may lack lines."""
    return T.from_pixels(px.withColumn("seen", F.lit(1)), [*values, "seen"], I.H, I.WIDTH, side=SIDE, kind=kind, scenes=scenes)


def _pairs(pair: DataFrame) -> DataFrame:
    names = [f"{c}{i}" for c in "ab" for i in range(BANDS)]
    px = pair.select("scene", "y", "x", *[F.get(c, F.lit(i)).alias(f"{c}{i}") for c in "ab" for i in range(BANDS)])
    return written(_seen(px, names), "pairs")


@query("win1_tiles_roughness", SQL["win1_roughness"])
def win1(spark: SparkSession, d: str) -> DataFrame:
    px = V.each_optical_sar(spark, d)
    rough = TF.roughness(T.partitioned(_seen(px, ["sar"], scenes=px.select("scene").distinct())), seen=True)
    return T.to_pixels(rough, ["rough", "seen"], only="seen").drop("seen").withColumn("rough", F.round("rough", 6))


@query("cmp1_win2_tiles_mask", SQL["cmp1_win2_cva_mask"])
def cmp1(spark, d):
    mask = TF.detect(_pairs(V.changed_pair(spark, d)))["mask"]
    return T.to_pixels(mask, ["m"], only="m").select("scene", "y", "x")


@query("cmp3_agg1_tiles_zonal", SQL["cmp3_agg1_map22_zonal"])
def cmp3(spark, d):
    return TF.detect(_pairs(V.changed_pair(spark, d)))["zonal"]


@query("agg6_agg7_tiles_thresholds", SQL["agg6_agg7_thresholds"])
def agg7(spark, d):
    c = TF.cuts(written(TF.distances(_pairs(V.pair(spark, d))), "distances"))
    return c.select("scene", *[F.round(n, 6).alias(n) for n in ("mu", "sigma", "threshold")])


@query("win3_tiles_opened_classes", SQL["win3_opened_classes"])
def win3(spark, d):
    """Classes as numbers, 0 being the unknown one."""
    names = [U.UNKNOWN, "water_body", "built_structure", "vegetation_or_cropland", "road_or_infrastructure", "bare_ground_or_soil"]
    k = U.classes(V.each_optical_sar(spark, d), I.H, I.WIDTH)
    k = k.withColumn("k", F.array_position(F.lit(names), F.col("class")).cast("int") - 1)
    opened = TF.opened_classes(T.partitioned(_seen(k, ["k"], "<i4")), seen=True)
    return T.to_pixels(opened, ["k", "seen"], only="seen").select("scene", "y", "x", F.element_at(F.lit(names), F.col("k").cast("int") + 1).alias("class"))


@query("map9_tiles_resize", SQL["map9_bilinear_resize"])
def map9(spark, d):
    small = TF.resize_bilinear(_seen(I.levels(spark, d), ["v"]), (20, 40), seen=True)
    return T.to_pixels(small, ["v", "seen"], only="seen").drop("seen").withColumn("v", F.col("v").cast("long"))


def _labels(spark, d):
    distance = written(TF.distances(_pairs(V.pair(spark, d))), "distances")
    return TL.components(written(TF.masks(distance, TF.cuts(distance)), "masks"))


@query("win4_tiles_components", SQL["win4_components"])
def win4(spark, d):
    return TL.label_pixels(_labels(spark, d)).withColumn("label", F.col("label").cast("int"))


@query("agg3_tiles_boxes", I._DIFF.replace("with px", "with recursive px", 1) + I.LABELS + " select scene, label::bigint as label, min(x)::bigint as x0, min(y)::bigint as y0, max(x)::bigint + 1 as x1, max(y)::bigint + 1 as y1, count(*) as pixels from la group by scene, label")
def agg3(spark, d):
    return TL.boxes(_labels(spark, d))


#: The second image's pixels are 7.5 wide and begin some 13 to the right of and 8 to 18 below the first one's, of 10.
_GRIDS = """g as (select scene, 100.0::double * scene as l1, 1000.0::double as t1, 100.0::double * scene + 12.5::double + 3.3::double * (scene % 4)::double as l2, 1000.0::double - 7.25::double - 5.1::double * (scene % 3)::double as t2 from (select distinct scene from px)),
b as (select *, greatest(l1, l2) as x0, least(l1 + 160, l2 + 120) as x1, greatest(t1 - 500, t2 - 375) as y0, least(t1, t2) as y1 from g),
wi as (select scene, l1, l2, t1, t2, x0, x1, y0, y1, floor((x0 - l1) / 10.0::double)::int as ox, floor((t1 - y1) / 10.0::double)::int as oy, floor((x1 - x0) / 10.0::double + 0.5::double)::int as w, floor((y1 - y0) / 10.0::double + 0.5::double)::int as h from b)"""


def _grids(spark, d) -> DataFrame:
    n = V.pixels(spark, d).select("scene").distinct()
    l1, t1 = F.col("scene") * 100.0, F.lit(1000.0)
    at = {"left1": l1, "top1": t1, "left2": l1 + 12.5 + 3.3 * (F.col("scene") % 4), "top2": t1 - 7.25 - 5.1 * (F.col("scene") % 3)}
    sizes = {"px1": 10.0, "py1": 10.0, "px2": 7.5, "py2": 7.5}
    counts = {"width1": I.WIDTH, "height1": I.H, "width2": I.WIDTH, "height2": I.H}
    return n.select("scene", *[v.alias(k) for k, v in at.items()], *[F.lit(v).alias(k) for k, v in {**sizes, **counts}.items()])


def _times(spark, d) -> tuple[DataFrame, DataFrame]:
    names = [f"b{i}" for i in range(BANDS)]
    p = V.pixels(spark, d).select("scene", "t", "y", "x", *[F.get("bands", F.lit(i)).alias(n) for i, n in enumerate(names)])
    scenes = p.select("scene").distinct()
    return tuple(_seen(p.where(F.col("t") == t), names, scenes=scenes) for t in (0, 1))


@query("jn1_win6_affine_warp", V.with_views("px") + ", " + _GRIDS + """, t as (select wi.*, p.y - oy as y, p.x - ox as x, p.bands as a, (t2 - t1 + oy * 10.0::double) / 7.5::double + (p.y - oy + 0.5::double) * (10.0::double / 7.5::double) as v, (l1 + ox * 10.0::double - l2) / 7.5::double + (p.x - ox + 0.5::double) * (10.0::double / 7.5::double) as u
  from px p join wi on wi.scene = p.scene and p.t = 0 and p.y >= oy and p.y < oy + h and p.x >= ox and p.x < ox + w),
n as (select t.scene, t.y, t.x, t.a, k.k as ky, l.l as kx, floor(v - 0.5::double)::int + k.k as sy, floor(u - 0.5::double)::int + l.l as sx, case k.k when 1 then v - 0.5::double - floor(v - 0.5::double) else 1 - (v - 0.5::double - floor(v - 0.5::double)) end * case l.l when 1 then u - 0.5::double - floor(u - 0.5::double) else 1 - (u - 0.5::double - floor(u - 0.5::double)) end as w, v >= 0 and v < 50 and u >= 0 and u < 16 as inside
  from t, (select unnest([0, 1]) as k) k, (select unnest([0, 1]) as l) l),
m as (select n.scene, n.y, n.x, any_value(n.a) as a, bool_or(inside) as inside, sum(w) filter (where q.y is not null) as w, """ + ", ".join(f"sum(w * q.bands[{i}]) as s{i}" for i in range(1, 5)) + """ from n left join px q on q.scene = n.scene and q.t = 1 and q.y = n.sy and q.x = n.sx group by n.scene, n.y, n.x)
select scene, y::int as y, x::int as x, """ + ", ".join(f"a[{i}] as a{i}" for i in range(1, 5)) + ", " + ", ".join(f"round(case when inside and w > 0 then s{i} / w else 0 end, 6) as b{i}" for i in range(1, 5)) + " from m")
def jn1(spark, d):
    """All bands of the second time on the first one's grid, over the ground that both show."""
    pairs, _ = WP.aligned(*_times(spark, d), _grids(spark, d), layers=BANDS, seen=True)
    a, b = [f"a{i + 1}" for i in range(BANDS)], [f"b{i + 1}" for i in range(BANDS)]
    return T.to_pixels(pairs, [*a, "seen", *b], only="seen").select("scene", "y", "x", *a, *[F.round(c, 6).alias(c) for c in b])


@query("jn1_win6_windows", V.with_views("px") + ", " + _GRIDS + " select scene, ox, oy, w, h, round((x1 - x0) * (y1 - y0) / 80000.0::double, 4) as share1, round((x1 - x0) * (y1 - y0) / 45000.0::double, 4) as share2 from wi where x0 < x1 and y0 < y1 and w > 0 and h > 0")
def jn1_windows(spark, d):
    w = WP.windows(_grids(spark, d))
    return w.select("scene", F.col("off_x").alias("ox"), F.col("off_y").alias("oy"), F.col("new_width").alias("w"), F.col("new_height").alias("h"), "share1", "share2")


@query("win5_win6_tiles_spectrum")
def win5(spark, d):
    """Every band's pairs of times, phase-correlated in bands of lines and of columns; with the shared ground known, half of each."""
    a = V.pair(spark, d).select("scene", "y", "x", F.posexplode("a").alias("i", "one"), "b")
    a = a.select((F.col("scene") * BANDS + F.col("i")).alias("scene"), "y", "x", "one", F.get("b", F.col("i")).alias("two"))
    s = SP.shifts(written(_tiles(a, ["one", "two"]), "pairs"))
    share = WP.windows(_grids(spark, d)).select(F.col("scene").alias("of"), F.least("share1", "share2").alias("share"))
    s = s.join(share, F.floor(F.col("scene") / BANDS) == F.col("of"), "left")
    score = F.when(F.col("share").isNotNull(), F.greatest(F.lit(0.10), 0.5 * F.col("score") + 0.5 * F.col("share"))).otherwise(F.col("score"))
    return s.select("scene", "dy", "dx", F.round(score, 4).alias("score"), WP.grade(score).alias("grade"))


@query("udf1_change_statistics", V.with_views("pair") + I.difference_sql("pair", I.H, I.WIDTH, BANDS) + ", cc as (select scene, count(*) as n from rw group by scene), tt as (select scene, count(*) as total, max(d) as top from df group by scene) select scene, total, coalesce(n, 0) as changed, round(coalesce(n, 0)::double / total * 100.0::double, 4) as ratio_pct, round(top, 6) as largest from tt left join cc using (scene)")
def udf1_change(spark, d):
    """The change specialist as a function of SQL, over the scenes' tiles."""
    FN.register(spark)
    distance = written(TF.distances(_pairs(V.pair(spark, d))), "distances")
    TF.with_scene(distance, TF.cuts(distance)).createOrReplaceTempView("udf1_distances")
    return spark.sql("select scene, total, changed, round(ratio_pct, 4) as ratio_pct, round(largest, 6) as largest from change_statistics(table(select * from udf1_distances) partition by scene)")


@query("udf1_udf7_class_shares", I._CLS + ", n as (select scene, class, count(*) as pixels from k group by all) select scene, class, pixels, round(pixels::double / (sum(pixels) over (partition by scene))::double * 100.0::double, 2) as pct from n")
def udf1_classes(spark, d):
    """The fusion specialist alike, over the scenes' tiles of class numbers."""
    FN.register(spark)
    names = F.lit([U.UNKNOWN, *FN.CLASSES])
    k = U.classes(V.each_optical_sar(spark, d), I.H, I.WIDTH)
    k = k.withColumn("k", F.array_position(names, F.col("class")).cast("int") - 1)
    written(_seen(k, ["k"], "<i4"), "classes").createOrReplaceTempView("udf1_classes")
    return spark.sql("select scene, class, pixels, round(pct, 2) as pct from class_shares(table(select * from udf1_classes) partition by scene)")
