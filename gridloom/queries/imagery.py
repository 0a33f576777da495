"""Pixels, pairs, morphology, components, cross-modal classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import boxes as B
from ..functions import pixels as P
from ..operators import alignment as A
from ..operators import change as CH
from ..operators import fusion as U
from ..operators import percentiles as PC
from . import query

H, WIDTH = 50, 16
_b = lambda i: F.get("bands", F.lit(i))


@query("map1_rgb", V.with_views("px") + " select scene, t, y, x, bands[1] as r, bands[2] as g, bands[3] as b from px")
def map1(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d).withColumn("rgb", P.rgb(F.col("bands")))
    return p.select("scene", "t", "y", "x", *[F.get("rgb", F.lit(i)).alias(n) for i, n in enumerate("rgb")])


_ALL = V.with_views("px") + ", v as (select scene, t, i.i as band, y, x, bands[i.i] as v from px, (select unnest([1, 2, 3, 4]) as i) i), q as (select scene, t, band, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from v group by scene, t, band)"


def _stretched(spark, d):
    """Every band's values beside its two percentiles."""
    p = V.pixels(spark, d).select("scene", "t", "y", "x", F.posexplode("bands").alias("band", "v")).withColumn("band", F.col("band") + 1)
    q = PC.exact_percentiles(p, ["scene", "t", "band"], "v", [0.02, 0.98])
    return p.join(q, ["scene", "t", "band"]), F.get("q", F.lit(0)), F.get("q", F.lit(1))


@query("map2_stretch", _ALL + " select scene, t, band, y, x, case when hi > lo then least(greatest(floor(round((v - lo) / (hi - lo) * 255.0::double, 9)), 0), 255) else floor(least(greatest(v, 0), 255)) end::int as u8 from v join q using (scene, t, band)")
def map2(spark, d):
    p, low, high = _stretched(spark, d)
    return p.select("scene", "t", "band", "y", "x", P.stretch(F.col("v"), low, high).alias("u8"))


@query("map3_map4_map5_normalised", V.with_views("px") + """, m as (select scene, t, max(list_max(bands)) as m from px group by scene, t), v as (select scene, t, y, x, bands[1] / case when m > 1 then m else 1 end as r, bands[2] / case when m > 1 then m else 1 end as g, bands[3] / case when m > 1 then m else 1 end as b from px join m using (scene, t))
select scene, t, y, x, round((r - 0.485::double) / 0.229::double, 9) as r, round((g - 0.456::double) / 0.224::double, 9) as g, round((b - 0.406::double) / 0.225::double, 9) as b, round((r + g + b) / 3.0::double, 9) as grey, round(r * 0.2989::double + g * 0.5870::double + b * 0.1140::double, 9) as luma from v""")
def map3(spark, d):
    p = V.pixels(spark, d)
    m = p.groupBy("scene", "t").agg(F.max(F.array_max("bands")).alias("m"))
    p = p.join(m, ["scene", "t"]).select("scene", "t", "y", "x", *[P.by_scene_max(_b(i), F.col("m")).alias(n) for i, n in enumerate("rgb")])
    c = [F.col(n) for n in "rgb"]
    return p.select(
        "scene",
        "t",
        "y",
        "x",
        *[F.round(P.standardized(c[i], i), 9).alias(n) for i, n in enumerate("rgb")],
        F.round(P.grey_mean(*c), 9).alias("grey"),
        F.round(P.grey_luma(*c), 9).alias("luma"),
    )


_IX = "case when {g} * 2.0::double + r + b > 1e-6::double then {g} * 2.0::double + r + b else 1e-6::double end"


@query("map6_indices", V.with_views("ost") + """ select scene, y, x, (2.0::double * g - r - b) / greatest(2.0::double * g + r + b, 1e-6::double) as exg, greatest(r, g, b) as lightness, b / greatest(r + g + b, 1e-6::double) as blue_ratio, r / greatest(r + g + b, 1e-6::double) as red_ratio from os""")
def map6(spark, d):
    p = V.each_optical_sar(spark, d)
    return p.select("scene", "y", "x", *[v.alias(k) for k, v in P.indices(F.col("r"), F.col("g"), F.col("b")).items()])


@query("map7_map8_unit_range", _ALL + " select scene, t, band, y, x, round(least(greatest(case when hi > lo then (v - lo) / (hi - lo) else v end, 0.0::double), 1.0::double), 9) as u from v join q using (scene, t, band)")
def map7(spark, d):
    p, low, high = _stretched(spark, d)
    return p.select("scene", "t", "band", "y", "x", F.round(P.unit(F.col("v"), low, high), 9).alias("u"))


def levels(spark: SparkSession, d: str) -> DataFrame:
    """scene, y, x, v: each band of each time as a scene of whole numbers."""
    p = V.pixels(spark, d).select("scene", "t", "y", "x", F.posexplode("bands").alias("i", "u"))
    return p.select(((F.col("scene") * 2 + F.col("t")) * 4 + F.col("i")).alias("scene"), "y", "x", F.floor((F.col("u") + 1.0) * 127.0).alias("v"))


_TRI = lambda n, m: f"(select i, s, greatest(0.0::double, 1.0::double - abs((s + 0.5::double - (i + 0.5::double) * {n / m}::double) / {max(1.0, n / m)}::double)) as k from (select unnest(range({m})) as i) a, (select unnest(range({n})) as s) b where s >= floor((i + 0.5::double) * {n / m}::double - {max(1.0, n / m)}::double + 0.5::double) and s < floor((i + 0.5::double) * {n / m}::double + {max(1.0, n / m)}::double + 0.5::double))"


@query("map9_bilinear_resize", V.with_views("px") + f""", v as (select (scene * 2 + t) * 4 + i.i as scene, y, x, floor((bands[i.i + 1] + 1.0::double) * 127.0::double) as v from px, (select unnest([0, 1, 2, 3]) as i) i), wx as {_TRI(16, 40)}, wy as {_TRI(50, 20)},
hz as (select scene, y, i as x, floor(round(sum(v * k) / sum(k), 9) + 0.5::double) as v from v join wx on wx.s = v.x group by scene, y, i)
select scene, i::int as y, x::int as x, floor(round(sum(v * k) / sum(k), 9) + 0.5::double)::bigint as v from hz join wy on wy.s = hz.y group by scene, i, x""")
def map9(spark, d):
    """All bands of both times of every scene from 50 x 16 to 20 x 40: one side smaller, one larger."""
    return A.resize_bilinear(levels(spark, d), (H, WIDTH), (20, 40))


@query("map9_nearest_mask_resize", V.with_views("px") + """, g as (select y.y::int as y, x.x::int as x, floor((y.y + 0.5::double) * 50 / 25)::int as sy, floor((x.x + 0.5::double) * 16 / 32)::int as sx from (select unnest(range(25)) as y) y, (select unnest(range(32)) as x) x)
select px.scene, px.t, g.y, g.x, px.bands[1] > 0 as v from g join px on px.y = g.sy and px.x = g.sx""")
def map9_nearest(spark, d):
    """Masks: each target pixel takes its source pixel, by arithmetic and an equi-join, the grid being bounded by the image."""
    g = spark.range(25 * 32).select(F.floor(F.col("id") / 32).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("x"))
    g = g.select(
        F.col("y").alias("ty"),
        F.col("x").alias("tx"),
        F.floor((F.col("y") + 0.5) * 50 / 25).cast("int").alias("y"),
        F.floor((F.col("x") + 0.5) * 16 / 32).cast("int").alias("x"),
    )
    return V.pixels(spark, d).join(g, ["y", "x"]).select(
        "scene",
        "t",
        F.col("ty").alias("y"),
        F.col("tx").alias("x"),
        (_b(0) > 0).alias("v"),
    )


@query("map23_centre_crop", V.with_views("px") + " select scene, t, (y - 19)::int as y, (x - 2)::int as x, bands[1] as b1, bands[2] as b2, bands[3] as b3, bands[4] as b4 from px where y >= 19 and y < 31 and x >= 2 and x < 14")
def map23(spark, d):
    inside, y, x = B.centre_crop(F.col("y"), F.col("x"), H, WIDTH, 12)
    return V.pixels(spark, d).where(inside).select("scene", "t", y.alias("y"), x.alias("x"), *[_b(i).alias(f"b{i + 1}") for i in range(4)])


@query("map18_overlay", V.with_views("px") + " select scene, t, y, x, floor(least(greatest(bands[1], 0), 1) * 255.0::double * 0.5::double + 255.0::double * 0.5::double)::int as red from px")
def map18(spark, d):
    return V.pixels(spark, d).select(
        "scene",
        "t",
        "y",
        "x",
        P.blend(F.least(F.greatest(_b(0), F.lit(0.0)), F.lit(1.0)) * 255.0, 255.0, 0.5).alias("red"),
    )


@query("jn1_jn2_aligned_grid", V.with_views("px") + """ select p.scene, p.y, p.x, p.bands[1] as a1, p.bands[2] as a2, p.bands[3] as a3, p.bands[4] as a4, q.bands[1] as b1, q.bands[2] as b2, q.bands[3] as b3, q.bands[4] as b4 from px p join px q on p.scene = q.scene and p.y = q.y + 3 and p.x = q.x + 2 where p.t = 0 and q.t = 1""")
def jn1(spark, d):
    """Grids of equal pixels whose origins differ by whole pixels (3 lines, 2 columns): an equi-join on the shifted index."""
    p = V.pixels(spark, d)
    q = p.where("t = 1").select("scene", (F.col("y") + 3).alias("y"), (F.col("x") + 2).alias("x"), *[_b(i).alias(f"b{i + 1}") for i in range(4)])
    return p.where("t = 0").select("scene", "y", "x", *[_b(i).alias(f"a{i + 1}") for i in range(4)]).join(q, ["scene", "y", "x"])


def difference_sql(pair: str, height: int, width: int, bands: int) -> str:
    """The tables of change detection over one of aligned pairs: df (difference), st, th (threshold), rw (raw mask), cl (cleaned mask)."""
    sum_ = " + ".join(f"(b[{i}]/mb-a[{i}]/ma)*(b[{i}]/mb-a[{i}]/ma)" for i in range(1, bands + 1))
    return (
        _STEPS.replace("from pair", f"from {pair}").replace("[[sum]]", sum_).replace("[[h]]", str(height - 1)).replace("[[w]]", str(width - 1))
    )


_STEPS = """, m as (select scene, case when max(list_max(a)) > 1 then max(list_max(a)) else 1 end as ma, case when max(list_max(b)) > 1 then max(list_max(b)) else 1 end as mb from pair group by scene),
dd as (select scene, y, x, sqrt([[sum]]) as d from pair join m using (scene)),
df as (select scene, y, x, d / greatest(max(d) over (partition by scene), 1e-6::double) as d from dd),
st as (select scene, avg(d) as mu, stddev_pop(d) as sigma from df group by scene),
hi as (select scene, least(floor(d * 128), 127)::bigint as bin, count(*) as n from df group by 1, 2),
cu as (select scene, bin, sum(n) over r as w0, sum(bin * n) over r as s0, sum(n) over (partition by scene) as w, sum(bin * n) over (partition by scene) as s from hi window r as (partition by scene order by bin)),
bt as (select scene, bin, w0::double * (w - w0)::double * (s0::double / w0::double - (s - s0)::double / (w - w0)::double) * (s0::double / w0::double - (s - s0)::double / (w - w0)::double) as v from cu where w0 < w),
ot as (select scene, first(bin order by v desc, bin) as bin from bt group by scene),
th as (select st.scene, mu, sigma, greatest(0.15::double, least(0.65::double, case when mu > 0.10 and sigma > 0.08 then coalesce((bin + 0.5::double) / 128, 0.35::double) else mu + 1.5::double * sigma end)) as threshold from st left join ot using (scene)),
rw as (select df.scene, df.y, df.x from df join th using (scene) where d >= threshold),
nb as (select unnest([-1, 0, 1]) as k), n9 as (select a.k as dy, b.k as dx from nb a, nb b),
e1 as (select scene, (y + dy)::int as y, (x + dx)::int as x from rw, n9 group by 1, 2, 3 having count(*) = 9),
d1 as (select distinct scene, (y + dy)::int as y, (x + dx)::int as x from e1, n9 where y + dy between 0 and [[h]] and x + dx between 0 and [[w]]),
d2 as (select distinct scene, (y + dy)::int as y, (x + dx)::int as x from d1, n9 where y + dy between 0 and [[h]] and x + dx between 0 and [[w]]),
cl as (select scene, (y + dy)::int as y, (x + dx)::int as x from d2, n9 group by 1, 2, 3 having count(*) = 9)"""


_DIFF = V.with_views("pair") + difference_sql("pair", H, WIDTH, 4)
CHANGED = V.with_views("cpair") + difference_sql("cpair", H, WIDTH, 4)


@query(
    "agg6_agg7_thresholds",
    _DIFF + " select scene, round(mu, 6) as mu, round(sigma, 6) as sigma, round(threshold, 6) as threshold from th",
)
def agg7(spark, d):
    t = CH.thresholds(CH.difference(V.pair(spark, d)))
    return t.select("scene", *[F.round(c, 6).alias(c) for c in ("mu", "sigma", "threshold")])


@query("map21_raw_mask", _DIFF + " select scene, y, x from rw")
def map21(spark, d):
    diff = CH.difference(V.pair(spark, d))
    return CH.raw_mask(diff, CH.thresholds(diff)).select("scene", "y", "x")


@query("cmp1_win2_cva_mask", CHANGED + " select scene, y, x from cl")
def cmp1(spark, d):
    return CH.detect(V.changed_pair(spark, d), H, WIDTH)["mask"]


@query("cmp3_agg1_map22_zonal", CHANGED + """, tt as (select scene, count(*) as total from df group by scene), cc as (select scene, count(*) as changed from cl group by scene)
select scene, total, coalesce(changed, 0)::bigint as changed, round(coalesce(changed, 0)::double / total * 100.0::double, 4) as ratio_pct, round(coalesce(changed, 0) * 100.0::double, 2) as area_m2, round(coalesce(changed, 0) * 100.0::double / 10000.0::double, 4) as area_ha,
case when coalesce(changed, 0) = 0 then 'no_change' when round(changed::double / total * 100.0::double, 4) >= 98 then 'full_image' when round(changed::double / total * 100.0::double, 4) >= 50 then 'extreme' end as warning from tt left join cc using (scene)""")
def cmp3(spark, d):
    return CH.detect(V.changed_pair(spark, d), H, WIDTH)["zonal"]


@query("cmp2_neural_fallback", CHANGED + """, ne as (select scene, y, x from df where scene % 2 = 1 and d >= 0.9), n1 as (select scene, count(*) as n from ne group by scene), n2 as (select scene, count(*) as n from cl group by scene), n3 as (select scene, count(*) as n from cpair where a <> b group by scene),
us as (select n3.scene from n3 join n2 using (scene) left join n1 using (scene) where n3.n >= 16 and n2.n >= 16 and coalesce(n1.n, 0) < 16)
select scene, y, x, 'neural' as source from ne where scene not in (select scene from us) union all select scene, y, x, 'cva' from cl where scene in (select scene from us)""")
def cmp2(spark, d):
    """A detector that sees only the strongest differences, and only in odd scenes, stands for the neural one."""
    pair = V.changed_pair(spark, d)
    o = CH.detect(pair, H, WIDTH)
    neural = o["difference"].where("scene % 2 = 1 and d >= 0.9").select("scene", "y", "x")
    return CH.with_fallback(neural, o["mask"], pair)


LABELS = """, fg as (select scene, y, x, y * 16 + x as id from rw), ed as (select a.scene, a.id as i, b.id as j from fg a join fg b on a.scene = b.scene and abs(a.y - b.y) + abs(a.x - b.x) = 1),
re(scene, i, j) as (select scene, id, id from fg union select re.scene, re.i, ed.j from re join ed on ed.scene = re.scene and ed.i = re.j),
lb as (select scene, i, min(j) as root from re group by scene, i), la as (select scene, (i // 16)::int as y, (i % 16)::int as x, dense_rank() over (partition by scene order by root)::int as label from lb)"""


def _labelled(spark, d):
    diff = CH.difference(V.pair(spark, d))
    return CH.components(CH.raw_mask(diff, CH.thresholds(diff)), WIDTH), diff


@query("cmp7_nothing_to_interpret", CHANGED.replace("with px", "with recursive px", 1) + LABELS.replace("from rw", "from cl") + """, rg as (select scene, count(*) as n from (select scene, label from la group by scene, label having count(*) >= 16) group by scene), cc as (select scene, count(*) as n from cl group by scene), tt as (select distinct scene from df)
select scene, coalesce(cc.n, 0)::bigint as changed, coalesce(rg.n, 0)::bigint as regions, coalesce(cc.n, 0) = 0 or coalesce(rg.n, 0) = 0 as still from tt left join cc using (scene) left join rg using (scene)""")
def cmp7(spark, d):
    """Whether the interpreting model is skipped, from the cleaned mask and its regions."""
    o = CH.detect(V.changed_pair(spark, d), H, WIDTH)
    r = CH.regions(
        CH.components(o["mask"], WIDTH),
        o["difference"],
        most=H * WIDTH,
    ).groupBy("scene").agg(F.count(F.lit(1)).alias("regions"))
    t = o["zonal"].select("scene", "changed").join(r, "scene", "left").fillna(0, ["regions"])
    return t.withColumn("still", CH.is_still(F.col("changed"), F.col("regions")))


@query("win4_components", _DIFF.replace("with px", "with recursive px", 1) + LABELS + " select scene, y, x, label from la")
def win4(spark, d):
    return _labelled(spark, d)[0]


@query("agg3_flt13_regions", _DIFF.replace("with px", "with recursive px", 1) + LABELS + """, rg as (select scene, label, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1, count(*) as pixels from la group by scene, label),
rk as (select *, row_number() over (partition by scene order by label) as k from rg), ok as (select * from rk where k <= 50 and pixels >= 4)
select ok.scene, label, x0, y0, x1, y1, pixels, round(avg(d), 4) as mean_d from ok join df on df.scene = ok.scene and df.y >= y0 and df.y < y1 and df.x >= x0 and df.x < x1 group by ok.scene, label, x0, y0, x1, y1, pixels""")
def agg3(spark, d):
    labelled, diff = _labelled(spark, d)
    return CH.regions(labelled, diff, least=4)


@query("srt1_primary_region", _DIFF.replace("with px", "with recursive px", 1) + LABELS + ", rg as (select scene, label, count(*) as pixels from la group by scene, label) select scene, first(label order by pixels desc, label) as label, max(pixels) as pixels from rg group by scene")
def srt1(spark, d):
    r = _labelled(spark, d)[0].groupBy("scene", "label").agg(F.count(F.lit(1)).alias("pixels"))
    return r.groupBy("scene").agg(F.max_by("label", F.struct("pixels", -F.col("label"))).alias("label"), F.max("pixels").alias("pixels"))


_ROUGH = """, mx as (select i.i as i, case when i.i + k.k < 0 then -1 - i.i - k.k when i.i + k.k > {n} - 1 then 2 * {n} - 1 - i.i - k.k else i.i + k.k end as j from (select unnest(range({n})) as i) i, (select unnest([-2, -1, 0, 1, 2]) as k) k)"""
_RO_STEPS = _ROUGH.format(n=16).replace("mx", "wx") + _ROUGH.format(n=50).replace("mx", "wy") + """, r1 as (select scene, y, wx.i as x, sum(sar) as s, sum(sar * sar) as q from os join wx on wx.j = os.x group by 1, 2, 3),
r2 as (select scene, wy.i as y, x, sum(s) as s, sum(q) as q from r1 join wy on wy.j = r1.y group by 1, 2, 3), ro as (select scene, y::int as y, x::int as x, sqrt(greatest(0, q / 25.0::double - (s / 25.0::double) * (s / 25.0::double))) as rough from r2)"""


_RO = V.with_views("ost") + _RO_STEPS


@query("win1_roughness", _RO + " select scene, y, x, round(rough, 6) as rough from ro")
def win1(spark, d):
    return CH.roughness(V.each_optical_sar(spark, d), H, WIDTH).select("scene", "y", "x", F.round("rough", 6).alias("rough"))


CLASS_STEPS = _RO_STEPS + """, f as (select os.*, round(rough, 6) as rough, (2.0::double * g - r - b) / greatest(2.0::double * g + r + b, 1e-6::double) as exg, greatest(r, g, b) as l, b / greatest(r + g + b, 1e-6::double) as br, r / greatest(r + g + b, 1e-6::double) as rr from os join ro using (scene, y, x)),
k as (select scene, y, x, r, g, b, sar, rough, case when (br >= 0.36 or l <= 0.25) and sar <= 0.20 and rough <= 0.08 then 'water_body' when exg < 0.06 and l >= 0.20 and (sar >= 0.50 or (sar >= 0.30 and rough >= 0.12)) then 'built_structure'
when exg >= 0.06 and g > r and sar >= 0.15 and sar <= 0.75 then 'vegetation_or_cropland' when abs(r - g) < 0.08 and abs(g - b) < 0.08 and l >= 0.20 and l <= 0.85 and sar <= 0.25 and rough <= 0.08 then 'road_or_infrastructure'
when r > g and g >= b and rr >= 0.34 and sar >= 0.15 and sar <= 0.50 and rough <= 0.12 then 'bare_ground_or_soil' else 'unknown' end as class from f)"""


_CLS = V.with_views("ost") + CLASS_STEPS


def _classes(spark, d):
    return U.classes(V.each_optical_sar(spark, d), H, WIDTH)


@query("cmp4_classes", _CLS + " select scene, y, x, class from k")
def cmp4(spark, d):
    return _classes(spark, d).select("scene", "y", "x", "class")


@query("win3_opened_classes", _CLS + """, n4 as (select unnest([0, 0, 1, 1]) as dy, unnest([0, 1, 0, 1]) as dx), m as (select scene, y, x, class from k where class <> 'unknown'),
e as (select scene, class, (y - dy)::int as y, (x - dx)::int as x from m, n4 group by all having count(*) = 4), o as (select distinct scene, class, (y + dy)::int as y, (x + dx)::int as x from e, n4)
select k.scene, k.y, k.x, coalesce(o.class, 'unknown') as class from k left join o on o.scene = k.scene and o.y = k.y and o.x = k.x and o.class = k.class""")
def win3(spark, d):
    """All classes opened at once, the class being part of the key."""
    k = _classes(spark, d).select("scene", "y", "x", "class")
    key = k.where("class <> 'unknown'").withColumn("scene", F.struct("scene", "class"))
    kept = CH.opened_2x2(key, H, WIDTH).select("scene.scene", F.col("scene.class").alias("kept"), "y", "x")
    return k.join(kept, ["scene", "y", "x"], "left").select(
        "scene",
        "y",
        "x",
        F.when(F.col("kept") == F.col("class"), F.col("class")).otherwise("unknown").alias("class"),
    )


@query("agg2_class_histogram", _CLS + """, dim as (select unnest(['water_body', 'built_structure', 'vegetation_or_cropland', 'road_or_infrastructure', 'bare_ground_or_soil', 'unknown']) as class), sc as (select scene, count(*) as total from k group by scene), n as (select scene, class, count(*) as n from k group by all)
select sc.scene, dim.class, coalesce(n, 0)::bigint as pixels, round(coalesce(n, 0)::double / total * 100.0::double, 2) as pct, round(coalesce(n, 0) * 100.0::double, 1) as area_m2 from sc cross join dim left join n on n.scene = sc.scene and n.class = dim.class""")
def agg2(spark, d):
    """All six classes of each scene, by a pivot with its values given: one shuffle."""
    names = ["water_body", "built_structure", "vegetation_or_cropland", "road_or_infrastructure", "bare_ground_or_soil", "unknown"]
    wide = _classes(spark, d).groupBy("scene").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("class") == n).alias(n) for n in names],
    )
    rows = wide.select(
        "scene",
        "total",
        F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).alias("pixels")) for n in names])).alias("c"),
    )
    return rows.select(
        "scene",
        "c.class",
        "c.pixels",
        F.round(F.col("c.pixels") / F.col("total") * 100.0, 2).alias("pct"),
        F.round(F.col("c.pixels") * 100.0, 1).alias("area_m2"),
    )


@query("agg4_agg5_srt3_class_evidence", _CLS + " select scene, class, count(*) as pixels, round(avg(r), 4) as r, round(avg(g), 4) as g, round(avg(b), 4) as b, round(avg(sar), 4) as sar, round(avg(rough), 4) as rough from k where class <> 'unknown' group by all")
def agg4(spark, d):
    return _classes(spark, d).where("class <> 'unknown'").groupBy("scene", "class").agg(
        F.count(F.lit(1)).alias("pixels"),
        *[F.round(F.avg(c), 4).alias(c) for c in ("r", "g", "b", "sar", "rough")],
    )


@query("srt4_predominant_class", _CLS + ", n as (select scene, class, count(*) as n from k group by all) select scene, first(class order by n desc, class) as class from n group by scene")
def srt4(spark, d):
    n = _classes(spark, d).groupBy("scene", "class").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("scene").agg(F.min_by("class", F.struct(-F.col("n"), "class")).alias("class"))


@query("cmp5_fusion_confidence", _CLS + """, p as (select scene, case class when 'water_body' then 0.92 when 'built_structure' then 0.88 when 'vegetation_or_cropland' then 0.89 when 'road_or_infrastructure' then 0.82 when 'bare_ground_or_soil' then 0.85 else 0.5 end::double as p from k) select scene, round(least(greatest(avg(p), 0.60::double), 0.95::double), 4) as confidence from p group by scene""")
def cmp5(spark, d):
    return U.confidence(_classes(spark, d))


@query("cmp6_complementarity", _CLS + """, n as (select scene, count_if(class = 'built_structure') as built, count_if(class = 'water_body') as water from k group by scene)
select scene, built, water, printf('Both sensors together show %d pixels of buildings, by double bounce, and %d of open water, by its smooth surface.', built, water) as contrast, 'Optical:spectral,SAR:structural,Fused:cross_modal' as layers from n""")
def cmp6(spark, d):
    """The report by scene; the layers as text."""
    c = U.complementarity(_classes(spark, d))
    return c.withColumn("layers", F.concat_ws(",", F.transform("layers", lambda x: F.concat(x["name"], F.lit(":"), x["role"]))))


_REGIONS = """, fg as (select scene, class, y, x, y * 16 + x as id from k where class <> 'unknown'), ed as (select a.scene, a.class, a.id as i, b.id as j from fg a join fg b on a.scene = b.scene and a.class = b.class and abs(a.y - b.y) + abs(a.x - b.x) = 1),
re(scene, class, i, j) as (select scene, class, id, id from fg union select re.scene, re.class, re.i, ed.j from re join ed on ed.scene = re.scene and ed.class = re.class and ed.i = re.j),
lb as (select scene, class, i, min(j) as root from re group by all), la as (select scene, class, (i // 16)::int as y, (i % 16)::int as x, dense_rank() over (partition by scene, class order by root)::int as label from lb),
pk as (select k.*, case class when 'water_body' then 0.92 when 'built_structure' then 0.88 when 'vegetation_or_cropland' then 0.89 when 'road_or_infrastructure' then 0.82 else 0.85 end::double as prob from k)"""


@query("agg4_region_evidence", _CLS.replace("with px", "with recursive px", 1) + _REGIONS + """ select la.scene, la.class, label, min(la.x) as x0, min(la.y) as y0, max(la.x) + 1 as x1, max(la.y) + 1 as y1, count(*) as pixels, round(avg(prob), 12) as confidence, round(avg(sar), 12) as sar, round(avg(rough), 12) as rough, round(count(*) / 800.0::double * 100.0::double, 3) as coverage_pct
from la join pk on pk.scene = la.scene and pk.y = la.y and pk.x = la.x group by la.scene, la.class, label having count(*) >= 2""")
def agg4_regions(spark, d):
    """Regions of two pixels and more, as noise has few that are larger; all of them."""
    r = U.class_regions(_classes(spark, d), H, WIDTH, least=2, most=H * WIDTH, digits=12)
    return r.select("scene", "class", "label", "x0", "y0", "x1", "y1", "pixels", "confidence", "sar", "rough", "coverage_pct")


@query("win7_tiles_with_overlap", V.with_views("px") + """, b as (select (scene * 2 + t) * 4 + i.i as scene, y, x, bands[i.i + 1] as u from px, (select unnest([0, 1, 2, 3]) as i) i), t as (select unnest([0, 20, 30]) as o), m as (select scene, o, avg(u) as m from b, t where y >= o and y < o + 20 group by all) select b.scene, b.y, b.x, round(avg(u - m), 6) as v from b join t on b.y >= o and b.y < o + 20 join m on m.scene = b.scene and m.o = t.o group by all""")
def win7(spark, d):
    """Tiles of 20 x 20 (16 columns wide, as the image is), the last re-anchored to the edge; the model takes each tile's mean off its pixels."""
    p = V.pixels(spark, d).select("scene", "t", "y", "x", F.posexplode("bands").alias("i", "u"))
    p = p.select(((F.col("scene") * 2 + F.col("t")) * 4 + F.col("i")).alias("scene"), "y", "x", "u")

    def model(tiles):
        key = ["scene", "ty", "tx"]
        return tiles.join(tiles.groupBy(*key).agg(F.avg("u").alias("m")), key).withColumn("v", F.col("u") - F.col("m"))

    return A.tiled(p, H, WIDTH, 20, model).withColumn("v", F.round("v", 6))


@query("win8_whole_tiles", V.with_views("px") + """, v as (select scene * 2 + t as scene, y, x, bands[1] as v, bands[2] > 0.2 as m from px where y < 48 and x < 12), t as (select scene, (y // 12)::bigint as ty, (x // 6)::bigint as tx, count(*) as pixels, count(*) filter (where m) as changed, round(max(v), 6) as top from v group by all),
k as (select *, changed >= 3 as keep, row_number() over (partition by scene, changed >= 3 order by ty, tx) as n from t) select scene, ty, tx, pixels, changed, top from k where keep or n <= 2""")
def win8(spark, d):
    """Tiles that don't overlap, those with change and a few without; what is left over at the edges is dropped."""
    p = V.pixels(spark, d).select((F.col("scene") * 2 + F.col("t")).alias("scene"), "y", "x", _b(0).alias("v"), (_b(1) > 0.2).alias("changed"))
    t = A.training_tiles(p, H, WIDTH, (12, 6), least_changed=3, most_still=2, measures={"top": F.round(F.max("v"), 6)})
    return t.select("scene", "ty", "tx", "pixels", "changed", "top")
