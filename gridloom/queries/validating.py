"""Pair validation over orders, whose keys give every case of a header; gated answers; thresholds; evidence look-up; reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import benchmark as BE
from ..operators import change as CH
from ..operators import evidence as E
from ..operators import scoring as S
from ..operators import validation as VA
from ..store import written
from . import imagery as I
from . import query

_HEADS = """h as (select o_orderkey as k, o_orderkey % 41 <> 0 as f1, o_orderkey % 43 <> 0 as f2, case when o_orderkey % 37 = 0 then 'corrupted' end as e1, case when o_orderkey % 31 = 0 then 'unsupported' end as e2,
case when o_orderkey % 5 = 0 then null when o_orderkey % 47 = 0 then 'None' else 'EPSG:32643' end as c1, case when o_orderkey % 23 = 0 then 'EPSG:4326' when o_orderkey % 13 = 0 then '' else 'EPSG:32643' end as c2,
case when o_orderkey % 29 = 0 then 0 when o_orderkey % 9 = 0 then 12 else 400 end as w1, 400 + (o_orderkey % 3) * 20 as w2, 3 + o_orderkey % 2 as n1, 10.0::double + (o_orderkey % 4)::double * 0.5::double as r2, (o_orderkey % 50)::double * 90.0::double as s,
o_orderkey % 17 <> 0 as t1, o_orderkey % 19 <> 0 as t2, (o_orderkey % 20)::double / 20.0::double as score, case when o_orderkey % 6 <> 0 then o_orderdate end as d1, case when o_orderkey % 4 <> 0 then timestamp '1996-01-01' end as d2,
['optical', 'sar', 'multispectral', 'thermal'][o_orderkey % 4 + 1] as m1, ['optical', 'sar', 'sar'][o_orderkey // 4 % 3 + 1] as m2 from orders),
g as (select *, case when s < 4000 then round((4000 - s) / 4000, 4) end as share, coalesce(lower(c1) not in ('', 'none', 'null'), false) as g1, coalesce(lower(c2) not in ('', 'none', 'null'), false) as g2 from h),
q as (select *, g1 and g2 as mapped from g)"""


def _heads(spark, d):
    k = F.col("o_orderkey")
    every = lambda n: k % n == 0
    pick = lambda vs, at: F.element_at(F.array(*map(F.lit, vs)), (at % len(vs) + 1).cast("int"))
    grid = lambda ok: F.when(ok, F.array(*map(F.lit, (10.0, 0.0, 0.0, 0.0, -10.0, 0.0))))
    shift = (k % 50).cast("double") * 90.0
    box = lambda x: F.array(x, F.lit(0.0), x + 4000.0, F.lit(3000.0))
    one = {
        "found": ~every(41), "filename": F.lit("a.tif"), "error_kind": F.when(every(37), "corrupted"), "width": F.when(every(29), 0).when(every(9), 12).otherwise(400), "height": F.lit(300),
        "n_bands": (3 + k % 2).cast("int"), "crs": F.when(every(5), None).when(every(47), "None").otherwise("EPSG:32643"), "transform": grid(~every(17)), "bounds": box(F.lit(0.0)),
        "resolution": F.array(F.lit(10.0), F.lit(10.0)), "modality": pick(("optical", "sar", "multispectral", "thermal"), k), "date": F.when(~every(6), F.col("o_orderdate").cast("timestamp")),
    }
    r2 = 10.0 + (k % 4).cast("double") * 0.5
    two = {
        "found": ~every(43), "filename": F.lit("b.tif"), "error_kind": F.when(every(31), "unsupported"), "width": (400 + k % 3 * 20).cast("int"), "height": F.lit(300), "n_bands": F.lit(3),
        "crs": F.when(every(23), "EPSG:4326").when(every(13), "").otherwise("EPSG:32643"), "transform": grid(~every(19)), "bounds": box(shift), "resolution": F.array(r2, r2),
        "modality": pick(("optical", "sar", "sar"), F.floor(k / 4)), "date": F.when(~every(4), F.lit("1996-01-01").cast("timestamp")),
    }
    side = lambda fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    return V.table(spark, d, "orders").select(k.alias("k"), side(one).alias("a"), side(two).alias("b"), ((k % 20) / 20.0).alias("score"))


_codes = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["code"]))


@query("flt9_flt12_pair_validation", "with " + _HEADS + """, e as (select *, case when not f1 then 'first_not_found' when not f2 then 'second_not_found' when e1 is not null then 'first_unreadable' when e2 is not null then 'second_unreadable' when mapped and not t1 then 'first_without_transform' when mapped and not t2 then 'second_without_transform' when w1 = 0 then 'no_size'
when not mapped and w1 < 16 then 'too_small' when not mapped and score < 0.15 then 'unrelated' when mapped and c1 <> c2 then 'other_crs' when mapped and share is null then 'disjoint' when mapped and share < 0.5 then 'low_overlap' end as error from q),
w as (select *, concat_ws(',', case when not mapped then 'pixels_only' end, case when not mapped and w1 <> w2 then 'size_differs' end, case when not mapped then 'alignment' end, case when mapped and abs(10 - r2) / 10 * 100 > 10 then 'resolution_differs' end, case when mapped and share < 0.95 then 'partial_overlap' end,
case when d1 is null and d2 is null then 'missing_dates' when d1 is null then 'first_date_missing' when d2 is null then 'second_date_missing' when d1 >= d2 then 'reversed_dates' end, case when m1 <> m2 then 'other_modality' end, case when mapped and n1 <> 3 then 'bands_differ' end) as warned from e)
select k, error is null as valid, error, case when error is null then warned else '' end as warnings, case when mapped then 'map' else 'pixels' end as mode, case when mapped then share else score end as overlap, coalesce(d1 < d2, false) as ordered from w""")
def flt9(spark, d):
    v = _heads(spark, d).select("k", VA.bitemporal(F.col("a"), F.col("b"), F.col("score")).alias("v"))
    return v.select("k", "v.valid", F.col("v.error.code").alias("error"), _codes("v.warnings").alias("warnings"), "v.mode", "v.overlap", "v.ordered")


@query("flt10_cross_modal_validation", "with " + _HEADS + """, e as (select *, m1 in ('optical', 'multispectral') as o1, m2 = 'optical' as o2, case when not f1 then 'first_not_found' when not f2 then 'second_not_found' when e1 is not null then 'first_unreadable' when e2 is not null then 'second_unreadable' when not g1 then 'first_without_crs' when not g2 then 'second_without_crs' when w1 = 0 then 'no_size' when not t1 or not t2 then 'without_transform'
when m1 in ('optical', 'multispectral') and m2 = 'optical' then 'both_optical' when m1 = 'sar' and m2 = 'sar' then 'both_sar' when m1 = 'thermal' then 'unsupported_pair' when c1 <> c2 then 'other_crs' when share is null then 'disjoint' when share < 0.2 then 'low_overlap' end as error from q)
select k, error is null as valid, error, case when error is null then concat_ws(',', case when m1 = 'sar' and o2 then 'swapped' end, case when share < 0.95 then 'partial_overlap' end) else '' end as warnings, m1 = 'sar' and o2 as swapped, share as overlap from e""")
def flt10(spark, d):
    v = _heads(spark, d).select("k", VA.cross_modal(F.col("a"), F.col("b")).alias("v"))
    return v.select("k", "v.valid", F.col("v.error.code").alias("error"), _codes("v.warnings").alias("warnings"), "v.swapped", "v.overlap")


#: Two candidates for a change score, by scene-wise difference and by the bands' mean; the truth is the raised block.
_SCORES = I.CHANGED + """, tr as (select scene, y, x, scene % 4 <> 0 and y >= 8 + scene % 7 and y < 28 + scene % 9 and x >= 2 + scene % 3 and x < 12 as truth from cpair),
sc as (select 'vector' as candidate, truth, d as score from df join tr using (scene, y, x) union all select 'mean', truth, least(1.0::double, (abs(b[1] - a[1]) + abs(b[2] - a[2]) + abs(b[3] - a[3]) + abs(b[4] - a[4])) / 8.0::double) from cpair join tr using (scene, y, x)),
hs as (select candidate, least(floor(score * 128), 127)::bigint as bin, count(*) filter (where truth) as yes, count(*) filter (where not truth) as no from sc group by all),
al as (select candidate, unnest(range(128))::bigint as bin from (select distinct candidate from hs)),
hf as (select candidate, bin, coalesce(yes, 0) as yes, coalesce(no, 0) as no from al left join hs using (candidate, bin)),
cf as (select candidate, bin, sum(yes) over u::bigint as tp, sum(no) over u::bigint as fp, (sum(yes) over (partition by candidate) - sum(yes) over u)::bigint as fn, (sum(no) over (partition by candidate) - sum(no) over u)::bigint as tn from hf window u as (partition by candidate order by bin desc)),
sw as (select candidate, bin, bin / 128.0::double as threshold, tp, fp, fn, tn, round(case when tp + fp > 0 then tp::double / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp::double / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, round(case when tp + fp + fn > 0 then tp::double / (tp + fp + fn) else 0 end, 6) as iou from cf)"""


def _swept(spark, d):
    pair, y, x, n = V.changed_pair(spark, d), F.col("y"), F.col("x"), F.col("scene")
    truth = ((n % 4 != 0) & (y >= 8 + n % 7) & (y < 28 + n % 9) & (x >= 2 + n % 3) & (x < 12)).alias("truth")
    steps = F.aggregate(F.zip_with("a", "b", lambda p, q: F.abs(q - p)), F.lit(0.0), lambda s, v: s + v)
    one = CH.difference(pair).select(F.lit("vector").alias("candidate"), truth, F.col("d").alias("score"))
    two = pair.select(F.lit("mean").alias("candidate"), truth, F.least(F.lit(1.0), steps / 8.0).alias("score"))
    return S.sweep(one.unionByName(two))


@query("ben5_agg8_threshold_sweep", _SCORES + " select * from sw")
def ben5_sweep(spark, d):
    """Two candidates' scores of all pixels at 128 thresholds."""
    return _swept(spark, d)


@query("ben5_best_thresholds", _SCORES + """, bc as (select candidate, arg_max({'threshold': threshold, 'precision': precision, 'recall': recall, 'f1': f1, 'iou': iou}, {'f1': f1, 'threshold': threshold}) as b from sw group by candidate), tc as (select arg_max(b, {'f1': b.f1, 'candidate': candidate}) as t from bc)
select candidate, b.threshold as threshold, b.precision as precision, b.recall as recall, b.f1 as f1, b.iou as iou, round(b.precision - t.precision, 6) as d_precision, round(b.recall - t.recall, 6) as d_recall, round(b.f1 - t.f1, 6) as d_f1, round(b.iou - t.iou, 6) as d_iou from bc, tc""")
def ben5_best(spark, d):
    return S.best_of(_swept(spark, d))


def _boxes(spark, d):
    b = V.boxes(spark, d).groupBy(F.col("image").alias("request"), "ord").agg(F.max("score").cast("double").alias("score"))
    requests = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"))
    return written(E.fused(E.from_boxes(requests, b)), "items")


_ITEMS = V.with_views("bx") + ", rq as (select o_orderkey as request from orders), bs as (select image as request, ord, max(score)::double as score from bx group by image, ord)"


@query("agg23_report_metrics", _ITEMS + ", m as (select request, count(*) as n, max(score) as best from bs group by request) select request, coalesce(n, 0) as boxes, coalesce(best, 0.25::double) as best_confidence, case when n is null then 'Nothing was found of what was looked for.|Uncertain items: 1.' else '' end as notes from rq left join m using (request) union all select request, n, best, '' from m where request not in (select request from rq)")
def agg23(spark, d):
    """The numbers of every order's report."""
    return E.metrics(_boxes(spark, d)).select("request", "boxes", "best_confidence", F.concat_ws("|", "notes").alias("notes"))


@query("evd6_lookup", _ITEMS + " select request, printf('box_%02d', ord) as region, score as value from bs where ord = 3")
def evd6(spark, d):
    """The third box of every order that has one, by specialist, type and region."""
    return E.lookup(_boxes(spark, d), specialist="RS_GROUND", kind="box", region="box_03").select("request", "region", "value")


def _truth(y, x, n):
    return (n % 4 != 0) & (y >= 8 + n % 7) & (y < 28 + n % 9) & (x >= 2 + n % 3) & (x < 12)


@query("ben1_scene_benchmark", I.CHANGED + """, tr as (select scene, y, x from cpair where scene % 4 <> 0 and y >= 8 + scene % 7 and y < 28 + scene % 9 and x >= 2 + scene % 3 and x < 12),
bo as (select scene, y, x, max(p) as p, max(t) as t from (select scene, y, x, 1 as p, 0 as t from cl union all select scene, y, x, 0, 1 from tr) group by all), co as (select scene, sum(p * t)::bigint as tp, sum(p * (1 - t))::bigint as fp, sum(t * (1 - p))::bigint as fn from bo group by scene),
c as (select sa.scene, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, 800 - coalesce(tp, 0) - coalesce(fp, 0) - coalesce(fn, 0) as tn from (select distinct scene from cpair) sa left join co using (scene)),
pr as (select *, case when tp + fp + fn = 0 then 1 when tp + fp > 0 then tp::double / (tp + fp) else 0 end as p, case when tp + fp + fn = 0 then 1 when tp + fn > 0 then tp::double / (tp + fn) else 0 end as r from c)
select scene, tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2.0::double * p * r / (p + r) else 0 end, 4) as f1 from pr""")
def ben1(spark, d):
    """Change detection on every scene of the table, against the block that was raised."""
    pair, n = V.changed_pair(spark, d), F.col("scene")
    samples = pair.select("scene").distinct().select(
        "scene",
        F.lit(I.H * I.WIDTH).cast("long").alias("pixels"),
        F.element_at(F.array(*map(F.lit, ("urban", "forest", "water", "agriculture"))), (n % 4 + 1).cast("int")).alias("category"),
        F.element_at(F.array(*map(F.lit, ("none", "illumination", "shadow"))), (n % 3 + 1).cast("int")).alias("nuisance"),
        (n % 3 != 0).alias("quantitative"),
        n.alias("ord"),
    )
    truth = pair.where(_truth(F.col("y"), F.col("x"), n)).select("scene", "y", "x")
    out = BE.change_benchmark(CH.detect(pair, I.H, I.WIDTH)["mask"], truth, samples)["samples"]
    return out.select("scene", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


@query("ben2_agg17_scene_formats", I.CHANGED + """, cc as (select scene, count(*) as n from cl group by scene), ex as (select scene, ['tif', 'png', 'jp2'][scene % 3 + 1] as formats, scene % 4 <> 0 as change, coalesce(n, 0) as changed from (select distinct scene from df) left join cc using (scene)),
ve as (select *, round(changed::double / 800 * 100.0::double, 4) >= 1.0 and changed > 100 as found from ex)
select formats, count(*) as n, count(*) filter (where found = change) as correct, count(*) filter (where found and not change) as false_positives, round(count(*) filter (where found = change)::double / count(*) * 100.0::double, 2) as accuracy_pct from ve group by formats""")
def ben2(spark, d):
    """The verdict on every scene of the table by its format; how well the pairs align has no SQL."""
    pair, n = V.changed_pair(spark, d), F.col("scene")
    formats = F.element_at(F.array(*map(F.lit, ("tif", "png", "jp2"))), (n % 3 + 1).cast("int"))
    expected = pair.select("scene").distinct().select("scene", formats.alias("formats"), (n % 4 != 0).alias("change"))
    return S.format_matrix(BE.format_audit(pair, expected, I.H, I.WIDTH)).drop("misaligned")
