"""Validation, metrics, taxonomy, consistency, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import routing as R
from ..operators import scoring as S
from . import query

_TP = "tp as (select d.lang, d.source, l.quality = 1 as truth, l.toxic = 0 as pred from documents d join labels l using (doc_id)), c as (select source as sample, count_if(truth and pred)::bigint as tp, count_if(not truth and pred)::bigint as fp, count_if(truth and not pred)::bigint as fn, count_if(not truth and not pred)::bigint as tn from tp group by source)"


def _confusion(spark, d, key="source"):
    """labels ⋈ documents on the id alone: no text is read."""
    j = V.table(spark, d, "documents").select("doc_id", "lang", "source").join(V.table(spark, d, "labels"), "doc_id")
    j = j.select(F.col(key).alias("sample"), (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("pred"))
    return S.confusion(j, "sample")


@query("agg8_jn7_metrics_eps", "with " + _TP + ", m as (select *, tp / (tp + fp + 1e-8::double) as p, tp / (tp + fn + 1e-8::double) as r from c) select sample, tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(2.0::double * p * r / (p + r + 1e-8::double), 4) as f1, round(tp / (tp + fp + fn + 1e-8::double), 4) as iou, round(fp / (fp + tn + 1e-8::double), 4) as fpr, round((tp + fp)::double / (tp + fp + fn + tn), 4) as changed_ratio from m")
def agg8(spark, d):
    return S.metrics_eps(_confusion(spark, d))


_EX = ", m as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as r from c), x as (select sample, tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2.0::double * p * r / (p + r) else 0 end, 4) as f1, round(tp::double / (tp + fp + fn), 4) as iou, round(case when fp + tn > 0 then fp::double / (fp + tn) else 0 end, 4) as fpr, round((tp + fp)::double / (tp + fp + fn + tn), 4) as changed_ratio, tp + fp = 0 as is_empty, (tp + fp)::double / (tp + fp + fn + tn) >= 0.98 as is_full from m)"


@query("agg9_metrics_explicit", "with " + _TP + _EX + " select * from x")
def agg9(spark, d):
    return S.metrics_explicit(_confusion(spark, d))


@query("agg10_metrics_bench", "with " + _TP + ", m as (select *, (tp + 1e-6::double) / (tp + fp + 1e-6::double) as p, (tp + 1e-6::double) / (tp + fn + 1e-6::double) as r from c) select sample, tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(2.0::double * p * r / (p + r), 4) as f1, round((tp + 1e-6::double) / (tp + fp + fn + 1e-6::double), 4) as iou from m")
def agg10(spark, d):
    return S.metrics_bench(_confusion(spark, d))


@query("agg11_macro", "with " + _TP + _EX + " select count(*) as samples, " + ", ".join(f"round({f}({k}), 7) as {n}_{k}" for k in ("iou", "precision", "recall", "f1") for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + ", round(avg(fpr), 7) as mean_fpr, round(avg(is_empty::int::double), 7) as empty_rate, round(avg(is_full::int::double), 7) as full_rate from x")
def agg11(spark, d):
    """To seven digits, so that no mean lies half-way between two roundings."""
    return S.macro(S.metrics_explicit(_confusion(spark, d)), 7)


@query("agg12_micro", "with " + _TP.replace("c as (select", "c0 as (select") + ", c as (select 'all' as sample, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tn)::bigint as tn from c0)" + _EX + " select tp, fp, fn, tn, precision, recall, f1, iou, fpr, changed_ratio, is_empty, is_full from x")
def agg12(spark, d):
    return S.micro(_confusion(spark, d))


_TAX = _TP + _EX + ", n as (select *, ['registration', 'illumination', 'shadow', 'seasonal_color', 'none'][substr(sample, 4)::int % 5 + 1] as nuisance, ['forest', 'agriculture', 'water', 'urban'][substr(sample, 4)::int % 4 + 1] as category, substr(sample, 4)::int % 3 <> 0 as q, tp + fp + 90 as pred from x)"


_KIND = """, k as (select *, case when not q and pred > 100 and nuisance = 'registration' then 'alignment_related_error' when not q and pred > 100 and nuisance in ('illumination', 'shadow') then 'shadow_false_positive' when not q and pred > 100 and nuisance = 'seasonal_color' then 'seasonal_variation_false_positive' when not q or (f1 >= 0.85 and fpr < 0.01) then null
when nuisance = 'registration' and fpr > 0.005 then 'alignment_related_error' when nuisance in ('illumination', 'shadow') and fpr > 0.01 then 'shadow_false_positive' when nuisance = 'seasonal_color' and fpr > 0.01 then 'seasonal_variation_false_positive' when category = 'forest' and fpr > 0.02 then 'vegetation_error' when category = 'agriculture' and fpr > 0.02 then 'agriculture_error' when category = 'water' and fpr > 0.02 then 'water_error'
when recall < 0.50 and precision >= 0.70 then case when tp < 1500 and fn > 0 then 'small_change_missed' else 'missed_change' end when precision < 0.50 and recall >= 0.70 then 'false_positive' when recall < 0.70 and precision < 0.70 and tp > 0 and (fp > 0.25 * tp or fn > 0.25 * tp) then 'boundary_error' else 'unclassified_failure' end as kind from n)"""


@query("flt16_taxonomy", "with " + _TAX + _KIND + """
select sample, kind, case when kind is null then null when not q then round(least(1, pred / 10000.0::double), 4) when kind in ('small_change_missed', 'missed_change') then round(1 - recall, 4) when kind = 'false_positive' then round(1 - precision, 4) else round(1 - f1, 4) end as severity from k""")
def flt16(spark, d):
    return _taxonomy(spark, d)[1].select("sample", "kind", "severity")


def _taxonomy(spark, d):
    """The sample's number, and its metrics with what is known of it and its failure."""
    i = F.substring("sample", 4, 9).cast("int")
    at = lambda vs: F.element_at(F.array(*[F.lit(v) for v in vs]), i % len(vs) + 1)
    m = S.metrics_explicit(_confusion(spark, d)).withColumns(
        {
            "nuisance": at(["registration", "illumination", "shadow", "seasonal_color", "none"]),
            "category": at(["forest", "agriculture", "water", "urban"]),
            "q": i % 3 != 0,
            "pred": F.col("tp") + F.col("fp") + 90,
        }
    )
    kind, severity = S.failure(F.col("category"), F.col("nuisance"), F.col("q"), F.col("pred"))
    return i, m.withColumn("kind", kind).withColumn("severity", severity)


@query("agg14_failure_distribution", "with " + _TAX + _KIND + """, n2 as (select kind, count(*) as n, min(substr(sample, 4)::int) as o from k where kind is not null group by kind) select kind, n, kind = first(kind) over (order by n desc, o) as "primary" from n2""")
def agg14(spark, d):
    """Kinds of failure over the samples; of equally frequent ones the first by the sample's number is the primary one."""
    i, m = _taxonomy(spark, d)
    return S.failure_distribution(m.withColumn("ord", i), "kind", "ord")


@query(
    "agg14_failures_by_nuisance",
    "with " + _TAX + " select nuisance, count(*) as n, round(avg(f1), 7) as mean_f1 from n group by nuisance",
)
def agg14_nuisance(spark, d):
    return _taxonomy(spark, d)[1].groupBy("nuisance").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 7).alias("mean_f1"))


@query("agg13_win12_latency", "with e as (select event_type, value, row_number() over (partition by event_type order by event_id) as k from events) select event_type, round(avg(value), 4) as mean, round(median(value), 4) as median, round(quantile_cont(value, 0.95), 4) as p95, min(value) as low, max(value) as high from e where k > 1 group by event_type")
def agg13(spark, d):
    return S.latencies(V.table(spark, d, "events"), "event_type", "value", "event_id")


@query("agg19_calibration", "with b as (select least(floor(l_discount * 10 * 5), 4) as bin, l_discount * 10 as p, (l_returnflag = 'R')::int::double as y from lineitem), g as (select bin, count(*) as n, avg(p) as mp, avg(y) as my, sum((p - y) * (p - y)) as se from b group by bin) select round(sum(se) / sum(n), 6) as brier, round(sum(n * abs(mp - my)) / sum(n), 6) as ece, sum(n)::bigint as n from g")
def agg19(spark, d):
    t = V.table(spark, d, "lineitem").select(
        (F.col("l_discount") * 10).alias("p"),
        (F.col("l_returnflag") == "R").cast("double").alias("y"),
    )
    return S.calibration(t)


@query("flt17_scenario_verdict", "with g as (select l_orderkey, sum(l_quantity)::bigint as px from lineitem group by 1) select l_orderkey, px, px / 10000.0::double * 100 >= 1.0 and px > 100 as changed from g")
def flt17(spark, d):
    g = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("px"))
    return g.select("l_orderkey", "px", S.changed(F.col("px"), F.col("px") / 10000.0 * 100).alias("changed"))


@query("con8_insufficient_evidence", """with o as (select o_orderkey as k, ['grounding', 'optical_sar_analysis', 'vqa'][o_orderkey % 3 + 1] as task, o_orderkey % 4 as regions, o_orderkey % 5 = 0 as deg, ['How large is the area?', 'Where is it?'][o_orderkey % 2 + 1] as q, o_orderkey % 7 = 0 as nocrs from orders)
select k, case when task in ('grounding', 'optical_sar_analysis') and regions = 0 then 'C8_INSUFFICIENT_EVIDENCE' when task = 'grounding' and deg then 'C8_DEGENERATE_DETECTION' end as rule, case when task in ('grounding', 'optical_sar_analysis') and regions = 0 then 'insufficient_evidence' when task = 'grounding' and deg then 'partially_consistent' else 'consistent' end as status, q like '%area%' and nocrs as needs_grid from o""")
def con8(spark, d):
    k = F.col("o_orderkey")
    pick = lambda vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (k % len(vs) + 1).cast("int"))
    rule, none = S.insufficient(pick(["grounding", "optical_sar_analysis", "vqa"]), k % 4, (k % 5 == 0).cast("int"))
    status, _ = S.status(F.lit(0), rule.isNotNull().cast("int"), none)
    grid = S.needs_grid(pick(["How large is the area?", "Where is it?"]), F.when(k % 7 != 0, "EPSG:32643"))
    return V.table(spark, d, "orders").select(k.alias("k"), rule.alias("rule"), status.alias("status"), grid.alias("needs_grid"))


@query("flt8_single_raster", "select p_partkey, concat_ws(',', case when p_size < 16 then 'too_small' end, case when p_partkey % 7 = 0 then 'no_bands' end) as errors, concat_ws(',', case when p_partkey % 3 = 0 then 'no_crs' end, case when p_partkey % 2 = 0 then 'unverified_modality' end) as warnings from part")
def flt8(spark, d):
    k = F.col("p_partkey")
    e, w = R.single_raster_issues(F.col("p_size"), F.lit(99), k % 7, F.when(k % 3 != 0, "EPSG:32643"), k % 2 != 0)
    return V.table(spark, d, "part").select("p_partkey", F.concat_ws(",", e).alias("errors"), F.concat_ws(",", w).alias("warnings"))


@query("flt9_flt11_flt12_pair", """with o as (select o_orderkey as k, case when o_orderkey % 5 <> 0 then 'A' end as c1, case when o_orderkey % 11 = 0 then 'B' else 'A' end as c2, (o_orderkey % 101) / 100.0::double as share, case when o_orderkey % 4 = 0 then 12.0 else 10.0 end::double as r2, case when o_orderkey % 6 <> 0 then o_orderdate end as d1, timestamp '1996-01-01' as d2, (o_orderkey % 50) / 100.0::double as score from orders)
select k, case when c1 <> c2 and c1 is not null then 'crs_mismatch' when c1 is not null and share < 0.50 then 'low_overlap' when c1 is null and score < 0.15 then 'low_alignment' end as error, concat_ws(',', case when c1 is not null and share < 0.95 then 'partial_overlap' end, case when abs(10 - r2) / greatest(10, r2) > 0.10 then 'resolution_mismatch' end, case when d1 is null then 'missing_date' when d1 >= d2 then 'reversed_dates' end) as warnings from o""")
def flt9(spark, d):
    o, k = V.table(spark, d, "orders"), F.col("o_orderkey")
    e, w = R.pair_issues(
        F.when(k % 5 != 0, "A"),
        F.when(k % 11 == 0, "B").otherwise("A"),
        (k % 101) / 100.0,
        F.lit(10.0),
        F.when(k % 4 == 0, 12.0).otherwise(10.0),
        F.when(k % 6 != 0, F.col("o_orderdate")),
        F.lit("1996-01-01").cast("timestamp"),
        (k % 50) / 100.0,
    )
    return o.select(k.alias("k"), e.alias("error"), F.concat_ws(",", w).alias("warnings"))


@query("flt10_cross_modal_pair", "select c_custkey, case when c_custkey % 7 = 0 then 'no_crs' when not ((c_custkey % 3 < 2 and c_custkey % 2 = 0) or (c_custkey % 3 = 2 and c_custkey % 2 = 1)) then 'not_optical_and_sar' when (c_custkey % 100) / 100.0::double < 0.20 then 'low_overlap' end as error, c_custkey % 3 = 2 and c_custkey % 2 = 1 as swap from customer")
def flt10(spark, d):
    k = F.col("c_custkey")
    m1 = F.when(k % 3 == 2, "sar").when(k % 3 == 1, "multispectral").otherwise("optical")
    e, s = R.cross_modal_issue(m1, F.when(k % 2 == 0, "sar").otherwise("optical"), F.when(k % 7 != 0, "A"), F.lit("A"), (k % 100) / 100.0)
    return V.table(spark, d, "customer").select("c_custkey", e.alias("error"), s.alias("swap"))


def _evidence(spark, d):
    k = F.col("o_orderkey")
    pick = lambda vs, m: F.element_at(F.array(*[F.lit(v) for v in vs]), (k % m + 1).cast("int"))
    t = F.struct(
        pick(["water", "forest", "none", "bare"], 4).alias("from"),
        pick(["building", "bare_ground", "none"], 3).alias("to"),
        pick(["vegetation loss", "new roof", "clearing", ""], 4).alias("description"),
        F.when(k % 5 == 0, "r9").when(k % 5 == 1, "r1").alias("region"),
        F.when(k % 9 == 0, F.lit(5.0)).alias("claimed_ha"),
    )
    return V.table(spark, d, "orders").select(
        k.alias("k"),
        pick([0, 40, 300, 900], 4).cast("long").alias("changed_px"),
        F.lit(4.0).alias("measured_ha"),
        F.when(k % 17 == 0, "reversed").otherwise("valid").alias("ordering"),
        F.when(k % 13 != 0, pick(["increased", "decreased", "no_change", "modified", "uncertain"], 5)).alias("direction"),
        F.array(F.lit("r1"), F.lit("r2")).alias("regions"),
        F.when(
            k % 8 == 0,
            F.array().cast("array<struct<from:string,to:string,description:string,region:string,claimed_ha:double>>"),
        ).otherwise(F.array(t)).alias("transitions"),
    )


_EV = """ev as (select o_orderkey as k, [0, 40, 300, 900][o_orderkey % 4 + 1] as px, o_orderkey % 17 = 0 as rev, case when o_orderkey % 13 <> 0 then ['increased', 'decreased', 'no_change', 'modified', 'uncertain'][o_orderkey % 5 + 1] end as dir, o_orderkey % 8 <> 0 as has,
['water', 'forest', 'none', 'bare'][o_orderkey % 4 + 1] as f, ['building', 'bare_ground', 'none'][o_orderkey % 3 + 1] as t, ['vegetation loss', 'new roof', 'clearing', ''][o_orderkey % 4 + 1] as de, o_orderkey % 5 = 0 as bad, o_orderkey % 9 = 0 as claims from orders),
c1 as (select *, dir is not null and px = 0 and (dir in ('increased', 'decreased', 'modified') or (has and f <> 'none' and t <> 'none')) as c1 from ev),
cf as (select k, dir is not null as told, c1, coalesce(dir is not null and has and px <= 0 and not c1, false) as c3, rev as c5a, coalesce(dir = 'no_change' and px > 500, false) as c5b,
coalesce(dir = 'increased' and has and px > 0 and not (regexp_matches(t, 'construction|built') or regexp_matches(de, 'expansion|new')) and (contains(t, 'bare') or regexp_matches(de, 'loss|clearing')), false) as c5c, coalesce(dir is not null and has and bad, false) as c2, coalesce(dir is not null and has and claims, false) as c4, coalesce(dir is not null and has and f = 'water' and contains(t, 'building') and px < 50, false) as c7 from c1),
ct as (select k, c1::int + c3::int + c5a::int + c5b::int as critical, c5c::int + c2::int + c4::int + c7::int as warnings from cf),
sq as (select *, case when critical > 0 then 'contradictory' when warnings > 1 then 'uncertain' when warnings = 1 then 'partially_consistent' else 'consistent' end as status, case when critical > 0 then greatest(0.1::double, 1.0::double - 0.4::double * critical - 0.15::double * warnings) when warnings > 1 then greatest(0.4::double, 1.0::double - 0.2::double * warnings) when warnings = 1 then 0.8::double else 1.0::double end as quality from ct)"""


def _judged(spark, d):
    e = S.change_conflicts(_evidence(spark, d))
    n = lambda s: F.size(F.filter("conflicts", lambda x: x["severity"] == s))
    e = e.select("k", n("critical").alias("critical"), n("warning").alias("warnings"))
    s, q = S.status(F.col("critical"), F.col("warnings"), F.lit(False))
    return e.withColumn("status", s).withColumn("quality", q)


@query("con1_con5_con7_jn14_conflicts", "with " + _EV + " select k, concat_ws(',', case when c1 then 'C1_ZERO_CHANGE_CONTRADICTION' end, case when c3 then 'C3_NONZERO_CHANGE_SUPPORT' end, case when c5a then 'C5_TEMPORAL_CHRONOLOGY_INVALID' end, case when c5b or c5c then 'C5_TEMPORAL_DIRECTION_CONFLICT' end, case when c2 then 'C2_UNSUPPORTED_REGION' end, case when c4 then 'C4_AREA_CONSISTENCY' end, case when c7 then 'C7_CLASS_TRANSITION_CONFLICT' end) as rules from cf")
def con1(spark, d):
    return S.change_conflicts(_evidence(spark, d)).select(
        "k",
        F.concat_ws(",", F.transform("conflicts", lambda x: x["rule"])).alias("rules"),
    )


@query("agg20_con9_status", "with " + _EV + " select k, critical, warnings, status, round(quality, 4) as quality, case status when 'contradictory' then 'flag_contradiction' when 'consistent' then 'allow' else 'qualify' end as gate from sq")
def agg20(spark, d):
    return _judged(spark, d).select(
        "k",
        "critical",
        "warnings",
        "status",
        F.round("quality", 4).alias("quality"),
        S.gate(F.col("status")).alias("gate"),
    )


_SAY = lambda rule: "'" + S.SAYS[rule].replace("'", "''") + "'"


@query("con9_gated_answers", "with " + _EV + f""", fr as (select k, case when c1 then {_SAY("C1_ZERO_CHANGE_CONTRADICTION")} when c3 then {_SAY("C3_NONZERO_CHANGE_SUPPORT")} when c5a then {_SAY("C5_TEMPORAL_CHRONOLOGY_INVALID")} when c5b or c5c then {_SAY("C5_TEMPORAL_DIRECTION_CONFLICT")} when c2 then {_SAY("C2_UNSUPPORTED_REGION")} when c4 then {_SAY("C4_AREA_CONSISTENCY")} when c7 then {_SAY("C7_CLASS_TRANSITION_CONFLICT")} end as say from cf)
select sq.k, case status when 'contradictory' then '[contradiction] ' || say || ' It can''t be told as a fact, as what was measured speaks against it.' when 'uncertain' then printf('[provisional] Order %d: it changed. (The evidence is ambiguous; conflicts noted: %d.)', sq.k, critical + warnings) when 'partially_consistent' then printf('Order %d: it changed. [partly consistent: %s]', sq.k, say) else printf('Order %d: it changed.', sq.k) end as answer from sq join fr using (k)""")
def con9(spark, d):
    """Each order's answer as far as its evidence bears it."""
    e = S.change_conflicts(_evidence(spark, d))
    n = lambda s: F.size(F.filter("conflicts", lambda x: x["severity"] == s))
    s, _ = S.status(n("critical"), n("warning"), F.lit(False))
    return e.select("k", S.gated_answer(F.format_string("Order %d: it changed.", F.col("k")), s, F.col("conflicts")).alias("answer"))


@query("con6_sensor_conflicts", "select l_orderkey, l_linenumber, case when l_discount * 5 > 0.15 and l_tax * 12 > 0.75 and l_quantity / 100 > 0.20 then 'green_but_double_bounce' when l_linenumber % 4 = 0 and l_tax * 12 > 0.35 then 'water_but_rough' when l_linenumber % 4 = 1 and l_tax * 12 < 0.10 and l_quantity / 100 < 0.04 then 'built_but_smooth' when l_linenumber % 4 = 2 then 'unclassified' end as conflict from lineitem")
def con6(spark, d):
    m = F.col("l_linenumber") % 4
    label = F.when(m == 0, "water_body").when(m == 1, "built_structure").when(m == 2, "unknown").otherwise("road_or_infrastructure")
    return V.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        S.sensor_conflict(label, F.col("l_discount") * 5, F.col("l_tax") * 12, F.col("l_quantity") / 100).alias("conflict"),
    )


@query("cnf1_cnf3_confidence", "with " + _EV + """, p as (select k, status, quality, critical, warnings, case status when 'consistent' then 1.0 when 'partially_consistent' then 0.85 when 'uncertain' then 0.70 else 0.30 end::double as f, case status when 'consistent' then 0.0 when 'partially_consistent' then 0.12 when 'uncertain' then 0.20 else 0.50 end::double as pen, case status when 'consistent' then 0.99 when 'partially_consistent' then 0.75 when 'uncertain' then 0.60 else 0.35 end::double as cap,
round(least(0.99::double, greatest(0.10::double, (0.500037::double + (k % 50) / 100.0::double) * (0.35::double + 0.65::double * (1.0::double - (k % 4) / 4.0::double * 0.5::double)))), 4) as s from sq), z as (select k, round(greatest(0.05::double, least(cap, round((0.15::double * 1.0::double + 0.15::double * 0.90013::double + 0.50::double * s + 0.20::double * quality) * f - pen, 4))), 4) as confidence from p)
select k, confidence, case when confidence >= 0.78 then 'HIGH' when confidence >= 0.55 then 'MEDIUM' when confidence >= 0.35 then 'LOW' else 'UNSUPPORTED' end as tier from z""")
def cnf1(spark, d):
    """CNF1 to CNF3 over the judged evidence; the signal is that of a cascade."""
    j, k = _judged(spark, d), F.col("k")
    s = S.specialist_signal(F.lit("cascade"), 0.500037 + (k % 50) / 100.0, (k % 4) / 4.0, F.lit(0.0), F.lit(1), F.lit(False))
    c = F.round(
        S.confidence(
            F.lit(1.0),
            F.lit(0.90013),
            s,
            F.col("quality"),
            F.col("status"),
            F.col("critical") + F.col("warnings"),
            F.col("critical") > 0,
        ),
        4,
    )
    return j.select("k", c.alias("confidence")).withColumn("tier", S.tier(F.col("confidence")))


@query("cnf2_specialist_signal", "with x as (select l_orderkey, l_linenumber, ['cascade', 'optical_sar', 'grounding', 'vqa'][l_linenumber % 4 + 1] as kind, l_quantity / 50 + 0.000013::double as s, l_discount * 5 as unc, l_tax * 600 as unk, l_suppkey % 3 as nb, l_partkey % 5 = 0 as deg from lineitem) select l_orderkey, l_linenumber, case when kind = 'grounding' and nb = 0 then 0.25::double when kind = 'grounding' and deg then 0.30::double else round(least(0.99::double, greatest(0.10::double, case kind when 'cascade' then s * (0.35::double + 0.65::double * (1.0::double - unc * 0.5::double)) when 'optical_sar' then case when unk > 25 then greatest(0.20::double, s * 0.75::double) else s end else s end)), 4) end as signal from x")
def cnf2(spark, d):
    kind = F.element_at(F.array(*[F.lit(v) for v in ("cascade", "optical_sar", "grounding", "vqa")]), F.col("l_linenumber") % 4 + 1)
    s = S.specialist_signal(
        kind,
        F.col("l_quantity") / 50 + 0.000013,
        F.col("l_discount") * 5,
        F.col("l_tax") * 600,
        F.col("l_suppkey") % 3,
        F.col("l_partkey") % 5 == 0,
    )
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("signal"))
