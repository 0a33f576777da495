"""Plans, registry, evidence, reports, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import pixels as PX
from ..functions import text as T
from ..operators import alignment as A
from ..operators import evidence as E
from ..operators import scoring as S
from ..plans import executor as X
from ..plans import registry as P
from ..plans import specialist as SP
from . import imagery as I
from . import language as L
from . import query
from .language import QUESTIONS

_CAPS = "with c as (select * from (values " + ", ".join(
    f"('{n}', '{t}', {m!r}, {i!r}, {str(b).lower()})"
    for n, t, m, i, b in P.SPECIALISTS
) + ") v(name, task, modalities, inputs, built_in))"


_SEARCH = "o as (select o_orderkey as request, ['vqa', 'grounding', 'caption', 'change_detection', 'change_vqa', 'optical_sar_analysis'][o_orderkey % 6 + 1] as task, ['optical', 'multispectral', 'sar'][o_orderkey // 6 % 3 + 1] as modality, (o_orderkey // 18 % 2 + 1)::int as n from orders)"


@query("udf2_udf3_flt14_capability_search", _CAPS + ", " + _SEARCH + " select request, o.task, modality, n, name, built_in from o left join c on c.task = o.task and list_contains(modalities, modality) and list_contains(inputs, n)")
def flt14(spark, d):
    """For every order's task, modality and number of inputs the specialist that takes them."""
    k, c = F.col("o_orderkey"), P.capabilities(spark)
    pick = lambda vs, at: F.element_at(F.array(*map(F.lit, vs)), (at % len(vs) + 1).cast("int"))
    o = V.table(spark, d, "orders").select(
        k.alias("request"), pick(list(P.STEPS), k).alias("task"), pick(("optical", "multispectral", "sar"), F.floor(k / 6)).alias("modality"), (F.floor(k / 18) % 2 + 1).cast("int").alias("n")
    )
    takes = F.expr("array_contains(modalities, modality) and array_contains(inputs, n)")
    j = o.join(F.broadcast(c.withColumnRenamed("task", "of")), (F.col("of") == F.col("task")) & takes, "left")
    return j.select("request", "task", "modality", "n", "name", "built_in")


@query("pln1_plan_steps", "with p as (select * from (values " + ", ".join(f"('{k}', {v!r})" for k, v in P.STEPS.items()) + ") v(task, steps)), o as (select o_orderkey as request, ['vqa', 'grounding', 'caption', 'change_detection', 'change_vqa', 'optical_sar_analysis'][o_orderkey % 6 + 1] as task from orders) select request, unnest(range(1, len(steps) + 1))::int as step, unnest(steps) as name from o join p using (task)")
def pln1(spark, d):
    task = F.element_at(F.array(*[F.lit(t) for t in P.STEPS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    r = V.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("query"), task.alias("task"))
    return P.plan(r).select(F.col("query").cast("long").alias("request"), F.col("step").cast("int").alias("step"), "name")


_TASK = "['vqa', 'grounding', 'caption', 'change_detection', 'change_vqa', 'optical_sar_analysis'][o_orderkey % 6 + 1]"


@query("udf1_udf5_registry_status", I.CHANGED + ", " + V.SQL["os"] + I.CLASS_STEPS + ", " + _CAPS.replace("with ", "", 1) + f""", zo as (select scene, count(cl.x)::double as n from df left join cl using (scene, y, x) group by scene), kc as (select scene, count(distinct class)::double as n from k group by scene), sc as (select distinct scene from df)
select sc.scene as request, c.name as specialist, case when built_in then 'ok' else 'unavailable' end as status, case c.name when 'CHANGE_DETECT' then zo.n when 'OPTICAL_SAR_FUSION' then kc.n end as answer from sc cross join c left join zo on zo.scene = sc.scene left join kc on kc.scene = sc.scene""")
def udf5(spark, d):
    """Every specialist over every scene: the built-in ones answer (changed pixels, land cover classes), the others give their
    status only."""
    registry = P.Registry()
    change, fusion = SP.ChangeDetector(I.H, I.WIDTH), SP.SensorFusion(I.H, I.WIDTH)
    registry.register(change.capability.name, lambda df: change(df).select("scene", F.col("changed").cast("double").alias("answer")))
    registry.register(fusion.capability.name, lambda df: fusion(df).where("pixels > 0").groupBy("scene").agg(F.count(F.lit(1)).cast("double").alias("answer")))
    pair = V.changed_pair(spark, d)
    inputs = {change.capability.name: pair, fusion.capability.name: V.optical_sar(spark, d)}
    out = None
    for name, *_ in P.SPECIALISTS:
        one = registry.run(name, inputs.get(name, pair.select("scene").distinct()))
        answer = F.col("answer") if "answer" in one.columns else F.lit(None).cast("double")
        one = one.select(F.col("scene").alias("request"), F.lit(name).alias("specialist"), "status", answer.alias("answer"))
        out = one if out is None else out.unionByName(one)
    return out


_BX = V.with_views("bx") + ", rq as (select distinct l_orderkey as request from lineitem), it as (select image as request, ord, max(score) as score from bx where x1 - x0 >= 60 group by image, ord)"


def _items(spark, d):
    b = V.boxes(spark, d).where("x1 - x0 >= 60").groupBy(F.col("image").alias("request"), "ord").agg(F.max("score").alias("score"))
    return V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request")).distinct(), b


@query("evd2_evd6_grounding_evidence", _BX + " select request, 'box' as type, printf('box_%02d', ord) as region, score as value from it union all select request, 'negative', null, 0.0::double from rq where request not in (select request from it)")
def evd2(spark, d):
    return E.fused(E.from_boxes(*_items(spark, d))).select("request", "type", "region", "value")


@query("evd1_evd4_answer_evidence", "select conv_id as request, case role when 'user' then 'RS_VQA' else 'CHANGE_VQA' end as specialist, max(len(text))::double as value, false as is_uncertain from conversations where role in ('user', 'assistant') group by all")
def evd1(spark, d):
    c = V.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("request"), "role").agg(
        F.max_by("text", F.length("text")).alias("answer"),
        F.lit(0.8).alias("confidence"),
    )
    a = E.fused(E.from_answers(c.where("role = 'user'"), "RS_VQA"), E.from_answers(c.where("role = 'assistant'"), "CHANGE_VQA"))
    return a.select("request", "specialist", "value", "is_uncertain")


_ID = lambda who, kind, region: f"'ev_' || left(sha256('{who}:' || scene::varchar || ':{kind}:' || {region}), 8) as item_id"


@query("evd3_evd5_imagery_evidence", I.CHANGED.replace("with px", "with recursive px", 1) + I.LABELS.replace("from rw", "from cl") + ", " + V.SQL["os"] + I.CLASS_STEPS + f""", zo as (select scene, count(*) as total, count(cl.x) as changed from df left join cl using (scene, y, x) group by scene),
rg as (select scene, label, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1, count(*) as pixels from la group by scene, label having count(*) >= 16),
rm as (select rg.scene, label, pixels, round(avg(d), 4) as mean_d from rg join df on df.scene = rg.scene and df.y >= y0 and df.y < y1 and df.x >= x0 and df.x < x1 group by all),
hc as (select scene, class, round(count(*)::double / (sum(count(*)) over (partition by scene))::double * 100.0::double, 2) as pct, case class when 'water_body' then 0.92 when 'built_structure' then 0.88 when 'vegetation_or_cropland' then 0.89 when 'road_or_infrastructure' then 0.82 when 'bare_ground_or_soil' then 0.85 else 0.5 end::double as prob from k group by scene, class)
select {_ID('CHANGE_DETECT', 'statistic', "''")}, scene as request, 'statistic' as type, null as region, changed::double as value, 0.95::double as confidence, round(changed::double / total * 100.0::double, 4) >= 98 as is_uncertain from zo
union all select {_ID('CHANGE_DETECT', 'region', "printf('changed_region_%02d', label)")}, scene, 'region', printf('changed_region_%02d', label), pixels::double, mean_d, false from rm
union all select {_ID('OPTICAL_SAR_FUSION', 'class', "class")}, scene, 'class', class, pct, prob, class = 'unknown' from hc""")
def evd3(spark, d):
    """Change and land cover of every scene as evidence."""
    change = X.run_change(V.changed_pair(spark, d), I.H, I.WIDTH)
    fusion = X.run_fusion(V.optical_sar(spark, d), I.H, I.WIDTH)
    of = lambda df: df.withColumnRenamed("scene", "request")
    items = E.fused(E.from_change(of(change["zonal"]), of(change["regions"])), E.from_classes(of(fusion["classes"])))
    return items.select("item_id", "request", "type", "region", "value", "confidence", "is_uncertain")


@query("rpt1_agg23_report", _BX + ", n as (select request, count(*) as n, max(score) as best from it group by request) select request, coalesce(n || ' findings, 0 of them uncertain.', '1 findings, 1 of them uncertain.') as answer, case when n is null then 'insufficient_evidence' else 'consistent' end as status from rq left join n using (request)")
def rpt1(spark, d):
    requests, boxes = _items(spark, d)
    items = E.fused(E.from_boxes(requests, boxes))
    judged = boxes.groupBy("request").agg(F.max("score").alias("s")).select(
        "request",
        F.lit("consistent").alias("status"),
        F.lit(0.8).alias("confidence"),
        S.tier(F.lit(0.8)).alias("tier"),
    )
    return E.report(requests.withColumn("query", F.lit("where?")), items, judged).select("request", "answer", "status")


@query("win5_win6_phase_alignment")
def win5(spark, d):
    p = V.pair(spark, d).select("scene", "y", "x", F.get("a", F.lit(0)).alias("va"), F.get("b", F.lit(0)).alias("vb"))
    shift = A.correlate(p, 50, 16)
    share = p.select("scene").distinct().select("scene", F.when(F.col("scene") % 2 == 0, F.lit(0.9)).alias("share"))
    return A.pair_score(shift, share)


_ASKED = [(q, m1, m2, None) for q in QUESTIONS for m1, m2 in (("optical", "optical"), ("optical", None), ("optical", "sar"))]
_RQ = f"rq as (select sn.scene * {len(_ASKED)} + i as request, sn.scene, query, m1, m2, hint from (select distinct scene from px) sn, (values " + ", ".join(
    f"({i}, '{q}', '{m1}', {repr(m2) if m2 else 'null'}, null::varchar)"
    for i, (q, m1, m2, _) in enumerate(_ASKED)
) + ") v(i, query, m1, m2, hint))"
_ROUTED = L.HIT + L.ROUTE_STEPS + ", rt as (" + L.ROUTED.replace("select query,", "select request, scene, query,", 1) + ")"


@query("pln2_execute_requests", I.CHANGED + ", " + V.SQL["os"] + I.CLASS_STEPS + ", " + _RQ + ", " + _ROUTED + """, sg as (select request, scene, task, rejection, unnest(string_split(specialists, ',')) as specialist from rt),
zo as (select scene, count(*) as total, count(cl.x) as changed from df left join cl using (scene, y, x) group by scene),
hc as (select scene, class, count(*) as pixels, round(count(*)::double / (sum(count(*)) over (partition by scene))::double * 100.0::double, 2) as pct from k group by scene, class),
cf as (select scene, round(least(greatest(avg(case class when 'water_body' then 0.92 when 'built_structure' then 0.88 when 'vegetation_or_cropland' then 0.89 when 'road_or_infrastructure' then 0.82 when 'bare_ground_or_soil' then 0.85 else 0.5 end::double), 0.60::double), 0.95::double), 4) as s from k group by scene),
jc as (select scene, 'CHANGE_DETECT' as specialist, case when round(changed::double / total * 100.0::double, 4) >= 50 then 'partially_consistent' else 'consistent' end as status, case when changed = 0 then 0.95 else 0.85 end::double as s, case when round(changed::double / total * 100.0::double, 4) >= 50 then 0.8 else 1.0 end::double as q from zo),
jf as (select scene, 'OPTICAL_SAR_FUSION' as specialist, case when n = 0 then 'insufficient_evidence' else 'consistent' end as status, round(least(0.99::double, greatest(0.10::double, case when u > 25 then greatest(0.20::double, s * 0.75::double) else s end)), 4) as s, case when n = 0 then 0.35 else 1.0 end::double as q
  from (select scene, count_if(class <> 'unknown' and pixels >= 16) as n, coalesce(max(case when class = 'unknown' then pct end), 0) as u from hc group by scene) join cf using (scene)),
jj as (select *, round(greatest(0.05::double, least(case status when 'consistent' then 0.99 when 'partially_consistent' then 0.75 else 0.40 end::double, round((0.15::double + 0.15::double * 0.9::double + 0.5::double * s + 0.2::double * q) * case status when 'consistent' then 1.0 when 'partially_consistent' then 0.85 else 0.45 end::double - case status when 'consistent' then 0.0 when 'partially_consistent' then 0.12 else 0.35 end::double, 4))), 4) as confidence from (select * from jc union all select * from jf))
select request, task, rejection, sg.specialist, case when rejection is not null then 'rejected' when sg.specialist not in ('CHANGE_DETECT', 'OPTICAL_SAR_FUSION') then 'unavailable' when jj.scene is null then 'no_input' else 'ok' end as state, status, confidence,
case when confidence >= 0.78 then 'HIGH' when confidence >= 0.55 then 'MEDIUM' when confidence >= 0.35 then 'LOW' when confidence is not null then 'UNSUPPORTED' end as tier
from sg left join jj on jj.scene = sg.scene and jj.specialist = sg.specialist and rejection is null""")
def pln2(spark, d):
    """Every question over three kinds of inputs and every scene, each request's specialists run and its evidence judged."""
    asked = [F.struct(F.lit(i).alias("i"), F.lit(q).alias("query"), F.lit(m1).alias("m1"), F.lit(m2).cast("string").alias("m2")) for i, (q, m1, m2, _) in enumerate(_ASKED)]
    q = V.pixels(spark, d).select("scene").distinct().select("scene", F.explode(F.array(*asked)).alias("a"))
    q = q.select((F.col("scene") * len(_ASKED) + F.col("a.i")).alias("request"), "a.query", "a.m1", "a.m2", F.lit(None).cast("string").alias("hint"), "scene")
    o = X.execute(q, V.changed_pair(spark, d), V.optical_sar(spark, d), I.H, I.WIDTH)
    judged = o["judged"].select("request", "status", F.round("confidence", 4).alias("confidence"), "tier")
    ran = F.col("specialist").isin(X.CHANGE, X.FUSION) & F.col("rejection").isNull()
    t = o["stages"].join(judged, "request", "left")
    return t.select(
        "request",
        "task",
        "rejection",
        "specialist",
        "state",
        *[F.when(ran, F.col(c)).alias(c) for c in ("status", "confidence", "tier")],
    )


@query("map24_token_confidence", "select vec_id, round(list_avg(list_transform([1, 17, 33, 49], lambda i: 1.0::double / list_sum(list_transform(embedding[i : i + 15], lambda z: exp(z::double - list_max(embedding[i : i + 15])::double))))), 6) as confidence from embeddings")
def map24(spark, d):
    """A row's 64 numbers are the logits of four tokens."""
    logits = F.transform(
        F.array(*[F.lit(i) for i in (1, 17, 33, 49)]),
        lambda i: F.transform(F.slice("embedding", i, 16), lambda z: z.cast("double")),
    )
    return V.table(spark, d, "embeddings").select("vec_id", F.round(PX.token_confidence(logits), 6).alias("confidence"))


@query("agg21_bce_dice_loss", "with v as (select label, unnest(list_transform(range(1, 33), lambda i: {'p': (embedding[i]::double + 1) / 2, 'y': (embedding[i + 32] > 0)::int::double})) as v from embeddings) select label, round(-avg(v.y * ln(v.p) + (1 - v.y) * ln(1 - v.p)), 6) as bce, round(1 - (2 * sum(v.p * v.y) + 1) / (sum(v.p) + sum(v.y) + 1), 6) as dice from v group by label")
def agg21(spark, d):
    """The first half of a row's numbers are probabilities, the signs of the other half what is true."""
    half = lambda at: F.slice("embedding", at, 32)
    pairs = F.zip_with(half(1), half(33), lambda u, v: F.struct(((u.cast("double") + 1) / 2).alias("p"), (v > 0).cast("double").alias("y")))
    return S.bce_dice(V.table(spark, d, "embeddings").select("label", F.explode(pairs).alias("v")).select("label", "v.*"), "label")


@query("str4_semantic_post_validation", "with o as (select o_orderkey as k, ['increased', 'shrunk', 'no_change', 'modified'][o_orderkey % 4 + 1] as d, (o_orderkey % 10) * 200 as px, ['water', 'lava', 'forest'][o_orderkey % 3 + 1] as f, ['forest', 'bare'][o_orderkey % 2 + 1] as t, (o_orderkey % 100) / 100.0::double as c from orders), v as (select k, case when d not in ('increased', 'decreased', 'no_change', 'modified') then 'modified' when d = 'no_change' and px > 500 then 'modified' else d end as direction, f not in ('water', 'forest', 'bare', 'building') or f = t as unc, c from o) select k, direction, unc as uncertain, case when unc then least(c, 0.60::double) else c end as confidence, round(1.0::double - case when unc then least(c, 0.60::double) else c end, 4) as uncertainty from v")
def str4(spark, d):
    """Direction and classes held against what is allowed; an unsure transition's confidence is capped."""
    k = F.col("o_orderkey")
    pick = lambda vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (k % len(vs) + 1).cast("int"))
    o = V.table(spark, d, "orders").select(
        k.alias("k"),
        pick(["increased", "shrunk", "no_change", "modified"]).alias("d"),
        (k % 10 * 200).alias("px"),
        pick(["water", "lava", "forest"]).alias("f"),
        pick(["forest", "bare"]).alias("t"),
        ((k % 100) / 100.0).alias("c"),
    )
    v = T.semantic_validation(F.col("d"), F.col("px"), F.col("f"), F.col("t"), F.col("c"), ["water", "forest", "bare", "building"])
    return o.select("k", v.alias("v")).select("k", "v.*")


@query("str10_gate_answer_match", "with q as (select n_nationkey as k, lower(n_name) as p, lower(right(n_name, 2 + n_nationkey % 3)) as g from nation) select k, p = g or contains(p, g) as strict from q")
def str10(spark, d):
    from ..functions.text import answer_matches

    n = V.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("k"),
        F.col("n_name").alias("p"),
        F.expr("right(n_name, 2 + n_nationkey % 3)").alias("g"),
    )
    return n.select("k", answer_matches(F.col("p"), F.col("g"))["strict"].alias("strict"))
