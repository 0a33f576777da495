"""Questions, routing, answers, dates, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as T
from ..operators import routing as R
from . import query

#: Questions of every route; the conversations' own texts follow the default one.
QUESTIONS = [
    "What changed between these two dates?",
    "How much total area changed?",
    "Where is the water body?",
    "Describe the scene",
    "Generate a caption",
    "Did the buildings increase over time?",
    "Use optical and SAR together to identify flooded land",
    "sar backscatter over the lake",
    "Is there any change?",
    "Locate the runway.",
    "Find the road.",
    "Explain the nature of change",
    "Which land cover dominates?",
    "overall change",
    "has the forest changed",
    "between two images, what was demolished",
    "How many ships are there?",
    "show me where the trees were cleared",
    "radar and optical joint analysis",
    "segment the ponds",
    "give an overview of the image",
    "Detect changes",
    "bi-temporal change detection of cropland",
    "Has the scene changed?",
    "change in this image",
    "dual-sensor view",
    "What does the image show?",
    "highlight the built-up area",
    "the",
    "Where are the ?!",
]
MODES = [
    ("optical", None),
    ("optical", "optical"),
    ("sar", None),
    ("optical", "sar"),
    ("sar", "sar"),
    ("multispectral", "optical"),
    ("unknown", "optical"),
]
HINTS = [None, "auto", "fusion", "semantic change_vqa", "cva_raw", "ground", "caption", "vqa"]


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"


_Q = _values([(q,) for q in QUESTIONS], "query")
_REQ = f"rq as (select q.query, m.m1, m.m2, h.hint from {_Q.replace(' t(', ' q(')}, {_values(MODES, 'm1, m2').replace(' t(', ' m(')}, {_values([(h,) for h in HINTS], 'hint').replace(' t(', ' h(')} union all select text, 'optical', null, null from conversations where role = 'user')"


def _requests(spark, d):
    pick = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    q = pick([(q, m1, m2, h) for q in QUESTIONS for m1, m2 in MODES for h in HINTS], ("query", "m1", "m2", "hint"))
    c = V.table(spark, d, "conversations").where("role = 'user'").select(
        F.col("text").alias("query"),
        F.lit("optical").alias("m1"),
        F.lit(None).cast("string").alias("m2"),
        F.lit(None).cast("string").alias("hint"),
    )
    return q.unionByName(c)


HIT = "fl as (select rq.*, lower(trim(query)) as low, coalesce(hint, '') as hh, " + ", ".join(f"regexp_matches(lower(trim(query)), '{R.any_of(b)}') as is_{k}" for k, b in R.BANKS.items()) + """,
case when m2 is null then 'single_' || m1 when (m1 in ('optical', 'multispectral') and m2 = 'sar') or (m1 = 'sar' and m2 in ('optical', 'multispectral')) then 'cross_modal_optical_sar' when m1 in ('optical', 'multispectral') and m2 in ('optical', 'multispectral') then 'bitemporal_optical_pair' when m1 = 'sar' and m2 = 'sar' then 'bitemporal_sar_pair' else 'dual_' || m1 || '_' || m2 end as config from rq)"""


@query(
    "flt1_pattern_banks",
    "with " + _REQ + ", " + HIT + " select " + ", ".join(f"sum(is_{k}::int)::bigint as {k}" for k in R.BANKS) + " from fl",
)
def flt1(spark, d):
    low = F.lower(F.trim("query"))
    return _requests(spark, d).agg(*[F.sum(low.rlike(R.any_of(b)).cast("long")).alias(k) for k, b in R.BANKS.items()])


ROUTE_STEPS = """, g as (select *, hh not in ('', 'auto', 'none') as given, m2 is null as single, config = 'cross_modal_optical_sar' as crs, config in ('bitemporal_optical_pair', 'bitemporal_sar_pair') as twin, hh like '%fusion%' or hh like '%optical_sar%' or hh like '%cross_modal%' as hf, hh like '%change_vqa%' or hh like '%semantic%' as hs, hh like '%change_detection%' or hh in ('tinycd_raw', 'cva_raw') as hd,
case when is_land_class then true when is_pure_change then false else is_change_words end as sem from fl), o as (select *, case when given and hf then case when single then 'a1' when not crs then 'a2' else 'a' end when given and hs then case when single then 'c1' else 'c' end when given and hd then case when single then 'd1' else 'd' end when given and hh like '%ground%' then 'g' when given and hh like '%caption%' then 'k' when given and hh like '%vqa%' and single then 'v'
when single and (is_temporal or (low like '%change%' and low like '%image%')) then 'd3' when single and is_cross_modal then 'a4' when twin and is_cross_modal then 'a5' when crs and is_temporal and not is_cross_modal then 'd6' when crs then 'a' when not single and sem then 'c' when not single then 'd' when is_grounding then 'g' when is_caption then 'k' else 'v' end as r from g)"""
ROUTED = """select query, m1, m2, hint, config, case left(r, 1) when 'a' then 'optical_sar_analysis' when 'c' then 'change_vqa' when 'd' then 'change_detection' when 'g' then 'grounding' when 'k' then 'caption' else 'vqa' end as task,
case right(r, 1) when '1' then 'needs_two_images' when '2' then 'needs_optical_and_sar' when '3' then 'temporal_on_single' when '4' then 'cross_modal_on_single' when '5' then 'cross_modal_on_one_sensor' when '6' then 'temporal_on_two_sensors' end as rejection,
case when len(r) > 1 then '' else case r when 'a' then 'OPTICAL_SAR_FUSION' when 'c' then 'CHANGE_DETECT,CHANGE_VQA' when 'd' then 'CHANGE_DETECT' when 'g' then 'RS_GROUND' when 'k' then 'RS_CAPTION' else 'RS_VQA' end end as specialists, r = 'c' as multi_stage from o"""


@query("flt2_flt6_route", "with " + _REQ + ", " + HIT + ROUTE_STEPS + " " + ROUTED)
def flt2(spark, d):
    return R.route(_requests(spark, d))


@query("str1_referring_phrase", f"with q as (select query from {_Q} union all select text from conversations where text is not null), p as (select query, trim(regexp_replace(trim(query), '(?i)^({'|'.join(sorted(T.PREFIXES, key=len, reverse=True))})', '')) as t from q), a as (select query, trim(regexp_replace(t, '(?i)^(the |an |a )', '')) as t from p), z as (select query, trim(regexp_replace(t, '[?!.]+$', '')) as t from a) select query, case when t = '' then 'object' else t end || '.' as phrase from z")
def str1(spark, d):
    """Of the fixed questions and of every turn of the conversations."""
    q = spark.createDataFrame([(q,) for q in QUESTIONS], "query string")
    q = q.union(V.table(spark, d, "conversations").where("text is not null").select("text"))
    return q.select("query", T.referring_phrase(F.col("query")).alias("phrase"))


ANSWERS = [
    '{"box_2d": [100, 200, 300, 400]} and more',
    "<|box_start|>(10,20),(30,40)<|box_end|>",
    "at [0.1, 0.2, 0.5, 0.6] and [0.5,0.5,1.0,1.0]",
    "[100, 200, 900, 950]",
    "[1200, 30, 1500, 600]",
    "nothing here",
    '{"direction": "increased", "confidence": 0.8}',
    'so {"direction": "lost", "confidence": "high"} ok',
    'broken "direction": "modified", "confidence": 0.4',
    "",
]


@query("str2_boxes_in_text")
def str2(spark, d):
    """Answers of every grammar, and all texts of the conversations."""
    a = spark.createDataFrame([(a,) for a in ANSWERS], "answer string").union(V.table(spark, d, "conversations").select("text"))
    return a.select("answer", T.boxes_in_text(F.col("answer"), F.lit(2000.0), F.lit(1000.0)).alias("boxes"))


@query(
    "str3_tolerant_json",
    f"with a as (select answer from {_values([(a,) for a in ANSWERS], 'answer')} union all select text || ' {{\"direction\": \"' || role || '\", \"confidence\": ' || turn::varchar || '}} ' || text from conversations where text is not null) select answer, nullif(trim(regexp_extract(answer, '\"direction\"\\s*:\\s*\"?([^\",}}]+)', 1)), '') as direction, nullif(trim(regexp_extract(answer, '\"confidence\"\\s*:\\s*\"?([^\",}}]+)', 1)), '') as confidence from a",
)
def str3(spark, d):
    """Of the fixed answers, and of an object in the midst of every turn of the conversations."""
    a = spark.createDataFrame([(a,) for a in ANSWERS], "answer string")
    c = V.table(spark, d, "conversations").where("text is not null")
    own = F.format_string(' {"direction": "%s", "confidence": %s} ', "role", F.col("turn").cast("string"))
    a = a.union(c.select(F.concat("text", own, "text")))
    return a.select(
        "answer",
        T.json_answer(F.col("answer"), "direction string, confidence string", ["direction", "confidence"]).alias("j"),
    ).select("answer", "j.direction", "j.confidence")


@query("src5_request_batch", "with e as (select user_id, event_id, ts, event_type, (props->>'$.k')::bigint as k from events) select event_id as request, event_type as query, 't1_' || (k % 10)::varchar || '.tif' as t1, case when k % 2 = 0 then 't2_' || (k % 10)::varchar || '.tif' end as t2, case when k % 3 = 0 then 'cva_raw' end as hint from e")
def src5(spark, d):
    """Requests as a batch: two rasters or one, a query and a hint, read from each event's JSON."""
    e = V.table(spark, d, "events")
    k = F.from_json("props", "k bigint")["k"]
    body = F.to_json(
        F.struct(
            F.col("event_id").alias("request"),
            F.col("event_type").alias("query"),
            F.format_string("t1_%d.tif", k % 10).alias("t1"),
            F.when(k % 2 == 0, F.format_string("t2_%d.tif", k % 10)).alias("t2"),
            F.when(k % 3 == 0, "cva_raw").alias("hint"),
        )
    )
    return R.requests_of(e.select(body.alias("body")), "body")


@query("str10_str11_str12_whole_answer_match")
def str10(spark, d):
    """Every user text and the text after it, both whole. No SQL: DuckDB's \\w knows ASCII only."""
    c = V.table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    j = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("pred")).join(b, ["conv_id", "turn"])
    m = T.answer_matches(F.col("pred"), F.col("truth"))
    return j.select("conv_id", "turn", *[v.alias(k) for k, v in m.items()])


@query("str8_str9_kinds", "select page_id, case when contains(lower(url), 'en') then 'en' when contains(lower(url), 'fr') then 'fr' when contains(lower(url), 'de') then 'de' else 'general' end as domain, case when contains(lower(html), 'how many') or contains(lower(html), 'number of') then 'count' when contains(lower(html), 'is there') or contains(lower(html), 'are there') then 'presence' when contains(lower(html), 'more') or contains(lower(html), 'less') then 'comparison' when contains(lower(html), 'rural') or contains(lower(html), 'urban') then 'rural_urban' else 'other' end as kind from pages")
def str8(spark, d):
    p = V.table(spark, d, "pages")
    return p.select(
        "page_id",
        T.scene_domain(F.col("url"), domains=["en", "fr", "de"], other="general").alias("domain"),
        T.question_kind(F.col("html")).alias("kind"),
    )


@query(
    "str9_scene_domain",
    "select doc_id, case " + " ".join(
        f"when contains(lower(text), '{w}') or contains(lower(source), '{w}') then '{w}'"
        for w in T.DOMAINS
    ) + " else 'other' end as domain from documents",
)
def str9(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.scene_domain(F.col("text"), F.col("source")).alias("domain"))


@query(
    "str6_acquisition_date",
    "select o_orderkey, case when o_orderkey % 3 < 2 then strftime(o_orderdate, '%Y-%m-%d') end as d from orders",
)
def str6(spark, d):
    """A third of the orders have the date as a tag, a third in the file's name, a third none."""
    o, k = V.table(spark, d, "orders"), F.col("o_orderkey") % 3
    tags = F.when(
        k == 0,
        F.create_map(F.lit("TIFFTAG_DATETIME"), F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")),
    ).otherwise(F.create_map(F.lit("none"), F.lit("")))
    name = F.when(k == 1, F.concat(F.lit("scene_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".tif"))).otherwise("scene.tif")
    return o.select("o_orderkey", T.acquisition_date(tags, name).cast("string").alias("d"))


@query("str7_paths", "select doc_id, regexp_replace('/tmp/' || source || '.tif and /home/a/b', '/(?:tmp|home|var)/[^\\s''\"]+', '<path>', 'g') as t from documents")
def str7(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id",
        T.without_paths(F.concat(F.lit("/tmp/"), "source", F.lit(".tif and /home/a/b"))).alias("t"),
    )


@query("str16_str17_hashes", "select doc_id, sha256(text) as sha, 'doc_' || left(sha256(source || ':' || doc_id::varchar), 8) as id from documents")
def str16(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        T.stable_id("doc", F.col("source"), F.col("doc_id").cast("string")).alias("id"),
    )


@query("str14_narrative", "with g as (select l_orderkey, sum(case when l_returnflag = 'R' then l_quantity else 0 end)::bigint as px, count(*) as n from lineitem group by 1) select l_orderkey, case when px = 0 then 'No change was found.' else printf('%d px changed over %d parts (%.2f ha).', px, n, px * 100 / 10000.0::double) end as t from g")
def str14(spark, d):
    px = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("long")
    g = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(px.alias("px"), F.count(F.lit(1)).alias("n"))
    return g.select("l_orderkey", T.change_narrative(F.col("px"), F.col("n"), 100.0).alias("t"))


@query("str14_stages_narrative", """select o_orderkey, 'Step 1, detection: ' || o_orderkey % 50 || ' regions. Step 2, interpretation: ' || case when o_orderkey % 3 = 0 then 'nothing was found' else ['more', 'less'][o_orderkey % 2 + 1] || ' water' end || '. Step 3, report: ' || o_orderpriority || '.' as t from orders""")
def str14_stages(spark, d):
    """Three stages of every order, the second of which may find nothing."""
    k = F.col("o_orderkey")
    said = F.when(k % 3 != 0, F.concat(F.when(k % 2 == 0, "more").otherwise("less"), F.lit(" water")))
    found = {"detection": F.format_string("%d regions", k % 50), "interpretation": said, "report": F.col("o_orderpriority")}
    stages = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("finding")) for n, v in found.items()])
    return V.table(spark, d, "orders").select("o_orderkey", T.stages_narrative(stages).alias("t"))


@query("str15_templated_questions", """with s as (select doc_id::varchar as s, case when doc_id % 5 <> 0 then (doc_id % 50 + 1) * 0.5::double end as wide, case when doc_id % 4 <> 0 then (doc_id % 8 + 1) * 0.25::double end as gsd, case when doc_id % 7 = 0 then [] else [lang, source] end as kinds, case when doc_id % 3 = 0 then 'de' when doc_id % 3 = 1 then 'xx' end as absent, case when doc_id % 2 = 0 then 'EPSG:32643' end as crs from documents),
q as (select 'scene' as family, 'What does scene ' || s || ' show?' as question, array_to_string(kinds, ', ') as answer from s where len(kinds) > 0 union all select 'inventory', 'How many kinds are there in scene ' || s || '?', len(kinds)::varchar from s where len(kinds) > 0
union all select 'presence', 'Is there ' || kinds[1] || ' in scene ' || s || '?', 'yes' from s where len(kinds) > 0 union all select 'hard_negative', 'Is there ' || absent || ' in scene ' || s || '?', 'no' from s where absent is not null and not list_contains(kinds, absent) union all select 'crs', 'Which map grid has scene ' || s || '?', crs from s where crs is not null
union all select 'extent', 'How much ground does scene ' || s || ' show?', printf('%.2f x %.2f km', wide, wide * 2) from s where wide is not null union all select 'gsd', 'How large is a pixel of scene ' || s || '?', printf('%.2f m', gsd) from s where gsd is not null) select * from q""")
def str15(spark, d):
    k = F.col("doc_id")
    kinds = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    wide = (k % 50 + 1) * 500.0
    bounds = F.when(k % 5 != 0, F.array(F.lit(1000.0), F.lit(2000.0), wide + 1000.0, wide * 2 + 2000.0))
    absent, crs = F.when(k % 3 == 0, "de").when(k % 3 == 1, "xx"), F.when(k % 2 == 0, "EPSG:32643")
    asked = T.scene_questions(k.cast("string"), kinds, absent, crs, bounds, F.when(k % 4 != 0, (k % 8 + 1) * 0.25))
    t = V.table(spark, d, "documents").select(F.explode(asked).alias("q"))
    return t.select("q.*")


@query("str5_target_classes_of_queries")
def str5_queries(spark, d):
    """Every text of the conversations, and the questions. No SQL: DuckDB's \\b knows ASCII only."""
    t = spark.createDataFrame(
        [(q,) for q in QUESTIONS],
        "query string",
    ).unionByName(V.table(spark, d, "conversations").select(F.col("text").alias("query")))
    return t.select(
        "query",
        F.concat_ws(",", T.target_classes(F.col("query"))).alias("classes"),
        T.target_class(F.col("query")).alias("first"),
    )


_DIRS, _TRUE = ["increased", "no_change", "Decreased", None, "modified", "lost"], [
    ("yes", None),
    ("No", "increased"),
    ("more water", "decreased"),
    ("", ""),
    (None, "lost"),
]


@query("str13_change_answer", f"with o as (select o_orderkey as k, o_orderpriority as a, {str(_DIRS).replace('None', 'null')}[o_orderkey % 6 + 1] as d, {str([t for t, _ in _TRUE]).replace('None', 'null')}[o_orderkey % 5 + 1] as t, {str([x for _, x in _TRUE]).replace('None', 'null')}[o_orderkey % 5 + 1] as td from orders) select k, case when lower(t) = 'yes' then coalesce(lower(d) in ('increased', 'modified', 'decreased'), false) or contains(lower(a), 'yes') when lower(t) = 'no' then coalesce(lower(d) = 'no_change', false) or contains(lower(a), 'no') else coalesce(coalesce(lower(d), 'unknown') = lower(td), false) end as correct from o")
def str13(spark, d):
    k = F.col("o_orderkey")
    pick = lambda vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (k % len(vs) + 1).cast("int"))
    o = V.table(spark, d, "orders")
    return o.select(
        k.alias("k"),
        T.change_answer_correct(
            F.col("o_orderpriority"),
            pick(_DIRS),
            pick([t for t, _ in _TRUE]),
            pick([x for _, x in _TRUE]),
        ).alias("correct"),
    )


_SENS = ["Sentinel-1 GRD", "S2 MSI", "gas1 none", "Landsat 8", "", "ALOS PALSAR", "spotted"]
_MOD = f"with x as (select n_nationkey as k, [{', '.join(repr(s) for s in _SENS)}][n_nationkey % 7 + 1] as sensor, case n_nationkey % 5 when 0 then ['VV', 'VH'] when 1 then ['red', 'VV'] else []::varchar[] end as bands, ['a_s1_b.tif', 'optical.tif', 'x.tif'][n_nationkey % 3 + 1] as name, n_regionkey * 2 + 1 as nb, ['uint8', 'float32', 'uint16'][n_nationkey % 3 + 1] as dt, n_nationkey <> 7 as ok from nation)"


@query("flt7_modality", _MOD + r""" select k, case when not ok then 'optical' when regexp_matches(lower(sensor), '(^|[^a-z0-9])(sentinel-1|s1|risat|terrasar|cosmo-skymed|alos|radarsat)($|[^a-z0-9])') then 'sar' when regexp_matches(lower(sensor), '(^|[^a-z0-9])(sentinel-2|s2|landsat|planet|spot|naip|worldview|pleiades)($|[^a-z0-9])') then 'optical'
when len(bands) > 0 and len(list_filter(bands, lambda b: regexp_matches(lower(b), 'vv|vh|hh|hv'))) = len(bands) then 'sar' when name = 'a_s1_b.tif' then 'sar' when name = 'optical.tif' then 'optical' when nb in (3, 4) and dt in ('uint8', 'uint16') then 'optical' when nb in (1, 2) and dt = 'float32' then 'sar' when nb >= 8 and dt in ('uint16', 'float32') then 'multispectral' else 'optical' end as modality,
case when not ok then 0.0 when regexp_matches(lower(sensor), '(^|[^a-z0-9])(sentinel-1|s1|alos|sentinel-2|s2|landsat|spot)($|[^a-z0-9])') then 0.99 when len(bands) > 0 and len(list_filter(bands, lambda b: regexp_matches(lower(b), 'vv|vh|hh|hv'))) = len(bands) then 0.95 when name <> 'x.tif' then 0.85 when nb in (3, 4) and dt in ('uint8', 'uint16') then 0.75 when nb in (1, 2) and dt = 'float32' then 0.68 when nb >= 8 and dt in ('uint16', 'float32') then 0.70 else 0.30 end::double as confidence from x""")
def flt7(spark, d):
    n, at = V.table(spark, d, "nation"), lambda vs, m: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col("n_nationkey") % m + 1))
    bands = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("VV"), F.lit("VH"))).when(
        F.col("n_nationkey") % 5 == 1,
        F.array(F.lit("red"), F.lit("VV")),
    ).otherwise(F.array().cast("array<string>"))
    m = R.modality(
        at(_SENS, 7),
        bands,
        at(["a_s1_b.tif", "optical.tif", "x.tif"], 3),
        F.col("n_regionkey") * 2 + 1,
        at(["uint8", "float32", "uint16"], 3),
        F.col("n_nationkey") != 7,
    )
    return n.select(F.col("n_nationkey").alias("k"), m.alias("m")).select("k", "m.modality", "m.confidence")


@query("src3_src4_metadata_summary", "select s_suppkey, coalesce(case when s_suppkey % 2 = 0 then s_name end, case when s_suppkey % 3 = 0 then 'alt' end, 'unknown sensor') || ', ' || coalesce(case when s_nationkey > 5 then 'EPSG:' || (32600 + s_nationkey)::varchar end, 'no CRS') || ', ' || case when s_suppkey % 5 = 0 then 'size unknown' else (s_suppkey % 100)::varchar || ' x ' || (s_suppkey % 30)::varchar || ' px' end as summary from supplier")
def src3(spark, d):
    s, k = V.table(spark, d, "supplier"), F.col("s_suppkey")
    tags = F.map_concat(
        F.when(k % 2 == 0, F.create_map(F.lit("SENSOR_ID"), "s_name")).otherwise(F.create_map().cast("map<string,string>")),
        F.when(k % 3 == 0, F.create_map(F.lit("PLATFORM"), F.lit("alt"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    crs = F.when(F.col("s_nationkey") > 5, F.concat(F.lit("EPSG:"), (F.col("s_nationkey") + 32600).cast("string")))
    sensor = T.sensor(tags)
    side = lambda n: F.when(k % 5 != 0, k % n)
    return s.select("s_suppkey", T.spatial_summary(sensor, crs, side(100), side(30)).alias("summary"))
