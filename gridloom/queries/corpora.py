"""Corpus joins, set operations, caps, splits, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import corpus as K
from ..operators import routing as R
from ..plans import registry as P
from . import query

_docs = lambda spark, d, *c: V.table(spark, d, "documents").select("doc_id", *c)


@query("jn10_agg22_first_of_each_hash", "with h as (select doc_id, source, sha256(text) as sha from documents) select min(doc_id) as doc_id, sha from h group by sha")
def jn10(spark, d):
    t = _docs(spark, d, "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return K.first_of_each(t, "sha", "doc_id").select("doc_id", "sha")


@query("jn12_set3_without_quarantine", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def jn12(spark, d):
    return K.without(_docs(spark, d, "source"), V.table(spark, d, "labels"), "doc_id")


@query("jn11_existing", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def jn11(spark, d):
    return _docs(spark, d, "lang").join(V.table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("jn8_annotations", "select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def jn8(spark, d):
    return _docs(spark, d, "lang").join(V.table(spark, d, "labels"), "doc_id")


@query(
    "jn9_members_by_key",
    "select conv_id, max(case when turn = 0 then len(text) end) as t0, max(case when turn = 1 then len(text) end) as t1, "
    "coalesce(sum(case when turn > 1 then len(text) end), -1)::bigint as others from conversations group by conv_id "
    "having t0 is not null and t1 is not null",
)
def jn9(spark, d):
    """The members of a key side by side, the first two by name and all others together: one group-by instead of joins."""
    size = F.length("text").cast("long")
    c = V.table(spark, d, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, size)).alias("t0"),
        F.max(F.when(F.col("turn") == 1, size)).alias("t1"),
        F.coalesce(F.sum(F.when(F.col("turn") > 1, size)), F.lit(-1)).alias("others"),
    )
    return c.where("t0 is not null and t1 is not null")


@query("jn13_provenance", "select doc_id, coalesce(quality, -1) as quality from documents left join labels using (doc_id)")
def jn13(spark, d):
    return _docs(spark, d).join(V.table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id",
        F.coalesce("quality", F.lit(-1)).alias("quality"),
    )


@query("jn15_split_lookup", "select c_custkey, case n_regionkey % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split from customer join nation on c_nationkey = n_nationkey")
def jn15(spark, d):
    n = V.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("n_regionkey") % 3 + 1).alias("split"),
    )
    return V.table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", "split")


@query("win10_stratified_cap", "with r as (select doc_id, source, row_number() over (partition by source order by sha256('s1' || doc_id::varchar), doc_id) as k from documents) select doc_id, source from r where k <= 5")
def win10(spark, d):
    return K.capped(_docs(spark, d, "source"), "source", 5, "s1", "doc_id")


@query("win9_two_caps", "with r as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as k from documents), t as (select doc_id, lang from r where k <= 12) select doc_id, lang from t order by doc_id limit 30")
def win9(spark, d):
    """Up to 12 of each class in order, then the first 30 of all."""
    return K.two_caps(_docs(spark, d, "lang"), "lang", 12, 30, "doc_id")


@query("win11_split", "with h as (select doc_id, sha256('v' || doc_id::varchar) as h from documents), c as (select max(h) as cut from (select h from h order by h limit 120)) select doc_id, case when h <= cut then 'val' else 'train' end as split from h, c")
def win11(spark, d):
    return K.split(_docs(spark, d), 120, "v", "doc_id")


@query("flt18_leaks", "select doc_id, item_id from documents join benchmark on contains(documents.text, benchmark.text)")
def flt18(spark, d):
    """Frozen passages are a table of fixed size beside the corpus; each text is searched where it lies."""
    b = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return K.leaks(_docs(spark, d, "text"), b)


@query("set1_union", "select doc_id as id, lang as tag from documents union all select item_id, null from benchmark union all select conv_id, role from conversations")
def set1(spark, d):
    a = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tag"))
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    c = V.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("tag"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c)


@query("set2_disjoint", "select count(*) as shared from (select doc_id from documents intersect select doc_id from labels where quality = 0)")
def set2(spark, d):
    return _docs(spark, d).intersect(V.table(spark, d, "labels").where("quality = 0").select("doc_id")).agg(F.count(F.lit(1)).alias("shared"))


@query("set4_repeated", "select doc_id, unnest([1, 2, 3]) as copy from labels where toxic = 1")
def set4(spark, d):
    return K.repeated(V.table(spark, d, "labels").where("toxic = 1").select("doc_id"), 3)


@query("set5_distinct", "select count(distinct lang) as langs, count(distinct source) as sources from documents")
def set5(spark, d):
    return _docs(spark, d, "lang", "source").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"))


@query("agg16_grouping_sets", "select lang, source, count(*) as n from documents group by grouping sets ((lang), (source), ())")
def agg16(spark, d):
    return K.statistics(_docs(spark, d, "lang", "source"), "lang", "source")


@query("agg18_split_scenes", "select lang as split, source as scene, count(*) as n, row_number() over (partition by lang order by source nulls first) as place from documents group by lang, source")
def agg18(spark, d):
    """Each language's sources in order, as rows."""
    return K.split_scenes(_docs(spark, d, "lang", "source"), "lang", "source")


@query("ben4_duplicates", "select sha256(text) as sha, count(*) as n from documents group by 1 having count(*) > 1")
def ben4(spark, d):
    t = V.table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"))
    return t.where("n > 1")


@query("ben5_deltas", "with a as (select lang, avg(quality) as q, avg(toxic) as t from documents join labels using (doc_id) group by lang) select a.lang as one, b.lang as two, round(a.q - b.q, 4) as dq, round(a.t - b.t, 4) as dt from a join a b on a.lang < b.lang")
def ben5(spark, d):
    """Each two of the candidates, of which there are a handful: the metrics' differences."""
    m = _docs(spark, d, "lang").join(V.table(spark, d, "labels"), "doc_id").groupBy("lang").agg(
        F.avg("quality").alias("q"),
        F.avg("toxic").alias("t"),
    )
    b = m.select(F.col("lang").alias("two"), F.col("q").alias("q2"), F.col("t").alias("t2"))
    # A row a candidate: a constant key, and the table of candidates is broadcast, being as long as the list of languages.
    return m.join(F.broadcast(b), m["lang"] < b["two"]).select(
        F.col("lang").alias("one"),
        "two",
        F.round(F.col("q") - F.col("q2"), 4).alias("dq"),
        F.round(F.col("t") - F.col("t2"), 4).alias("dt"),
    )


@query("flt15_manifest_counts", "select source as scene_category, count_if(l.quality is not null)::bigint as quantitative, count(*) as n from documents left join labels l using (doc_id) group by source")
def flt15(spark, d):
    t = _docs(spark, d, F.col("source").alias("scene_category")).join(V.table(spark, d, "labels"), "doc_id", "left")
    return K.manifest_counts(t.withColumn("is_quantitative", F.col("quality").isNotNull()))


@query("flt15_manifest_subset", "select doc_id from documents where lang = 'de' and doc_id in (select doc_id from labels)")
def flt15_subset(spark, d):
    t = _docs(spark, d, F.col("lang").alias("scene_category")).join(V.table(spark, d, "labels"), "doc_id", "left")
    return K.manifest_subset(
        t.withColumn("is_quantitative", F.col("quality").isNotNull()),
        category="DE",
        quantitative=True,
    ).select("doc_id")


_HASH = lambda seed: f"sha256('{seed}' || doc_id::varchar)"


@query("ben3_build_corpus", f"""with f as (select sha256(text) as sha, min(doc_id) as doc_id from documents group by 1), l as (select distinct doc_id from documents join benchmark on contains(documents.text, benchmark.text)),
s as (select doc_id, source as stratum, sha from f join documents using (doc_id) where doc_id not in (select doc_id from labels where toxic = 1) and doc_id not in (select doc_id from l)),
k as (select *, row_number() over (partition by stratum order by {_HASH('c')}, doc_id) as n from s), c as (select * from k where n <= 7), t as (select max(h) as cut from (select {_HASH('cv')} as h from c order by h limit 40))
select doc_id, stratum, sha, case when {_HASH('cv')} <= cut then 'val' else 'train' end as split from c, t""")
def ben3(spark, d):
    frozen = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    bad = V.table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return K.build(_docs(spark, d, F.col("source").alias("stratum"), "text"), bad, frozen, per_stratum=7, n_val=40, seed="c")


@query("ben4_inventory", "with h as (select source as dataset, sha256(text) as sha, strlen(coalesce(text, '')) as b, trim(coalesce(text, '')) = '' as bad from documents), e as (select sha, count(*) as copies from h group by sha) select dataset, count(*) as rows, count_if(bad)::bigint as invalid, sum(b)::bigint as bytes, count_if(copies > 1)::bigint as duplicates from h left join e using (sha) group by dataset")
def ben4_inventory(spark, d):
    return K.inventory(_docs(spark, d, F.col("source").alias("dataset"), "text"))


@query("flt11_pair_compatibility", """with o as (select o_orderkey as k, case when o_orderkey % 5 <> 0 then 'A' end as c1, case when o_orderkey % 11 = 0 then 'B' else 'A' end as c2, (o_orderkey % 101) / 100.0::double as share, case when o_orderkey % 6 <> 0 then o_orderdate end as d1, case when o_orderkey % 4 <> 0 then timestamp '1996-01-01' end as d2 from orders),
e as (select *, case when c1 <> c2 and c1 is not null then 'crs_mismatch' when c1 is not null and share < 0.50 then 'low_overlap' end as reason from o)
select k, reason is null as compatible, reason, round(share * 100.0::double, 2) as overlap_pct, case when d1 is null and d2 is null then 'missing_dates' when d1 is null or d2 is null then 'unverified' when d1 >= d2 then 'reversed' else 'valid' end as temporal from e""")
def flt11(spark, d):
    o, k = V.table(spark, d, "orders"), F.col("o_orderkey")
    d1, d2 = F.when(k % 6 != 0, F.col("o_orderdate")), F.when(k % 4 != 0, F.lit("1996-01-01").cast("timestamp"))
    share = (k % 101) / 100.0
    e, w = R.pair_issues(
        F.when(k % 5 != 0, "A"),
        F.when(k % 11 == 0, "B").otherwise("A"),
        share,
        F.lit(10.0),
        F.lit(10.0),
        d1,
        d2,
        F.lit(1.0),
    )
    return o.select(
        k.alias("k"),
        R.pair_compatibility(e, w, share, d1, d2).alias("p"),
    ).select("k", "p.compatible", "p.reason", "p.overlap_pct", "p.temporal")


@query("snk4_status", """with c as (select * from (values ('CHANGE_DETECT', 'change_detection', true, true, 'loaded'), ('CHANGE_VQA', 'change_vqa', false, false, 'unavailable'), ('OPTICAL_SAR_FUSION', 'optical_sar_analysis', true, false, 'ready'), ('RS_CAPTION', 'caption', false, false, 'unavailable'), ('RS_GROUND', 'grounding', false, false, 'unavailable'), ('RS_VQA', 'vqa', false, false, 'unavailable')) v(name, task, built_in, registered, state)),
o as (select ['vqa', 'grounding', 'caption', 'change_detection', 'change_vqa', 'optical_sar_analysis'][o_orderkey % 6 + 1] as task, count(*) as waiting from orders group by 1) select c.*, waiting from c left join o using (task)""")
def snk4(spark, d):
    """What can be asked for now, and how many orders ask for it."""
    r = P.Registry()
    r.register("CHANGE_DETECT", lambda df: df)
    task = F.element_at(F.array(*[F.lit(t) for t in P.STEPS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    waiting = V.table(spark, d, "orders").groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("waiting"))
    return P.status(spark, r).join(waiting, "task", "left").select("name", "task", "built_in", "registered", "state", "waiting")
