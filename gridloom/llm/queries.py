"""The thin queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import in_order, scan_secrets

    out = scan_secrets(_docs(spark, sf_dir))
    of = lambda kind: F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long")
    live = lambda yes: F.size(F.filter("found", lambda x: x["live"] if yes else ~x["live"])).cast("long")
    most = lambda what: F.coalesce(F.array_max(F.transform("found", lambda x: x[what])), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(F.concat_ws(",", "base").cast("binary"), 256).alias("base_sha256"),
        in_order(F.transform("found", lambda x: x["span"])).alias("spans"),
        live(True).alias("n_live"),
        live(False).alias("n_copied"),
        most("owners").alias("most_owners"),
        most("repositories").alias("most_repositories"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import as_text, fingerprint_edits, hashes, likeness

    t = fingerprint_edits(_docs(spark, sf_dir))
    own = hashes(F.col("picks"))
    return t.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("picks")).alias("fingerprint"), as_text(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_picks"))).alias("near_edited"), likeness(own, hashes(F.col("next_picks"))).alias("near_next"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import with_quality

    return with_quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import fresh_path
    from .tokens import digests, encode_documents, read_tokens, write_tokens

    path = fresh_path(spark, "tokens")
    write_tokens(encode_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")), path)
    return digests(read_tokens(spark, path))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import link_documents

    return link_documents(_docs(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(_docs(spark, sf_dir), 40)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_counts

    return mix_counts(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_docs(spark, sf_dir))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_wordpieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .wordpieces import encode_pieces, piece_digests

    return piece_digests(encode_pieces(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))


OP6_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [hash(array_to_string(ws, ' '))]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]))) end as sh from w),
f as (select doc_id, unnest(sh) as g from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from f a join f b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select p.x, p.y from p join s a on a.doc_id = p.x join s b on b.doc_id = p.y where 100 * k >= 75 * (len(a.sh) + len(b.sh) - k)),
r(x, y) as (select doc_id, doc_id from s union select r.x, l.y from r join l on l.x = r.y)
select s.doc_id, len(s.sh)::bigint as n_shingles, min(r.y) as component_id from s join r on r.x = s.doc_id group by s.doc_id, s.sh
"""

OP9_SQL = r"""
with d as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size from documents),
t as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight,
  row_number() over (order by source is null, source) as n, source_size * 2.0::double as cap from t),
g as (select *, sum(source_size) over ()::bigint * 1.5::double as goal, sum(weight) over () as all_w,
  coalesce(sum(cap) over b, 0) as cap0, coalesce(sum(weight) over b, 0) as w0
  from w window b as (order by cap / weight, n rows between unbounded preceding and 1 preceding)),
f as (select *, (goal - cap0) * weight >= cap * (all_w - w0) as at_cap from g),
h as (select *, coalesce(sum(cap) filter (where at_cap) over (), 0) as cap_full, coalesce(sum(weight) filter (where at_cap) over (), 0) as w_full from f),
p as (select source, source_size, case when at_cap then cap else (goal - cap_full) / (all_w - w_full) * weight end as target,
  case when source_size = 0 then 0 when at_cap then 2.0::double else (goal - cap_full) / (all_w - w_full) * weight / source_size end as rate from h)
select d.doc_id, d.size, p.source_size, p.target,
  case when d.size = 0 then 0 else (floor(rate)::bigint + case when ('0x' || substr(md5('mix:' || d.doc_id::varchar), 1, 13))::bigint::double / 4503599627370496.0::double < rate - floor(rate) then 1 else 0 end) * d.size end::bigint as taken
from d join p on d.source is not distinct from p.source
"""

OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (select lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(ws) - m + 2), lambda i: {'m': m, 'p': array_to_string(ws[i:i + m - 1], ' ')}))), recursive := true) from w),
f as (select lang, m, p, count(*) as a from g group by all),
n as (select lang, sum(a)::bigint as n from f where m = 1 group by lang),
c as (select *, string_split(p, ' ') as ws from f where m > 1 and a >= 100),
k as (select lang, m, p, a, ws, unnest(range(1, m)) as k from c),
s as (select k.*, x.a as l, y.a as r, n.n, (1000::hugeint * k.a * n.n) // (x.a::hugeint * y.a) as score from k
  join f x on x.lang = k.lang and x.p = array_to_string(k.ws[1:k.k], ' ') join f y on y.lang = k.lang and y.p = array_to_string(k.ws[k.k + 1:], ' ') join n on n.lang = k.lang),
t as (select * from s qualify row_number() over (partition by lang, p order by score, k) = 1),
i as (select lang, unnest(flatten(list_transform(range(2, m), lambda j: list_transform(range(1, m - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))))) as p, a from c),
j as (select lang, p, max(a) as longer from i group by all),
o as (select t.lang, t.p as phrase, t.a, t.l, t.r, t.n, t.score::bigint as score from t left join j on j.lang = t.lang and j.p = t.p where longer is null or 100 * longer < 100 * t.a),
q as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
select lang, rank, phrase, a, l, r, n, score from q where rank <= 2000
"""


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality_rules": op4_quality_rules,
    "op5_tokens": op5_tokens,
    "op6_ngram_join": op6_ngram_join,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_html": op10_html,
    "op11_collocations": op11_collocations,
    "op12_resampling": op12_resampling,
    "op13_wordpieces": op13_wordpieces,
}
SQL = {"op6_ngram_join": OP6_SQL, "op9_mixing": OP9_SQL, "op11_collocations": OP11_SQL}
