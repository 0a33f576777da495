"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Hash buckets of words and word pairs; the table of weights is that long whatever the input.
BUCKETS = 1 << 16
#: Weights are whole numbers of 1 / UNIT, so that sums are the same in any order.
UNIT = 10_000
#: Up to so many trusted ids are broadcast, some 10 bytes each; beyond, they meet the documents by a shuffle.
MAX_BROADCAST = 500_000
#: The threshold lies MARGIN below the score that this share of held-out trusted rows falls short of.
SHORT, MARGIN = 0.002, 0.02
#: Up to so many different windows found twice are looked up one by one in the text's windows.
FEW_TWICE = 32


def _words(text: str) -> str:
    return rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w != '')"


def _buckets(words: str) -> str:
    return (
        f"concat(transform({words}, w -> cast(pmod(xxhash64(w), {BUCKETS}) as int)), " f"slice(zip_with({words}, slice({words}, 2, size({words})), (a, b) -> cast(pmod(xxhash64(a, b), {BUCKETS}) as int)), 1, greatest(size({words}) - 1, 0)))"
    )


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id and fit (true: the target is made of it, false: the threshold) of all trusted ids."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("q")).where("q = 1")
    return good.select("doc_id", (F.pmod(F.xxhash64(F.lit("trusted"), "doc_id"), F.lit(2)) == 0).alias("fit"))


def marked(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts that counts are made of, with raw and target, whether they count as such, and the held-out texts. Many trusted
    ids take one shuffle of the texts, from which the trusted ones are written."""
    texts = docs.select("doc_id", C.texts(docs).alias("text"))
    if trusted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        counted = texts.join(F.broadcast(trusted), "doc_id", "left").select("text", F.lit(True).alias("raw"), F.coalesce("fit", F.lit(False)).alias("target"))
        return counted, texts.join(F.broadcast(trusted.where("not fit")), "doc_id", "left_semi").select("text")
    good = C.written(texts.where("doc_id is not null").join(trusted, "doc_id").select("fit", "text"), "trusted_texts")
    target = good.where("fit").select("text", F.lit(False).alias("raw"), F.lit(True).alias("target"))
    return texts.select("text", F.lit(True).alias("raw"), F.lit(False).alias("target")).union(target), good.where("not fit").select("text")


def weights(texts: DataFrame) -> DataFrame:
    """b, w: by bucket, the log ratio of the trusted target's and the raw corpus's smoothed multinomials, in 1 / UNIT; see marked.

    Every document counts. The counts combine within each task, so at most BUCKETS rows a task are shuffled."""
    words = texts.select("raw", "target", F.expr(_words("text")).alias("ws"))
    seen = words.select("raw", "target", F.explode(F.expr(_buckets("ws"))).alias("b"))
    counts = seen.groupBy("b").agg(F.count_if("raw").alias("raw"), F.count_if("target").alias("target"))
    every = texts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0)
    all_n = every.select("*", F.sum("raw").over(W.partitionBy()).alias("n_raw"), F.sum("target").over(W.partitionBy()).alias("n_target"))
    ratio = F.ln((F.col("target") + 1) / (F.col("n_target") + BUCKETS)) - F.ln((F.col("raw") + 1) / (F.col("n_raw") + BUCKETS))
    return all_n.select("b", F.when(F.col("n_target") == 0, 0).otherwise(F.round(ratio * UNIT).cast("int")).alias("w"))


def _literal(table: DataFrame) -> Column:
    """The BUCKETS whole numbers as one array constant, which the optimizer folds."""
    numbers = ",".join(str(r["w"]) for r in table.orderBy("b").collect())
    return F.split(F.lit(numbers), ",").cast("array<int>")


def _score(w: Column) -> Column:
    total = F.aggregate("bs", F.lit(0).cast("long"), lambda acc, b: acc + F.get(w, b))
    return F.when(F.size("bs") == 0, F.lit(0.0)).otherwise(total / (F.size("bs") * F.lit(UNIT)))


def with_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 min_words: int = 50, max_repeated: int = 50) -> DataFrame:
    """Each row of docs as the struct `row`, beside doc_id and the columns n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score and kept.

    score: mean log-likelihood ratio of the text's hashed words and word pairs, 0 without words. kept: not base_failed
    and at or above one threshold, the score that SHORT of the held-out trusted rows with min_words words fall short
    of, less MARGIN (without such rows, or without trusted ones, only base_failed decides). Null text is an empty one and fails
    the base. Repeated rows are judged alike; an empty table gives no rows; columns of docs can have any name.
    Plan: a pass for the counts, one over the held-out rows for the threshold, one for the verdicts; nothing but
    bucket counts is shuffled, unless more than MAX_BROADCAST ids are trusted (see marked)."""
    C.require(docs, id_col, text_col)
    spark = docs.sparkSession
    given = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[id_col].alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
    )
    texts, held = marked(given, C.written(trusted_ids(labels), "trusted"))
    w = _literal(weights(texts))
    held = held.select(F.expr(_words("text")).alias("ws")).where(F.size("ws") >= min_words).select(F.expr(_buckets("ws")).alias("bs"))
    # A histogram in thousandths: a few thousand rows, the same sum in any order.
    bars = held.select(F.floor(_score(w) * 1000).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()
    limit, left = float("-inf"), SHORT * sum(b["n"] for b in bars)
    for b in bars:
        limit, left = b["k"] / 1000 - MARGIN, left - b["n"]
        if left < 0:
            break
    t = given.withColumn("text", C.texts(given))
    t = t.withColumn("ws", F.expr(_words("text")))
    t = t.withColumn("lines", F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    t = t.withColumn("bs", F.expr(_buckets("ws")))
    # Windows that are found twice: most texts have none, which distinct hashes tell; few different ones are looked up,
    # and only many are found by sorting hashes with their places.
    t = t.withColumn("hs", F.expr("transform(ws, w -> xxhash64(w))"))
    pairs = "zip_with(hs, slice(hs, 2, size(hs)), (a, b) -> xxhash64(a, b))"
    t = t.withColumn(
        "g",
        F.expr(f"slice(zip_with({pairs}, slice(hs, 3, size(hs)), (a, b) -> xxhash64(a, b)), 1, greatest(size(hs) - 2, 0))"),
    )
    t = t.withColumn("sorted", F.expr("if(size(array_distinct(g)) = size(g), cast(array() as array<bigint>), sort_array(g))"))
    t = t.withColumn("twice", F.expr("array_distinct(filter(sorted, (x, i) -> i > 0 and x = sorted[i - 1]))"))
    t = t.withColumn("at", F.expr(f"""
        case when size(twice) = 0 then cast(array() as array<int>)
        when size(twice) <= {FEW_TWICE} then filter(sequence(0, size(g) - 1), i -> array_contains(twice, g[i]))
        else element_at(transform(array(sort_array(zip_with(g, sequence(0, size(g) - 1), (x, i) -> struct(x as g, i as p)))), s ->
            sort_array(transform(filter(s, (x, i) -> get(s, i - 1).g <=> x.g or get(s, i + 1).g <=> x.g), x -> x.p))), 1) end"""))
    judged = F.struct(
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(
            "aggregate(zip_with(at, slice(at, 2, size(at)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)"
        ).alias("n_repeat_words"),
        _score(w).alias("score"),
    )
    # A filter on the verdict stops at the generator; pushed below it, it would work out each array once an element.
    t = t.select("row", "doc_id", F.explode(F.array(judged)).alias("q")).select("row", "doc_id", "q.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    t = t.withColumn("base_failed", failed)
    return t.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(limit)))
