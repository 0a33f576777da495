"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from . import common as C

#: Up to as many sources the table of targets is broadcast (a few hundred KB); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 5_000
#: Up to as many ids that several rows share are broadcast (some MB as a hash table); beyond, they are joined by a shuffle.
BROADCAST_IDS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(C.WORD)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    hexa = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(hexa, 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def targets(totals: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size -> target and rate.

    Sources by code point, null last, weigh weights in turn and share `share` times the sum; a target stops
    at cap times its source's size, the excess going to the others by weight. That fixed point is a water
    level: with sources by cap/weight ascending, one is at its cap as long as the level that the ones before
    leave reaches its cap. One row a source goes through the two ordered windows."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    t = totals.withColumn("n", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), (F.pmod("n", F.lit(len(weights))) + 1).cast("int")))
    everything = W.partitionBy()
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn(
        "goal",
        F.sum("source_size").over(everything) * F.lit(float(share)),
    ).withColumn("all_w", F.sum("weight").over(everything))
    before = W.orderBy(F.col("cap") / F.col("weight"), "n").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("cap0", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn(
        "w0",
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    )
    t = t.withColumn("full", (F.col("goal") - F.col("cap0")) * F.col("weight") >= F.col("cap") * (F.col("all_w") - F.col("w0")))
    part = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(everything), F.lit(0.0))
    t = t.withColumn("cap_full", part("cap")).withColumn("w_full", part("weight"))
    level = (F.col("goal") - F.col("cap_full")) / (F.col("all_w") - F.col("w_full"))
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")))
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("full"), F.lit(float(cap))).otherwise(F.col("target") / F.col("source_size"))
    return t.select("source", "source_size", "target", rate.alias("rate"))


def mix_counts(docs: DataFrame, *, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: str = "mix",
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document's number of copies: doc_id, source, size, source_size, target, rate, copies, taken and the columns in keep.

    Null text has size 0 and is never taken; a null source is a source of its own, the last. Repeated rows each count.
    A row draws by its id; rows that share one, and those without one, draw each for itself, by their place among all such
    rows in the order of id, text and source, so that they meet their targets, too, and reruns agree. A source's taken words miss its target by the draws' deviation,
    the root of f (1 - f) times the sum of its sizes' squares, f being the rate's fraction: little where no document is
    a large part of its source. An empty table gives no rows. Other columns are ignored.
    Plan: one pass over the texts writes (id, source, size); ids are counted, and rows of shared ones ranked; totals combine before their shuffle, so a source
    with most rows is one row a task; the small table of targets is broadcast below BROADCAST_SOURCES sources."""
    C.require(docs, id_col, text_col, source_col)
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    if not keep:
        sizes = C.written(sizes, "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = C.written(targets(totals, share, cap, weights).withColumnRenamed("source", "of"), "targets")
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = _with_draws(sizes, seed).join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
    whole = F.floor("rate")
    extra = F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0)
    out = out.withColumn("copies", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(whole + extra))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("draw", "text_hash")


def _with_draws(rows: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id, text_hash, source and others) with draw, a number in [0, 1)."""
    shared = rows.groupBy(F.col("doc_id").alias("twice")).agg(F.count(F.lit(1)).alias("n"))
    shared = C.written(shared.where("n > 1 or twice is null").select("twice"), "shared_ids")
    own = unit_hash(F.col("doc_id"), seed)
    if not shared.limit(1).count():
        return rows.withColumn("draw", own)
    few = shared.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    met = (F.broadcast(shared) if few else shared), F.col("doc_id").eqNullSafe(F.col("twice"))
    again = ranked(C.written(rows.join(*met, "left_semi"), "sharing"), F.asc_nulls_first("doc_id"), F.asc("text_hash"), F.asc_nulls_first("source"))
    place = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("rank").cast("string"))
    again = again.withColumn("draw", unit_hash(place, seed)).drop("rank")
    return rows.join(*met, "left_anti").withColumn("draw", own).unionByName(again)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row floor(rate) times, plus once more where its draw falls below the fraction."""
    out = mix_counts(docs, keep=tuple(docs.columns), **options)
    out = out.withColumn(
        "copy",
        F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))),
    )
    return out.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])
