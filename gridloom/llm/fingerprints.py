"""Winnowing fingerprints of whole documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Code points in a gram, and grams in a window: a passage of K + WINDOW - 1 code points that two texts share is found.
K, WINDOW = 16, 49
ROWS_PER_BLOCK, MAX_BLOCKS = 500, 50_000


def picks(text: str, k: int = K, window: int = WINDOW) -> str:
    """SQL for the array of a text's picked grams, each (31 bits of hash) << 32 | (2^32 - 1 - position), in order of position.

    UTF-32 gives each code point four bytes, so that a gram is a slice found without counting characters. A gram's
    hash stands above the position counted down: the least of a window is its smallest hash, the rightmost of equal
    ones. A window's least comes from runs of twice the length at each step, the last two of them overlapping.
    A text of fewer than k code points is one gram; one of fewer than `window` grams is one window; an empty one has none."""
    raw = f"encode({text}, 'UTF-32')"
    grams = (
        f"transform(sequence(0, greatest(length({text}) - {k}, 0)), i -> shiftleft(xxhash64(substring(raw, 4 * i + 1, {4 * k})) & 2147483647, 32) | (4294967295L - i))"
    )
    steps, run = [], 1
    while run < window:
        by = min(run, window - run)
        steps.append(by)
        run += by
    # Each step stands in a lambda of its own, so that what it reads is worked out once.
    body = "m"
    for by in reversed(steps):
        body = f"element_at(transform(array(zip_with(m, slice(m, {by + 1}, size(m)), (a, b) -> least(a, b))), m -> {body}), 1)"
    least = f"element_at(transform(array({grams}), m -> {body}), 1)"
    least = f"element_at(transform(array({least}), m -> array_distinct(slice(m, 1, greatest(size(m) - {window - 1}, 1)))), 1)"
    return f"if(length({text}) = 0, cast(array() as array<bigint>), element_at(transform(array({raw}), raw -> {least}), 1))"


def as_text(p: Column) -> Column:
    """hash@position of each pick, in hexadecimal and decimal, comma-joined."""
    one = lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, 32))),
        F.lit("@"),
        (F.lit(4294967295) - x.bitwiseAND(F.lit(4294967295))).cast("string"),
    )
    return F.concat_ws(",", F.transform(p, one))


def hashes(p: Column) -> Column:
    return F.array_distinct(F.transform(p, lambda x: F.shiftright(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, picks, next_text, next_picks: each document beside the one after it by (id, text), the last beside the first.

    A null id comes first; rows with equal ids, and those without one, stand by text, in one block, as ids are meant to
    be a document's own; one row alone is its own next; null text is empty.
    Plan: blocks of consecutive ids hold a copy of the next block's first rows, so one shuffle of the texts brings
    neighbours together, whatever the ids are."""
    C.require(docs, id_col, text_col)
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"))
    splits = C.id_splits(ids, "doc_id", ROWS_PER_BLOCK, MAX_BLOCKS)
    least = ids.agg(F.min("doc_id").alias("m"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    least_id = None if least["nulls"] else least["m"]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), C.texts(docs, text_col).alias("text"))
    rows = rows.withColumn("picks", F.expr(picks("text")))
    block = C.block_of(F.col("doc_id"), splits)
    home = F.struct(block.alias("block"), F.lit(0).alias("wrap"), F.lit(False).alias("guest"))
    before = F.when(
        F.col("doc_id").isin(splits),
        F.struct((block - 1).alias("block"), F.lit(0).alias("wrap"), F.lit(True).alias("guest")),
    ) if splits else F.lit(None).cast("struct<block: int, wrap: int, guest: boolean>")
    first = F.when(
        F.col("doc_id").eqNullSafe(F.lit(least_id)),
        F.struct(F.lit(len(splits)).alias("block"), F.lit(1).alias("wrap"), F.lit(True).alias("guest")),
    )
    rows = rows.withColumn("at", F.explode(F.array_compact(F.array(home, before, first)))).select("doc_id", "text", "picks", "at.*")
    w = W.partitionBy("block").orderBy("wrap", F.col("doc_id").asc_nulls_first(), "text", "guest")
    after = F.lead(F.struct("text", "picks")).over(w)
    return rows.withColumn("after", after).where("not guest").select(
        "doc_id",
        "text",
        "picks",
        F.col("after.text").alias("next_text"),
        F.col("after.picks").alias("next_picks"),
    )


LOW = 4294967295


def _moved(picks_: str, by: str, low: str, high: str) -> str:
    """SQL for the picks with positions greater by `by`, those from low to high."""
    at = f"({LOW}L - (x & {LOW}L))"
    return f"filter(transform({picks_}, x -> x - cast({by} as bigint)), x -> {at} >= {low} and {at} <= {high})"


def fingerprint_edits(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_chars, edited (text), picks, edited_picks, next_picks.

    The edited text has its last floor(n / 2) code points replaced by as many of the next document's first ones, or by
    all that it has. A pick depends on the windows that hold it and on nothing else, so the edited text's picks are
    the document's own as far as all their windows lie before the edit, the next one's where they lie in what it gives,
    and only those around the two seams are worked out anew. An empty table gives no rows; extra columns of docs are
    ignored."""
    t = with_next(docs, **options)
    t = t.withColumn("n", F.length("text")).withColumn("h", F.floor(F.col("n") / 2).cast("int")).withColumn("a", F.col("n") - F.col("h"))
    t = t.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("a")), F.substring("next_text", F.lit(1), F.col("h"))))
    # Grams of the edited text and of what the next gives; the last own pick and the first and last of the next's that stay.
    t = t.withColumn("m", F.length("edited")).withColumn(
        "grams",
        F.greatest(F.col("m") - K + 1, F.lit(1)),
    ).withColumn("given", F.col("m") - F.col("a") - K + 1)
    t = t.withColumn("own_to", F.col("a") - K + 1 - WINDOW).withColumn("next_from", F.col("a") + WINDOW - 1).withColumn(
        "next_to",
        F.col("a") + F.col("given") - WINDOW,
    )
    has = F.col("next_to") >= F.col("next_from")
    t = t.withColumn("lo1", F.greatest(F.col("own_to") + 1, F.lit(0))).withColumn(
        "hi1",
        F.when(has, F.col("next_from") - 1).otherwise(F.col("grams") - 1),
    )
    t = t.withColumn("lo2", F.when(has, F.col("next_to") + 1).otherwise(F.col("grams"))).withColumn("hi2", F.col("grams") - 1)
    for z in "12":
        t = t.withColumn(f"s{z}", F.greatest(F.col(f"lo{z}") - (WINDOW - 1), F.lit(0)))
        t = t.withColumn(
            f"seam{z}",
            F.when(
                F.col(f"lo{z}") <= F.col(f"hi{z}"),
                F.substring("edited", F.col(f"s{z}") + 1, F.col(f"hi{z}") - F.col(f"s{z}") + WINDOW - 1 + K),
            ).otherwise(""),
        )
    t = t.withColumns({f"p{z}": F.expr(picks(f"seam{z}")) for z in "12"})
    parts = [
        _moved("picks", "0", "0", "own_to"),
        _moved("p1", "s1", "lo1", "hi1"),
        _moved("next_picks", "a", "next_from", "next_to"),
        _moved("p2", "s2", "lo2", "hi2"),
    ]
    return t.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited",
        "picks",
        F.expr(f"concat({', '.join(parts)})").alias("edited_picks"),
        "next_picks",
    )
