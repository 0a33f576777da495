"""What the operators of this package share: written tables, ordered blocks."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import fresh_path, written  # noqa: F401

#: The white space that separates words, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written_by(df: DataFrame, name: str, batch_rows: int) -> DataFrame:
    """written, with batches of at most batch_rows rows between Spark and its Python workers: bounds what texts take there."""
    spark = df.sparkSession
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(batch_rows))
    try:
        return written(df, name)
    finally:
        spark.conf.set(BATCH, before)


def texts(df: DataFrame, text_col: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def _cuts(df: DataFrame, key: str, rows_per_block: int, max_blocks: int) -> list[int]:
    n = df.count()
    k = min(max(1, -(-n // rows_per_block)), max_blocks)
    if k == 1:
        return []
    cuts = df.select(F.percentile_approx(key, [i / k for i in range(1, k)], max(10_000, 20 * k)).alias("c")).first()["c"]
    return [int(c) for c in cuts or []]


def id_splits(df: DataFrame, key: str, rows_per_block: int, max_blocks: int) -> list[int]:
    """Ascending keys that cut the rows into blocks of about rows_per_block rows, each key being one
    that occurs. At most max_blocks - 1 numbers come to the driver, however large the input."""
    return sorted(set(_cuts(df, key, rows_per_block, max_blocks)))


def block_of(key: Column, splits: list[int]) -> Column:
    """The number of splits at or below the key; a null key comes before all. Two short scans of
    about sqrt(len(splits)) literals a row."""
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    rows = [splits[i : i + step] for i in range(0, len(splits), step)]
    below = lambda values: F.size(F.filter(values, lambda s: s <= key))
    coarse = below(F.lit([r[0] for r in rows]))
    fine = below(F.element_at(F.lit([r + [2**63 - 1] * (step - len(r)) for r in rows]), coarse))
    return F.when(key.isNull() | (key < splits[0]), F.lit(0)).otherwise((coarse - 1) * step + fine)


def with_prefix(
    rows: DataFrame,
    key: str,
    ties: tuple[str, ...],
    value: str,
    *,
    spread: Column | None = None,
    rows_per_block: int = 1_000,
    max_blocks: int = 20_000,
) -> DataFrame:
    """rows with start (the sum of value over all rows before), rank (their number) and total (the sum of value),
    in ascending order of key, a null key first, then ties. rows is read several times: give a written table.

    Sums within blocks of consecutive keys plus the sums of the blocks before; the table of blocks has at most
    max_blocks rows but for hot keys, so it is broadcast. spread rises with the ties and cuts a key that fills several
    blocks, and the rows without a key, into parts of their own; it takes few values, such as 256."""
    cuts = _cuts(rows, key, rows_per_block, max_blocks)
    splits, hot = sorted(set(cuts)), sorted(k for k, n in Counter(cuts).items() if n > 1)
    part = F.lit(None) if spread is None else F.when(rows[key].isNull() | rows[key].isin(hot), spread)
    # A hot key begins its block, as does a null one: its parts come before the rest.
    rows = rows.withColumn(
        "block",
        F.struct(
            block_of(rows[key], splits).alias("k"),
            part.isNull().alias("rest"),
            F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        ),
    )
    sums = rows.groupBy("block").agg(F.sum(value).alias("b"), F.count(F.lit(1)).alias("r"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "block",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"),
        F.sum("b").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("block").orderBy(F.col(key).asc_nulls_first(), *ties).rowsBetween(W.unboundedPreceding, -1)
    at = rows.withColumn("start", F.coalesce(F.sum(value).over(inside), F.lit(0))).withColumn(
        "rank",
        F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)),
    )
    at = at.join(F.broadcast(sums), "block").withColumns({"start": F.col("start") + F.col("b0"), "rank": F.col("rank") + F.col("r0")})
    return at.drop("block", "b0", "r0")
