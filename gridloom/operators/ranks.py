"""Numbers of rows in an order over the whole table, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import written


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank from 1 on in this order; rows is a written table. Ranges of the order are numbered each by itself,
    and a row a range tells how many stand before it; equal rows stand in any order and may be cut."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order, "row").withColumn("at", F.monotonically_increasing_id())
    rows = written(rows.drop("row").withColumns({"range": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}), "in_order")
    # As many rows as there are partitions.
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(sizes), "range").withColumn("rank", F.col("at") + F.col("before") + 1).drop("range", "at", "before")
