"""Scenes, pairs, boxes and samples derived from the star-schema tables, for queries and benchmarks.

An embedding row is one image row: scene = vec_id div 100, line = vec_id div 2 mod 50, time = vec_id mod 2, and each
four numbers are the bands of a pixel. So a scene has 50 x 16 pixels of four bands at two times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, t, y, x, bands."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda z: z.cast("double"))
    rows = e.select(
        F.floor(F.col("vec_id") / 100).alias("scene"),
        (F.col("vec_id") % 2).cast("int").alias("t"),
        (F.floor(F.col("vec_id") / 2) % 50).cast("int").alias("y"),
        v.alias("v"),
    )
    return rows.select(
        "scene",
        "t",
        "y",
        F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"),
        "v",
    ).select("scene", "t", "y", "x", F.slice("v", F.col("x") * 4 + 1, 4).alias("bands"))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, y, x, a, b: both times of a pixel, aligned on the grid (JN1)."""
    p = pixels(spark, sf_dir)
    one, two = p.where("t = 0").select(
        "scene",
        "y",
        "x",
        F.col("bands").alias("a"),
    ), p.where("t = 1").select("scene", "y", "x", F.col("bands").alias("b"))
    return one.join(two, ["scene", "y", "x"])


def changed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair with a block of the second time raised in three of four scenes, its place varying with the scene: what is to be found."""
    y, x, n = F.col("y"), F.col("x"), F.col("scene")
    block = (n % 4 != 0) & (y >= 8 + n % 7) & (y < 28 + n % 9) & (x >= 2 + n % 3) & (x < 12)
    return pair(spark, sf_dir).withColumn("b", F.when(block, F.transform("b", lambda v: v + 1.5)).otherwise(F.col("b")))


def optical_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, y, x, r, g, b, sar in 0..1: bands 0 to 2 and 3 of time 0, rescaled."""
    u = lambda i: (F.get("bands", F.lit(i)) + 1.0) / 2.0
    return pixels(spark, sf_dir).where("t = 0").select(
        "scene",
        "y",
        "x",
        u(0).alias("r"),
        u(1).alias("g"),
        u(2).alias("b"),
        u(3).alias("sar"),
    )


def each_optical_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """optical_sar of both times, each a scene of its own: scene * 2 + time."""
    u = lambda i: (F.get("bands", F.lit(i)) + 1.0) / 2.0
    names = ("r", "g", "b", "sar")
    return pixels(spark, sf_dir).select((F.col("scene") * 2 + F.col("t")).alias("scene"), "y", "x", *[u(i).alias(n) for i, n in enumerate(names)])


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, ord, x0, y0, x1, y1, score in a 512 x 512 image: an order's lines."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x0, y0 = (F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") * 37 % 400).cast("double")
    return l.select(
        F.col("l_orderkey").alias("image"),
        F.col("l_linenumber").alias("ord"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.col("l_quantity") * 4).alias("x1"),
        (y0 + F.col("l_quantity") * 3).alias("y1"),
        F.col("l_discount").alias("score"),
    )


SQL = {
    "px": "px as (select vec_id // 100 as scene, (vec_id % 2)::int as t, ((vec_id // 2) % 50)::int as y, x.x::int as x, list_transform(embedding[x.x * 4 + 1 : x.x * 4 + 4], lambda z: z::double) as bands from embeddings, (select unnest(range(16)) as x) x)",
    "pair": "pair as (select p.scene, p.y, p.x, p.bands as a, q.bands as b from px p join px q using (scene, y, x) where p.t = 0 and q.t = 1)",
    "cpair": "cpair as (select scene, y, x, a, case when scene % 4 <> 0 and y >= 8 + scene % 7 and y < 28 + scene % 9 and x >= 2 + scene % 3 and x < 12 then list_transform(b, lambda z: z + 1.5::double) else b end as b from pair)",
    "os": "os as (select scene, y, x, (bands[1] + 1.0::double) / 2.0::double as r, (bands[2] + 1.0::double) / 2.0::double as g, (bands[3] + 1.0::double) / 2.0::double as b, (bands[4] + 1.0::double) / 2.0::double as sar from px where t = 0)",
    "ost": "os as (select scene * 2 + t as scene, y, x, (bands[1] + 1.0::double) / 2.0::double as r, (bands[2] + 1.0::double) / 2.0::double as g, (bands[3] + 1.0::double) / 2.0::double as b, (bands[4] + 1.0::double) / 2.0::double as sar from px)",
    "bx": "bx as (select l_orderkey as image, l_linenumber as ord, (l_partkey % 400)::double as x0, (l_suppkey * 37 % 400)::double as y0, (l_partkey % 400) + l_quantity * 4 as x1, (l_suppkey * 37 % 400) + l_quantity * 3 as y1, l_discount as score from lineitem)",
}


def with_views(*names: str) -> str:
    """A WITH clause of the views; a query's own may follow after a comma."""
    need = {"pair": ["px", "pair"], "cpair": ["px", "pair", "cpair"], "os": ["px", "os"], "ost": ["px", "ost"]}
    order = [v for n in names for v in need.get(n, [n])]
    return "with " + ", ".join(SQL[v] for v in dict.fromkeys(order))
