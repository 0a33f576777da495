"""An extension: questions that arrive as files are routed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import route

REQUEST = "request long, asked timestamp, query string, m1 string, m2 string, hint string"


def routed_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON files that appear in path, with their route: columns only, so nothing is kept between batches."""
    return route(spark.readStream.schema(REQUEST).json(path))


def tasks_per_window(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests by window and task; state is dropped once a window is later than `late`."""
    return stream.withWatermark("asked", late).groupBy(F.window("asked", window), "task").agg(F.count(F.lit(1)).alias("n"))
