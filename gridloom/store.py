"""Tables written between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session of one machine writes if it names no folder.
LOCAL_DIR = "/tmp/checkpoints/gridloom"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine serves only if the executors
    run in the driver's own process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        named = LOCAL_DIR
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}/{name}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, so that a lost executor costs a
    re-read, and several readers share one computation."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
