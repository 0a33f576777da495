"""A session with the settings that the operators assume, and the library's own settings (SRC13); all are overridable."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


def session(name: str = "gridloom", **conf) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config(
        "spark.sql.adaptive.skewJoin.enabled",
        "true",
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


@dataclass(frozen=True)
class Settings:
    """Each is read from the session's gridloom.<name>, else from the environment's GRIDLOOM_<NAME>, else from a file of
    such lines, else it is the default."""

    tile: int = 512
    least_region: int = 16
    most_regions: int = 50
    iou_threshold: float = 0.70
    meters_per_pixel: float = 10.0

    @classmethod
    def of(cls, spark: SparkSession, env_file: str | None = None) -> Settings:
        lines = {}
        if env_file and os.path.isfile(env_file):
            with open(env_file, encoding="utf-8") as f:
                for line in f:
                    key, eq, value = line.partition("=")
                    if eq and not key.lstrip().startswith("#"):
                        lines[key.strip()] = value.strip().strip("'\"")
        found = {}
        for x in fields(cls):
            env = f"GRIDLOOM_{x.name.upper()}"
            value = spark.conf.get(f"gridloom.{x.name}", None) or os.environ.get(env) or lines.get(env)
            if value is not None:
                found[x.name] = type(x.default)(value)
        return cls(**found)
