"""Specialists by capability, and the steps of each task's plan, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Specialists, their tasks, modalities and numbers of inputs, and which are built in.
SPECIALISTS = [
    ("RS_VQA", "vqa", ["optical", "multispectral", "sar"], [1], False),
    ("RS_GROUND", "grounding", ["optical", "multispectral"], [1], False),
    ("RS_CAPTION", "caption", ["optical", "multispectral"], [1], False),
    ("CHANGE_DETECT", "change_detection", ["optical", "multispectral", "sar"], [2], True),
    ("CHANGE_VQA", "change_vqa", ["optical", "multispectral"], [2], False),
    ("OPTICAL_SAR_FUSION", "optical_sar_analysis", ["optical", "sar"], [2], True),
]
STEPS = {
    "vqa": ["receive", "inspect", "route", "validate", "infer", "evidence", "confidence", "report"],
    "grounding": ["receive", "inspect", "route", "validate", "normalise_phrase", "infer", "boxes", "report"],
    "caption": ["receive", "inspect", "route", "infer", "report"],
    "change_detection": [
        "receive",
        "inspect",
        "route",
        "validate_pair",
        "align",
        "difference",
        "threshold",
        "morphology",
        "regions",
        "zonal",
        "confidence",
        "report",
    ],
    "change_vqa": [
        "receive",
        "inspect",
        "route",
        "validate_pair",
        "align",
        "difference",
        "threshold",
        "morphology",
        "regions",
        "zonal",
        "interpret",
        "consistency",
        "report",
    ],
    "optical_sar_analysis": [
        "receive",
        "inspect",
        "route",
        "validate_pair",
        "align",
        "normalise_optical",
        "normalise_sar",
        "indices",
        "roughness",
        "classify",
        "regions",
        "consistency",
        "report",
    ],
}


class Registry:
    """UDF2: pipelines by name. A pipeline takes and gives a DataFrame; a later one of a name takes its place."""

    def __init__(self) -> None:
        self._all: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, run: Callable[[DataFrame], DataFrame]) -> bool:
        """Whether the name was free."""
        free = name not in self._all
        self._all[name] = run
        return free

    def unregister(self, name: str) -> None:
        self._all.pop(name, None)

    def get(self, name: str) -> Callable[[DataFrame], DataFrame] | None:
        return self._all.get(name)

    def names(self) -> list[str]:
        return sorted(self._all)

    def clear(self) -> None:
        self._all.clear()

    def health(self) -> dict[str, bool]:
        """By name, whether the pipeline is fit for use; one that can't say is."""
        return {n: bool(getattr(f, "health_check", lambda: True)()) for n, f in sorted(self._all.items())}

    def run(self, name: str, df: DataFrame) -> DataFrame:
        """The pipeline's rows with status ok; without such a pipeline, the rows as they are, status unavailable. No output
        is ever made up."""
        f = self.get(name)
        return f(df).withColumn("status", F.lit("ok")) if f else df.withColumn("status", F.lit("unavailable"))


def capabilities(spark: SparkSession) -> DataFrame:
    """UDF3, SNK4."""
    return spark.createDataFrame(SPECIALISTS, "name string, task string, modalities array<string>, inputs array<int>, built_in boolean")


def find(spark: SparkSession, task: str, modality: str, inputs: int) -> DataFrame:
    """FLT14."""
    return capabilities(spark).where(
        (F.col("task") == task) & F.array_contains("modalities", modality) & F.array_contains("inputs", inputs)
    ).select("name")


def plan(routed: DataFrame) -> DataFrame:
    """PLN1: the steps of each routed request (columns query, task): query, task, step, name."""
    table = F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return routed.select(
        "query",
        "task",
        F.posexplode(F.element_at(table, F.col("task"))).alias("step", "name"),
    ).withColumn("step", F.col("step") + 1)


def status(spark: SparkSession, registry: Registry) -> DataFrame:
    """SNK4: what can be asked for now: name, task, built_in, registered, state."""
    here = F.col("name").isin(registry.names()) if registry.names() else F.lit(False)
    state = F.when(here, "loaded").when(F.col("built_in"), "ready").otherwise("unavailable")
    return capabilities(spark).select("name", "task", "built_in", here.alias("registered"), state.alias("state"))
