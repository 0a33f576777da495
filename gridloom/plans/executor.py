"""PLN2. Requests from their words to a report: routed, planned, run by the specialists that are built in, judged.

Each specialist runs once over the scenes that requests ask it about, not once a request; a request's results are
its scene's, by an equi-join. What no built-in specialist can do stays `unavailable`: no answer is made up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import change as CH
from ..operators import evidence as E
from ..operators import fusion as U
from ..operators import routing as R
from ..operators import scoring as S
from ..store import written
from . import registry as P

CHANGE, FUSION = "CHANGE_DETECT", "OPTICAL_SAR_FUSION"
#: How sure a change mask is where nothing changed, and where something did; and the least region, in pixels.
SURE_OF_NONE, SURE_OF_CHANGE, LEAST = 0.95, 0.85, 16
#: What is known of the input and of a pair's alignment where nothing says otherwise.
INPUT_QUALITY, ALIGNMENT = 1.0, 0.9


def stages(requests: DataFrame) -> DataFrame:
    """requests (request, query, m1, m2, hint, scene) routed, a row a specialist: request, query, scene, task, rejection,
    specialist, state. state: `rejected`, `unavailable` (no built-in specialist of that name), or `ready`."""
    built = [n for n, *_, here in P.SPECIALISTS if here]
    r = R.route(requests).withColumn("specialist", F.explode_outer(F.split("specialists", ",")))
    state = F.when(F.col("rejection").isNotNull(), "rejected").when(F.col("specialist").isin(built), "ready").otherwise("unavailable")
    return r.select("request", "query", "scene", "task", "rejection", "specialist", state.alias("state"))


def run_change(pairs: DataFrame, height: int, width: int) -> dict[str, DataFrame]:
    """CMP3 with its evidence: by scene the zonal statistics, and the regions of the cleaned mask."""
    o = CH.detect(pairs, height, width)
    zonal = written(o["zonal"], "zonal")
    mask = written(o["mask"], "mask")
    return {"zonal": zonal, "regions": CH.regions(CH.components(mask, width), o["difference"], least=LEAST)}


def run_fusion(optical_sar: DataFrame, height: int, width: int) -> dict[str, DataFrame]:
    """CMP4, CMP5 and EVD5's histogram by scene."""
    k = written(U.classes(optical_sar, height, width), "classes")
    return {"classes": U.histogram(k), "confidence": U.confidence(k)}


def execute(requests: DataFrame, pairs: DataFrame, optical_sar: DataFrame, height: int, width: int) -> dict[str, DataFrame]:
    """stages (with state `ok` where a specialist ran on the request's scene, `no_input` where the scene isn't there),
    items (the evidence), judged (status, confidence, tier) and report, a row a request each.

    pairs: scene, y, x, a, b; optical_sar: scene, y, x, r, g, b, sar. A request that is rejected has no evidence."""
    staged = written(stages(requests), "stages")
    wanted = lambda name: staged.where((F.col("specialist") == name) & (F.col("state") == "ready"))
    of = lambda name, df: df.join(wanted(name).select("scene").distinct(), "scene", "left_semi")
    change = run_change(of(CHANGE, pairs), height, width)
    fusion = run_fusion(of(FUSION, optical_sar), height, width)
    asked = lambda name, df: wanted(name).select("request", "scene").join(df, "scene")
    zonal, regions, classes = asked(CHANGE, change["zonal"]), asked(CHANGE, change["regions"]), asked(FUSION, fusion["classes"])
    items = written(E.fused(E.from_change(zonal, regions), E.from_classes(classes)), "items")

    seen = zonal.select(
        "request",
        F.lit(CHANGE).alias("specialist"),
    ).union(asked(FUSION, fusion["confidence"]).select("request", F.lit(FUSION)))
    done = staged.join(seen.withColumn("ran", F.lit(True)), ["request", "specialist"], "left")
    done = done.withColumn(
        "state",
        F.when(F.col("state") != "ready", F.col("state")).when(F.col("ran"), "ok").otherwise("no_input"),
    ).drop("ran")

    judged = written(_change_judged(zonal).unionByName(_fusion_judged(classes, asked(FUSION, fusion["confidence"]))), "judged")
    head = requests.select("request", "query")
    return {"stages": done, "items": items, "judged": judged, "report": E.report(head, items, judged)}


def _conclusion(
    df: DataFrame,
    critical: Column,
    warnings: Column,
    insufficient: Column,
    kind: str,
    s: Column,
    unknown_pct: Column,
) -> DataFrame:
    status, quality = S.status(critical, warnings, insufficient)
    signal = S.specialist_signal(F.lit(kind), s, F.lit(0.0), unknown_pct, F.lit(1), F.lit(False))
    c = S.confidence(F.lit(INPUT_QUALITY), F.lit(ALIGNMENT), signal, quality, status, critical + warnings, critical > 0)
    return df.select("request", status.alias("status"), c.alias("confidence"), S.tier(c).alias("tier"), S.gate(status).alias("gate"))


def _change_judged(zonal: DataFrame) -> DataFrame:
    """CON1 to CON5 without an interpretation leave the statistics' own warnings; CMP7: nothing changed is sure."""
    e = S.change_conflicts(
        zonal.select(
            "request",
            "warning",
            F.col("changed").alias("changed_px"),
            F.col("area_ha").alias("measured_ha"),
            F.lit("valid").alias("ordering"),
            F.lit(None).cast("string").alias("direction"),
            F.array().cast("array<string>").alias("regions"),
            F.array().cast("array<struct<from:string,to:string,description:string,region:string,claimed_ha:double>>").alias("transitions"),
        )
    )
    n = lambda s: F.size(F.filter("conflicts", lambda x: x["severity"] == s))
    doubtful = F.col("warning").isin("full_image", "extreme").cast("int")
    s = F.when(F.col("changed_px") == 0, SURE_OF_NONE).otherwise(SURE_OF_CHANGE)
    return _conclusion(e, n("critical"), n("warning") + F.coalesce(doubtful, F.lit(0)), F.lit(False), "change", s, F.lit(0.0))


def _fusion_judged(classes: DataFrame, sure: DataFrame) -> DataFrame:
    """CON8: without a class of LEAST pixels the evidence is insufficient."""
    n = classes.groupBy("request").agg(
        F.count_if((F.col("class") != U.UNKNOWN) & (F.col("pixels") >= LEAST)).alias("regions"),
        F.coalesce(F.max(F.when(F.col("class") == U.UNKNOWN, F.col("pct"))), F.lit(0.0)).alias("unknown"),
    )
    rule, none = S.insufficient(F.lit("optical_sar_analysis"), F.col("regions"), F.lit(0))
    e = n.join(sure.select("request", F.col("confidence").alias("s")), "request")
    return _conclusion(e, F.lit(0), rule.isNotNull().cast("int"), none, "optical_sar", F.col("s"), F.col("unknown"))


def trace(done: DataFrame) -> DataFrame:
    """The steps of each request's plan in order: request, step, name, state. Steps before the specialist's are `ok` but
    for a rejected request, which ends at its validation; a specialist that didn't run leaves its step and later ones as it is."""
    worst = F.when(F.array_contains(F.col("states"), "rejected"), "rejected").when(
        F.array_contains(F.col("states"), "unavailable"),
        "unavailable",
    ).when(F.array_contains(F.col("states"), "no_input"), "no_input").otherwise("ok")
    one = done.groupBy("request").agg(F.first("task").alias("task"), F.collect_set("state").alias("states")).withColumn("end", worst)
    steps = P.plan(one.select(F.col("request").alias("query"), "task")).withColumnRenamed("query", "request").join(one.select("request", "end"), "request")
    last = F.when(F.col("end") == "rejected", 3).when(F.col("end") == "unavailable", 4).when(F.col("end") == "no_input", 4)
    return steps.select(
        "request",
        "step",
        "name",
        F.when(last.isNull() | (F.col("step") <= last), "ok").otherwise(F.col("end")).alias("state"),
    )
