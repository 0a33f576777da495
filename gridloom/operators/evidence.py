"""Evidence items of specialists' outputs, fused, and the analyst's report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stable_id
from .corpus import first_of_each
from .scoring import gate, gated_answer

ITEM = ["item_id", "request", "specialist", "type", "region", "value", "confidence", "is_uncertain"]


def _item(df: DataFrame, specialist: str, kind: str, region, value, confidence, uncertain) -> DataFrame:
    key = stable_id("ev", F.lit(specialist), F.col("request").cast("string"), F.lit(kind), F.coalesce(region, F.lit("")))
    return df.select(
        key.alias("item_id"),
        F.col("request"),
        F.lit(specialist).alias("specialist"),
        F.lit(kind).alias("type"),
        region.alias("region"),
        value.alias("value"),
        confidence.alias("confidence"),
        uncertain.alias("is_uncertain"),
    )


def from_change(zonal: DataFrame, regions: DataFrame) -> DataFrame:
    """EVD3: a statistic a request, and a region each. zonal: request, changed, ratio_pct; regions: request, label, pixels, mean_d."""
    none = F.lit(None).cast("string")
    a = _item(zonal, "CHANGE_DETECT", "statistic", none, F.col("changed").cast("double"), F.lit(0.95), F.col("ratio_pct") >= 98.0)
    name = F.format_string("changed_region_%02d", F.col("label"))
    return a.unionByName(_item(regions, "CHANGE_DETECT", "region", name, F.col("pixels").cast("double"), F.col("mean_d"), F.lit(False)))


def from_boxes(requests: DataFrame, boxes: DataFrame) -> DataFrame:
    """EVD2: an item a box; a request without boxes has a negative item."""
    name = F.format_string("box_%02d", F.col("ord"))
    found = _item(boxes, "RS_GROUND", "box", name, F.col("score"), F.col("score"), F.lit(False))
    empty = requests.join(boxes.select("request").distinct(), "request", "left_anti")
    return found.unionByName(_item(empty, "RS_GROUND", "negative", F.lit(None).cast("string"), F.lit(0.0), F.lit(0.25), F.lit(True)))


def from_classes(classes: DataFrame) -> DataFrame:
    """EVD5: a class statistic each: request, class, pixels, pct, prob."""
    return _item(classes, "OPTICAL_SAR_FUSION", "class", F.col("class"), F.col("pct"), F.col("prob"), F.col("class") == "unknown")


def from_answers(answers: DataFrame, specialist: str) -> DataFrame:
    """EVD1, EVD4: an item an answer: request, answer, confidence. An empty answer is uncertain."""
    return _item(
        answers,
        specialist,
        "answer",
        F.lit(None).cast("string"),
        F.length("answer").cast("double"),
        F.col("confidence"),
        F.trim("answer") == "",
    )


def fused(*items: DataFrame) -> DataFrame:
    """EVD6, AGG22: one of each item. An id has 32 bits, so that many requests share some: what an id is made of is the key."""
    every = items[0]
    for i in items[1:]:
        every = every.unionByName(i)
    return first_of_each(every, "item_id", F.struct("value", "confidence", "is_uncertain"), "request", "specialist", "type", "region")


def lookup(items: DataFrame, *, specialist: str | None = None, region: str | None = None, kind: str | None = None) -> DataFrame:
    """EVD6: the items of a specialist, of a region and of a type, as far as these are given."""
    for column, value in (("specialist", specialist), ("region", region), ("type", kind)):
        if value is not None:
            items = items.where(F.col(column) == value)
    return items


def metrics(items: DataFrame) -> DataFrame:
    """AGG23: request, boxes, best_confidence, changed_pixels, regions, largest_region, answers, classes (name to per cent),
    notes. All combine before the shuffle; notes are sentences of a fixed few kinds."""
    of = lambda kind, value: F.when(F.col("type") == kind, value)
    m = items.groupBy("request").agg(
        F.count_if(F.col("type") == "box").alias("boxes"),
        F.max("confidence").alias("best_confidence"),
        F.max(of("statistic", F.col("value"))).cast("long").alias("changed_pixels"),
        F.count_if(F.col("type") == "region").alias("regions"),
        F.max(of("region", F.col("value"))).cast("long").alias("largest_region"),
        F.count_if(F.col("type") == "answer").alias("answers"),
        F.count_if("is_uncertain").alias("uncertain"),
        F.count_if(F.col("type") == "negative").alias("negatives"),
        # A class stands once in a request's evidence, and there are six.
        F.array_sort(F.collect_set(of("class", F.struct("region", "value")))).alias("pairs"),
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("negatives") > 0, "Nothing was found of what was looked for."),
            F.when(F.col("changed_pixels") == 0, "No pixel changed."),
            F.when(F.col("uncertain") > 0, F.format_string("Uncertain items: %d.", F.col("uncertain"))),
        )
    )
    return m.select("request", "boxes", "best_confidence", "changed_pixels", "regions", "largest_region", "answers", F.map_from_entries("pairs").alias("classes"), notes.alias("notes"))


#: What a request's inputs are: a row a raster, with its role in the request.
INPUT = "struct<role: string, filename: string, width: int, height: int, n_bands: int, crs: string, modality: string>"
#: Findings that a report lists at most, the surest; the number of all stands beside them.
MOST_FINDINGS = 50


def full_report(requests: DataFrame, inputs: DataFrame, items: DataFrame, judged: DataFrame, ran: DataFrame) -> DataFrame:
    """RPT1: request, title, answer, inputs, statistics, confidence, consistency, provenance, findings, n_findings, error.

    requests: request, query, task, answer, error; inputs: request and INPUT's fields; judged: request, status, confidence,
    tier, conflicts; ran: request, specialist, state. What failed on the way is a request's error: such a request has the
    fallback report, with its query, inputs and error and nothing that was worked out, and the others stand."""
    text = "array<string>"
    conflicts = F.coalesce("conflicts", F.array().cast("array<struct<rule: string, severity: string>>"))
    given = inputs.groupBy("request").agg(F.sort_array(F.collect_list(F.struct(*INPUT[7:-1].replace(":", "").split()[::2]))).alias("inputs"))
    done = ran.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("specialist", "state"))).alias("provenance"))
    # The surest findings of a request, ranked early, so that one with many has MOST_FINDINGS rows a task.
    order = W.partitionBy("request").orderBy(F.desc("confidence"), "item_id")
    line = F.format_string("%s %s: %.2f", "specialist", F.coalesce("region", F.col("type")), "value")
    top = items.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_FINDINGS)
    top = top.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("findings"))
    counts = items.groupBy("request").agg(F.count(F.lit(1)).alias("n_findings"))
    r = requests
    for part in (given, metrics(items), judged.withColumn("conflicts", conflicts), done, top, counts):
        r = r.join(part, "request", "left")
    ok = F.col("error").isNull()
    status = F.coalesce("status", F.lit("insufficient_evidence"))
    answer = gated_answer(F.coalesce("answer", F.lit("No evidence was found.")), status, F.col("conflicts"))
    statistics = F.struct("boxes", "best_confidence", "changed_pixels", "regions", "largest_region", "classes", "notes")
    sure = F.struct(F.coalesce("confidence", F.lit(0.05)).alias("score"), F.coalesce("tier", F.lit("UNSUPPORTED")).alias("tier"))
    agreed = F.struct(status.alias("status"), gate(status).alias("action"), F.coalesce(F.transform("conflicts", lambda c: c["rule"]), F.array().cast(text)).alias("rules"))
    return r.select(
        "request",
        F.col("query").alias("title"),
        "task",
        F.when(ok, answer).otherwise(F.format_string("The report couldn't be made: %s", F.col("error"))).alias("answer"),
        F.coalesce("inputs", F.array().cast(f"array<{INPUT}>")).alias("inputs"),
        F.when(ok, statistics).alias("statistics"),
        F.when(ok, sure).alias("confidence"),
        F.when(ok, agreed).alias("consistency"),
        F.coalesce("provenance", F.array().cast("array<struct<specialist: string, state: string>>")).alias("provenance"),
        F.when(ok, F.coalesce(F.transform("findings", lambda x: x["line"]), F.array().cast(text))).otherwise(F.array().cast(text)).alias("findings"),
        F.when(ok, F.coalesce("n_findings", F.lit(0))).otherwise(0).alias("n_findings"),
        "error",
    )


def report(requests: DataFrame, items: DataFrame, judged: DataFrame) -> DataFrame:
    """RPT1, AGG23: request, title, answer, status, confidence, tier, findings. requests: request, query; judged: request,
    status, confidence, tier. A request without evidence says so."""
    found = items.groupBy("request").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_uncertain").alias("unsure"),
        F.max("confidence").alias("best"),
        F.sort_array(
            F.collect_list(F.format_string("%s %s: %.2f", "specialist", F.coalesce("region", F.col("type")), "value"))
        ).alias("findings"),
    )
    r = requests.join(found, "request", "left").join(judged, "request", "left")
    answer = F.when(F.col("n").isNull(), "No evidence was found.").when(F.col("status") == "contradictory", "The evidence contradicts itself.").otherwise(
        F.format_string("%d findings, %d of them uncertain.", F.col("n"), F.col("unsure"))
    )
    return r.select(
        "request",
        F.col("query").alias("title"),
        answer.alias("answer"),
        F.coalesce("status", F.lit("insufficient_evidence")).alias("status"),
        F.coalesce("confidence", F.lit(0.05)).alias("confidence"),
        F.coalesce("tier", F.lit("UNSUPPORTED")).alias("tier"),
        F.coalesce("findings", F.array().cast("array<string>")).alias("findings"),
    )
