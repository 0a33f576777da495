"""Confusion metrics, failure taxonomy, consistency, confidence, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import written
from .percentiles import exact_percentiles

_zero = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)


def confusion(joined: DataFrame, *keys: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """JN7: keys, tp, fp, fn, tn of two boolean columns; combined before the shuffle."""
    t, p = F.col(truth), F.col(pred)
    return joined.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )


#: Keys whose first samples are broadcast at most.
MAX_KEYS = 200_000


def sweep(scores: DataFrame, *, bins: int = 128) -> DataFrame:
    """BEN5, AGG8, AGG9: candidate, bin, threshold, tp, fp, fn, tn, precision, recall, f1, iou of scores (candidate, truth, score
    in 0..1) at the thresholds bin / bins, a score of which or more says yes. One scan gives a histogram a candidate and
    truth; the confusion at every threshold is its sums from the top, over `bins` rows a candidate."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    hist = scores.where("truth is not null and score is not null").groupBy("candidate", at.alias("bin")).agg(F.count_if("truth").alias("yes"), F.count_if(~F.col("truth")).alias("no"))
    every = hist.select("candidate").distinct().select("candidate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    hist = every.join(hist, ["candidate", "bin"], "left").fillna(0, ["yes", "no"])
    up, all_ = W.partitionBy("candidate").orderBy(F.desc("bin")), W.partitionBy("candidate")
    tp, fp = F.sum("yes").over(up), F.sum("no").over(up)
    c = hist.select("candidate", "bin", tp.alias("tp"), fp.alias("fp"), (F.sum("yes").over(all_) - tp).alias("fn"), (F.sum("no").over(all_) - fp).alias("tn"))
    tp, fp, fn = (F.col(k).cast("double") for k in ("tp", "fp", "fn"))
    p, r = _zero(tp, tp + fp), _zero(tp, tp + fn)
    metrics = {"precision": p, "recall": r, "f1": _zero(2.0 * tp, 2.0 * tp + fp + fn), "iou": _zero(tp, tp + fp + fn)}
    return c.withColumn("threshold", F.col("bin") / F.lit(float(bins))).withColumns({k: F.round(v, 6) for k, v in metrics.items()})


def best_of(swept: DataFrame, metric: str = "f1") -> DataFrame:
    """Each candidate's threshold of the greatest metric, of equals the greatest threshold, with what it gives there, and the
    differences to the best candidate: d_<metric>. A row a candidate."""
    names = ["threshold", "precision", "recall", "f1", "iou"]
    best = swept.groupBy("candidate").agg(F.max_by(F.struct(*names), F.struct(metric, "threshold")).alias("b")).select("candidate", "b.*")
    top = best.agg(F.max_by(F.struct(*names[1:]), F.struct(F.col(metric), "candidate")).alias("t"))  # one row
    out = best.join(F.broadcast(top), F.lit(True))
    return out.select("candidate", *names, *[F.round(F.col(n) - F.col(f"t.{n}"), 6).alias(f"d_{n}") for n in names[1:]])


def metrics_eps(c: DataFrame, eps: float = 1e-8) -> DataFrame:
    """AGG8: small divisors; nothing there gives 0."""
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    out = {
        "precision": p,
        "recall": r,
        "f1": 2.0 * p * r / (p + r + eps),
        "iou": F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + eps),
        "fpr": F.col("fp") / (F.col("fp") + F.col("tn") + eps),
        "changed_ratio": (F.col("tp") + F.col("fp")) / n,
    }
    return c.withColumns({k: F.round(v, 4) for k, v in out.items()})


def metrics_explicit(c: DataFrame) -> DataFrame:
    """AGG9: two empty masks agree (1), a zero divisor gives 0."""
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    empty = (tp + fp + fn) == 0
    p, r = _zero(tp, tp + fp), _zero(tp, tp + fn)
    ratio = (tp + fp) / (tp + fp + fn + tn)
    one = lambda v, e: F.round(F.when(empty, e).otherwise(v), 4)
    return c.withColumns(
        {
            "precision": one(p, 1.0),
            "recall": one(r, 1.0),
            "f1": one(_zero(2.0 * p * r, p + r), 1.0),
            "iou": one(_zero(tp, tp + fp + fn), 1.0),
            "fpr": one(_zero(fp, fp + tn), 0.0),
            "changed_ratio": one(ratio, 0.0),
            "is_empty": tp + fp == 0,
            "is_full": ~empty & (F.round(ratio, 10) >= 0.98),
        }
    )


def metrics_bench(c: DataFrame, smooth: float = 1e-6, tolerance: int = 25) -> DataFrame:
    """AGG10: smoothed; without truth, up to `tolerance` predicted pixels are right."""
    tp, fp, fn = (F.col(k).cast("double") for k in ("tp", "fp", "fn"))
    none = tp + fn == 0
    right = F.when(fp < tolerance, 1.0).otherwise(0.0)
    v = lambda x: F.round(F.when(none, right).otherwise(x), 4)
    p, r = (tp + smooth) / (tp + fp + smooth), (tp + smooth) / (tp + fn + smooth)
    return c.withColumns(
        {"precision": v(p), "recall": v(r), "f1": v(2.0 * p * r / (p + r)), "iou": v((tp + smooth) / (tp + fp + fn + smooth))}
    )


def macro(m: DataFrame, digits: int = 4) -> DataFrame:
    """AGG11: statistics over samples of their rounded metrics. Medians are exact without all samples in one task."""
    names = ("iou", "precision", "recall", "f1")
    m = written(m, "metrics")
    each = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in names])).alias("x")).select("x.*")
    medians = exact_percentiles(each, ["metric"], "v", [0.5])
    row = medians.agg(*[F.max(F.when(F.col("metric") == k, F.get("q", F.lit(0)))).alias(f"median_{k}") for k in names])
    cols = []
    for k in names:
        cols += [F.round(f(k), digits).alias(f"{n}_{k}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    out = m.agg(
        F.count(F.lit(1)).alias("samples"),
        *cols,
        F.round(F.avg("fpr"), digits).alias("mean_fpr"),
        F.round(F.avg(F.col("is_empty").cast("double")), digits).alias("empty_rate"),
        F.round(F.avg(F.col("is_full").cast("double")), digits).alias("full_rate"),
    )
    # Two tables of one row.
    out = out.join(F.broadcast(row.select(*[F.round(c, digits).alias(c) for c in row.columns])), F.lit(True))
    order = ["samples", *[f"{n}_{k}" for k in names for n in ("mean", "median", "std", "min", "max")], "mean_fpr", "empty_rate", "full_rate"]
    return out.select(*order)


def micro(c: DataFrame) -> DataFrame:
    """AGG12: counts summed first."""
    return metrics_explicit(c.agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "tn")]))


def failure(category: Column, nuisance: Column, quantitative: Column, pred: Column) -> tuple[Column, Column]:
    """FLT16: the failure's kind and severity, null where there is none; over precision, recall, f1, fpr, tp, fp, fn."""
    p, r, f1, fpr, tp, fp, fn = (F.col(k) for k in ("precision", "recall", "f1", "fpr", "tp", "fp", "fn"))
    mild, loss = F.least(F.lit(1.0), pred / 10000.0), 1.0 - f1
    q, n = quantitative, ~quantitative & (pred > 100)
    none = F.lit(None).cast("string")
    rules = [
        (n & (nuisance == "registration"), "alignment_related_error", mild),
        (n & nuisance.isin("illumination", "shadow"), "shadow_false_positive", mild),
        (n & (nuisance == "seasonal_color"), "seasonal_variation_false_positive", mild),
        (~q | ((f1 >= 0.85) & (fpr < 0.01)), none, F.lit(None).cast("double")),
        ((nuisance == "registration") & (fpr > 0.005), "alignment_related_error", loss),
        (nuisance.isin("illumination", "shadow") & (fpr > 0.01), "shadow_false_positive", loss),
        ((nuisance == "seasonal_color") & (fpr > 0.01), "seasonal_variation_false_positive", loss),
        ((category == "forest") & (fpr > 0.02), "vegetation_error", loss),
        ((category == "agriculture") & (fpr > 0.02), "agriculture_error", loss),
        ((category == "water") & (fpr > 0.02), "water_error", loss),
        ((r < 0.50) & (p >= 0.70) & (tp < 1500) & (fn > 0), "small_change_missed", 1.0 - r),
        ((r < 0.50) & (p >= 0.70), "missed_change", 1.0 - r),
        ((p < 0.50) & (r >= 0.70), "false_positive", 1.0 - p),
        ((r < 0.70) & (p < 0.70) & (tp > 0) & ((fp > 0.25 * tp) | (fn > 0.25 * tp)), "boundary_error", loss),
    ]
    kind, severity = F.lit("unclassified_failure"), loss
    for cond, k, s in reversed(rules):
        cond = F.coalesce(cond, F.lit(False))
        kind, severity = F.when(cond, k).otherwise(kind), F.when(cond, s).otherwise(severity)
    return kind, F.round(severity, 4)


def change_conflicts(e: DataFrame) -> DataFrame:
    """CON1 to CON5, CON7: e with `conflicts`, an array of struct(rule, severity). e: changed_px, measured_ha, ordering,
    direction (null: no interpretation), regions (array of known ids), transitions (array of struct from, to, description,
    region, claimed_ha)."""
    px, t, d = F.col("changed_px"), F.col("transitions"), F.lower("direction")
    told = d.isNotNull()
    c = lambda rule, severity, cond: F.when(
        F.coalesce(cond, F.lit(False)),
        F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")),
    )
    active = d.isin("increased", "decreased", "modified") | F.exists(t, lambda x: (x["from"] != "none") & (x["to"] != "none"))
    c1 = told & (px == 0) & active
    gain = F.exists(t, lambda x: F.lower(x["to"]).rlike("construction|built") | F.lower(x["description"]).rlike("expansion|new"))
    fall = F.forall(t, lambda x: F.contains(F.lower(x["to"]), F.lit("bare")) | F.lower(x["description"]).rlike("loss|clearing"))
    each = lambda rule, cond: F.transform(
        F.filter(t, lambda x: F.coalesce(told & cond(x), F.lit(False))),
        lambda x: F.struct(F.lit(rule).alias("rule"), F.lit("warning").alias("severity")),
    )
    once = F.array_compact(
        F.array(
            c("C1_ZERO_CHANGE_CONTRADICTION", "critical", c1),
            c("C3_NONZERO_CHANGE_SUPPORT", "critical", told & (F.size(t) > 0) & (px <= 0) & ~c1),
            c("C5_TEMPORAL_CHRONOLOGY_INVALID", "critical", F.col("ordering").isin("reversed", "invalid", "negative_delta")),
            c("C5_TEMPORAL_DIRECTION_CONFLICT", "critical", (d == "no_change") & (px > 500)),
            c("C5_TEMPORAL_DIRECTION_CONFLICT", "warning", (d == "increased") & ~gain & (px > 0) & (F.size(t) > 0) & fall),
        )
    )
    c2 = each("C2_UNSUPPORTED_REGION", lambda x: x["region"].isNotNull() & ~F.array_contains("regions", x["region"]))
    c4 = each(
        "C4_AREA_CONSISTENCY",
        lambda x: x["claimed_ha"].isNotNull() & (F.col("measured_ha") > 0) & (F.abs(x["claimed_ha"] - F.col("measured_ha")) / F.col("measured_ha") > 0.10),
    )
    c7 = each("C7_CLASS_TRANSITION_CONFLICT", lambda x: (x["from"] == "water") & F.contains(x["to"], F.lit("building")) & (px < 50))
    return e.withColumn("conflicts", F.concat(once, c2, c4, c7))


def sensor_conflict(label: Column, exg: Column, backscatter: Column, rough: Column) -> Column:
    """CON6: why the sensors disagree on a region, the first case that holds; null where they don't."""
    return (
        F.when((exg > 0.15) & (backscatter > 0.75) & (rough > 0.20), "green_but_double_bounce").when((label == "water_body") & (backscatter > 0.35), "water_but_rough") .when(
            (label == "built_structure") & (backscatter < 0.10) & (rough < 0.04),
            "built_but_smooth",
        ).when(label == "unknown", "unclassified")
    )


def status(critical: Column, warnings: Column, insufficient: Column) -> tuple[Column, Column]:
    """AGG20: consistency status and evidence quality."""
    s = F.when(critical > 0, "contradictory").when(insufficient, "insufficient_evidence").when(warnings > 1, "uncertain").when(warnings == 1, "partially_consistent").otherwise("consistent")
    q = (F.when(critical > 0, F.greatest(F.lit(0.1), 1.0 - 0.4 * critical - 0.15 * warnings)).when(insufficient, 0.35)
         .when(warnings > 1, F.greatest(F.lit(0.4), 1.0 - 0.2 * warnings)).when(warnings == 1, 0.80).otherwise(1.0))
    return s, q


def gate(status_: Column) -> Column:
    """CON9: what may be done with the answer."""
    return F.when(status_ == "contradictory", "flag_contradiction").when(status_ == "insufficient_evidence", "state_insufficient").when(
        status_.isin("partially_consistent", "uncertain"),
        "qualify",
    ).otherwise("allow")


#: What a violated rule says of the evidence.
SAYS = {
    "C1_ZERO_CHANGE_CONTRADICTION": "A change is told of, though no pixel changed.",
    "C2_UNSUPPORTED_REGION": "A region is told of that no detector found.",
    "C3_NONZERO_CHANGE_SUPPORT": "Transitions are told of without a changed pixel.",
    "C4_AREA_CONSISTENCY": "The area that is told of isn't the one that was measured.",
    "C5_TEMPORAL_CHRONOLOGY_INVALID": "The images aren't in order of time.",
    "C5_TEMPORAL_DIRECTION_CONFLICT": "The direction that is told of isn't what the pixels and the transitions show.",
    "C7_CLASS_TRANSITION_CONFLICT": "A transition is told of that its few pixels don't bear out.",
    "C8_INSUFFICIENT_EVIDENCE": "No detector found what was asked for.",
    "C8_DEGENERATE_DETECTION": "A detection covers nothing, or everything.",
}


def gated_answer(answer: Column, status_: Column, conflicts: Column) -> Column:
    """CON9: the answer as far as its evidence bears it. conflicts: array of struct(rule, severity). A consistent answer stays
    as it is; one that its evidence contradicts, or that has too little, gives way to what is wrong; others are remarked on."""
    of = F.create_map(*[F.lit(v) for kv in SAYS.items() for v in kv])
    say = lambda c: F.coalesce(F.try_element_at(of, c["rule"]), c["rule"])
    first = F.try_element_at(conflicts, F.lit(1))
    worst = F.coalesce(F.try_element_at(F.filter(conflicts, lambda c: c["severity"] == "critical"), F.lit(1)), first)
    n = F.coalesce(F.size(conflicts), F.lit(0))
    own = F.coalesce(answer, F.lit(""))
    against = F.format_string("[contradiction] %s It can't be told as a fact, as what was measured speaks against it.", F.coalesce(say(worst), F.lit("The evidence contradicts itself.")))
    little = F.format_string("[insufficient evidence] %s Nothing definite can be said without more observations.", F.coalesce(say(first), F.lit("There is too little evidence.")))
    unsure = F.format_string("[provisional] %s (The evidence is ambiguous; conflicts noted: %d.)", own, n)
    partly = F.format_string("%s [partly consistent: %s]", own, F.coalesce(say(first), F.lit("small discrepancies.")))
    return F.when(status_ == "contradictory", against).when(status_ == "insufficient_evidence", little).when(status_ == "uncertain", unsure).when(
        status_ == "partially_consistent",
        partly,
    ).otherwise(answer)


# By status, the cap of confidence, its factor and its penalty.
STATUS = {
    "consistent": (0.99, 1.00, 0.00),
    "partially_consistent": (0.75, 0.85, 0.12),
    "uncertain": (0.60, 0.70, 0.20),
    "insufficient_evidence": (0.40, 0.45, 0.35),
    "contradictory": (0.35, 0.30, 0.50),
}
WEIGHTS = {"input": 0.15, "align": 0.15, "model": 0.50, "evidence": 0.20}


def confidence(
    q_input: Column,
    q_align: Column,
    s_model: Column,
    q_evidence: Column,
    status_: Column,
    conflicts: Column,
    critical: Column,
) -> Column:
    """CNF1: the weighted score, scaled and reduced by the status, capped, at least 0.05, four decimals."""
    by = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (k, v[i])]), status_)
    base = WEIGHTS["input"] * F.least(
        F.greatest(q_input, F.lit(0.2)),
        F.lit(1.0),
    ) + WEIGHTS["align"] * F.least(
        F.greatest(q_align, F.lit(0.0)),
        F.lit(1.0),
    ) + WEIGHTS["model"] * s_model + WEIGHTS["evidence"] * q_evidence
    more = F.when(
        (status_ == "partially_consistent"),
        F.least(F.lit(0.30), by(2) + 0.03 * F.greatest(F.lit(0), conflicts - 1)),
    ).otherwise(by(2))
    penalty, cap = F.when(critical, F.greatest(more, F.lit(0.45))).otherwise(more), F.when(critical, F.least(by(0), F.lit(0.35))).otherwise(by(0))
    return F.greatest(F.lit(0.05), F.least(cap, F.round(base * by(1) - penalty, 4)))


def specialist_signal(kind: Column, s: Column, uncertainty: Column, unknown_pct: Column, n_boxes: Column, degenerate: Column) -> Column:
    """CNF2: cascade, optical_sar, grounding or a single model's confidence, in 0.10 to 0.99."""
    clip = lambda v: F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.10), v)), 4)
    return (
        F.when(kind == "cascade", clip(s * (0.35 + 0.65 * (1.0 - uncertainty * 0.5)))).when(
            kind == "optical_sar",
            clip(F.when(unknown_pct > 25.0, F.greatest(F.lit(0.20), s * 0.75)).otherwise(s)),
        ) .when((kind == "grounding") & (n_boxes == 0), 0.25).when((kind == "grounding") & degenerate, 0.30).otherwise(clip(s))
    )


def tier(c: Column) -> Column:
    """CNF3."""
    return F.when(c >= 0.78, "HIGH").when(c >= 0.55, "MEDIUM").when(c >= 0.35, "LOW").otherwise("UNSUPPORTED")


def calibration(df: DataFrame, p: str = "p", y: str = "y", bins: int = 5) -> DataFrame:
    """AGG19: Brier score and the measured expected calibration error over equal bins."""
    b = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("mp"),
        F.avg(y).alias("my"),
        F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("se"),
    )
    return b.agg(
        F.round(F.sum("se") / F.sum("n"), 6).alias("brier"),
        F.round(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n"), 6).alias("ece"),
        F.sum("n").alias("n"),
    )


def changed(px: Column, ratio_pct: Column) -> Column:
    """FLT17. Whether a scenario counts as changed."""
    return (ratio_pct >= 1.0) & (px > 100)


def insufficient(task: Column, regions: Column, degenerate: Column) -> tuple[Column, Column]:
    """CON8. The rule that is broken, null if none, and whether the evidence is insufficient: no region where regions are
    asked for, or one that is degenerate."""
    none = task.isin("grounding", "optical_sar_analysis") & (F.coalesce(regions, F.lit(0)) == 0)
    bad = (task == "grounding") & (F.coalesce(degenerate, F.lit(0)) > 0)
    return F.when(none, "C8_INSUFFICIENT_EVIDENCE").when(bad, "C8_DEGENERATE_DETECTION"), none


def needs_grid(query: Column, crs: Column) -> Column:
    """CON8. Whether a measure is asked for that needs a map grid which isn't there."""
    return F.lower(query).rlike("area|hectare|meter|size|distance") & crs.isNull()


def latencies(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """AGG13, WIN12: by key, of all but its first sample by `order` (the cold start): mean, median, p95, low, high. The
    first one is found by an aggregate, so that no key is one window, and percentiles by narrowing histograms, so that no
    key's samples meet in one task. Keys meet their samples by a broadcast only where they are few."""
    cold = written(df.groupBy(key).agg(F.min(order).alias(order)), "cold")
    few = cold.limit(MAX_KEYS + 1).count() <= MAX_KEYS
    warm = written(df.join(F.broadcast(cold) if few else cold, [key, order], "left_anti").select(key, value), "warm")
    q = exact_percentiles(warm, [key], value, [0.5, 0.95]).select(F.col(key).alias("of"), "q")
    out = warm.groupBy(key).agg(F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    at = lambda i: F.round(F.get("q", F.lit(i)), 4)
    out = out.join(q, F.col(key).eqNullSafe(F.col("of")), "left")
    return out.select(key, "mean", at(0).alias("median"), at(1).alias("p95"), "low", "high")


def failure_distribution(df: DataFrame, kind: str, order: str) -> DataFrame:
    """AGG14: kind, n, primary: the kinds of failure, and which is the most frequent, the earlier by `order` of equal ones."""
    n = df.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    top = n.agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("top"))
    # One row, the most frequent kind, beside each kind.
    return n.join(F.broadcast(top), F.lit(True)).select("kind", "n", (F.col("kind") == F.col("top")).alias("primary"))


def format_matrix(df: DataFrame) -> DataFrame:
    """AGG17 over formats, correct, misaligned, false_positive: counts and accuracy by format."""
    out = df.groupBy("formats").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("correct"),
        F.count_if("misaligned").alias("misaligned"),
        F.count_if("false_positive").alias("false_positives"),
    )
    return out.withColumn("accuracy_pct", F.round(F.col("correct") / F.col("n") * 100.0, 2))


def bce_dice(df: DataFrame, *keys: str, p: str = "p", y: str = "y") -> DataFrame:
    """AGG21: binary cross entropy and soft Dice loss of probabilities against 0 or 1."""
    bce = -F.avg(F.col(y) * F.ln(p) + (1 - F.col(y)) * F.ln(1 - F.col(p)))
    return df.groupBy(*keys).agg(
        F.round(bce, 6).alias("bce"),
        F.round(1 - (2 * F.sum(F.col(p) * F.col(y)) + 1) / (F.sum(p) + F.sum(y) + 1), 6).alias("dice"),
    )
