"""Routing questions: patterns, input configuration, rejection, route; modality and validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The banks of patterns that questions are matched against.
CROSS_MODAL = [
    r"\boptical\s+(?:and|\+)\s+sar\b",
    r"\bsar\s+(?:and|\+)\s+optical\b",
    r"\bboth\s+sensors\b",
    r"\bcross[- ]modal\b",
    r"\bjoint\s+analysis\b",
    r"\busing\s+both\s+sensors\b",
    r"\bwith\s+sar\b",
    r"\bsar\s+backscatter\b",
    r"\boptical\s+and\s+radar\b",
    r"\bradar\s+and\s+optical\b",
    r"\btogether\s+to\s+identify\b",
    r"\bdual[- ]sensor\b",
]
TEMPORAL = [
    r"\bwhat\s+changed\b",
    r"\bbetween\s+these\s+(?:two\s+)?dates\b",
    r"\bbetween\s+(?:the\s+)?two\s+images\b",
    r"\btemporal\s+change\b",
    r"\bbi[- ]temporal\b",
    r"\bchanged\s+regions\b",
    r"\bdifference\s+between\b",
    r"\bover\s+time\b",
    r"\bchange\s+detection\b",
    r"\bhas\s+the\b.*\bchanged\b",
]
PURE_CHANGE = [
    r"^\s*what\s+changed(\s+between\s+(these\s+(two\s+)?dates|the\s+two\s+images))?\s*\??\s*$",
    r"\bhow\s+much\s+(?:total\s+)?area\s+changed\b",
    r"\bhow\s+much\s+(?:total\s+)?change\b",
    r"^\s*is\s+there\s+any\s+change\s*\??\s*$",
    r"^\s*has\s+the\s+scene\s+changed\s*\??\s*$",
    r"\btotal\s+(?:surface\s+|physical\s+)?change\b",
    r"\btotal\s+(?:changed\s+)?area\b",
    r"\boverall\s+change\b",
    r"\bbinary\s+change\b",
    r"^\s*(?:detect|show|find|highlight)\s+(?:the\s+)?changes?\s*\??\s*$",
]
LAND_CLASS = [
    r"\b(?:buildings?|structures?|houses?|settlements?|residential|commercial|industrial|urban|built[- ]up)\b",
    r"\b(?:vegetation|crops?|cropland|farmland|pasture|canopy|grassland|agricultural)\b",
    r"\b(?:forests?|trees?|woodlands?|deforestation|timber)\b",
    r"\b(?:water(?:[- ]body)?|lakes?|rivers?|reservoirs?|ponds?|floods?|flooding|wetlands?)\b",
    r"\b(?:bare[- ]ground|bare[- ]soil|soils?|dirt|sand|cleared[- ]land|unpaved)\b",
    r"\b(?:roads?|highways?|runways?|bridges?|infrastructure|pavement)\b",
]
CHANGE_WORDS = [
    r"\bdescribe\b",
    r"\bexplain\b",
    r"\bhow\s+did\b",
    r"\bwhy\s+did\b",
    r"\bwhat\s+does\b",
    r"\btype\s+of\s+land[- ]cover\b",
    r"\btype\s+of\s+change\b",
    r"\bkind\s+of\s+change\b",
    r"\bnature\s+of\s+change\b",
    r"\bland[- ]cover\s+change\b",
    r"\bland[- ]use\s+change\b",
    r"\bincreased?\b",
    r"\bdecreased?\b",
    r"\bexpanded?\b",
    r"\bshrink(?:ing|s)?\b",
    r"\bshrunk\b",
    r"\breduced?\b",
    r"\blost\b",
    r"\bloss\b",
    r"\bcleared?\b",
    r"\bclearance\b",
    r"\bnewly\s+created\b",
    r"\bcreated\b",
    r"\bdeveloped?\b",
    r"\bdevelopment\b",
    r"\bconstructed?\b",
    r"\bconstruction\b",
    r"\bappeared\b",
    r"\bdemolished?\b",
    r"\bconverted?\b",
    r"\btransformed?\b",
    r"\bsignificant\s+change\b",
    r"\bwhere\s+did\b",
    r"\bwhere\s+were\b",
    r"\bsemantic\b",
    r"\bmeaning\b",
    r"\binterpretation\b",
]
GROUNDING = [
    r"^\s*where\s+is\b",
    r"\blocate\b",
    r"\bground\b",
    r"\bfind\s+the\b",
    r"\bhighlight\b",
    r"\bbounding\s+box\b",
    r"\bdetect\s+the\b",
    r"\bshow\s+me\s+where\b",
    r"\bsegment\b",
    r"\bsegmentation\b",
]
CAPTION = [
    r"\bdescribe\s+the\s+scene\b",
    r"\bgenerate\s+(?:a\s+)?caption\b",
    r"\bscene\s+description\b",
    r"\bcaption\s+this\b",
    r"\bsummarize\s+(?:the\s+)?scene\b",
    r"\boverview\s+of\s+(?:the\s+)?image\b",
]
BANKS = {
    "cross_modal": CROSS_MODAL,
    "temporal": TEMPORAL,
    "pure_change": PURE_CHANGE,
    "land_class": LAND_CLASS,
    "change_words": CHANGE_WORDS,
    "grounding": GROUNDING,
    "caption": CAPTION,
}


def any_of(bank: list[str]) -> str:
    """FLT1. One alternation a bank, so that a question is searched once for each."""
    return "(" + "|".join(f"(?:{p})" for p in bank) + ")"


def configuration(m1: Column, m2: Column) -> Column:
    """FLT2. What the inputs are; m2 is null for a single image."""
    optical = lambda m: m.isin("optical", "multispectral")
    return (
        F.when(m2.isNull(), F.concat(F.lit("single_"), m1)).when(
            (optical(m1) & (m2 == "sar")) | ((m1 == "sar") & optical(m2)),
            "cross_modal_optical_sar",
        ) .when(
            optical(m1) & optical(m2),
            "bitemporal_optical_pair",
        ).when((m1 == "sar") & (m2 == "sar"), "bitemporal_sar_pair").otherwise(F.concat_ws("_", F.lit("dual"), m1, m2))
    )


def route(requests: DataFrame) -> DataFrame:
    """FLT1 to FLT6: query, m1, m2, hint and other columns -> config, task, specialists, multi_stage, rejection. Ordered
    rules: a manual hint, then what the inputs cannot serve, then the inputs' own route, then the wording."""
    low = F.lower(F.trim(F.coalesce("query", F.lit(""))))
    r = requests.withColumn(
        "config",
        configuration(F.col("m1"), F.col("m2")),
    ).withColumns({f"is_{k}": low.rlike(any_of(v)) for k, v in BANKS.items()})
    semantic = F.when(F.col("is_land_class"), True).when(F.col("is_pure_change"), False).otherwise(F.col("is_change_words"))
    hint = F.lower(F.trim(F.coalesce("hint", F.lit(""))))
    has = lambda *ws: F.lit(False) if not ws else F.expr("false") | _or([F.contains(hint, F.lit(w)) for w in ws])
    given = ~hint.isin("", "auto", "none")
    single, cross = F.col("m2").isNull(), F.col("config") == "cross_modal_optical_sar"
    twin = F.col("config").isin("bitemporal_optical_pair", "bitemporal_sar_pair")
    # (condition, task, reason; no reason: accepted)
    rules = [
        (given & has("optical_sar", "fusion", "cross_modal") & single, "optical_sar_analysis", "needs_two_images"),
        (given & has("optical_sar", "fusion", "cross_modal") & ~cross, "optical_sar_analysis", "needs_optical_and_sar"),
        (given & has("optical_sar", "fusion", "cross_modal"), "optical_sar_analysis", None),
        (given & has("change_vqa", "semantic") & single, "change_vqa", "needs_two_images"),
        (given & has("change_vqa", "semantic"), "change_vqa", None),
        (given & (has("change_detection") | hint.isin("tinycd_raw", "cva_raw")) & single, "change_detection", "needs_two_images"),
        (given & (has("change_detection") | hint.isin("tinycd_raw", "cva_raw")), "change_detection", None),
        (given & has("ground"), "grounding", None),
        (given & has("caption"), "caption", None),
        (given & has("vqa") & single, "vqa", None),
        (
            single & (F.col("is_temporal") | (F.contains(low, F.lit("change")) & F.contains(low, F.lit("image")))),
            "change_detection",
            "temporal_on_single",
        ),
        (single & F.col("is_cross_modal"), "optical_sar_analysis", "cross_modal_on_single"),
        (twin & F.col("is_cross_modal"), "optical_sar_analysis", "cross_modal_on_one_sensor"),
        (cross & F.col("is_temporal") & ~F.col("is_cross_modal"), "change_detection", "temporal_on_two_sensors"),
        (cross, "optical_sar_analysis", None),
        (~single & semantic, "change_vqa", None),
        (~single, "change_detection", None),
        (F.col("is_grounding"), "grounding", None),
        (F.col("is_caption"), "caption", None),
    ]
    task, reason = F.lit("vqa"), F.lit(None).cast("string")
    for cond, t, why in reversed(rules):
        task, reason = F.when(cond, t).otherwise(task), F.when(cond, F.lit(why)).otherwise(reason)
    r = r.withColumn("task", task).withColumn("rejection", reason)
    # The specialists of each task.
    chain = F.create_map(
        *[
            F.lit(x)
            for kv in {
                "optical_sar_analysis": "OPTICAL_SAR_FUSION",
                "change_vqa": "CHANGE_DETECT,CHANGE_VQA",
                "change_detection": "CHANGE_DETECT",
                "grounding": "RS_GROUND",
                "caption": "RS_CAPTION",
                "vqa": "RS_VQA",
            }.items()
            for x in kv
        ]
    )
    r = r.withColumn("specialists", F.when(F.col("rejection").isNull(), F.element_at(chain, F.col("task"))).otherwise(""))
    return r.withColumn("multi_stage", F.contains("specialists", F.lit(","))).drop(*[f"is_{k}" for k in BANKS])


def _or(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


# What sensors, bands and files are called.
SAR_SENSORS, OPTICAL_SENSORS = ["sentinel-1", "s1", "risat", "terrasar", "cosmo-skymed", "alos", "radarsat"], [
    "sentinel-2",
    "s2",
    "landsat",
    "planet",
    "spot",
    "naip",
    "worldview",
    "pleiades",
]
SAR_BANDS = ["vv", "vh", "hh", "hv", "sigma0", "gamma0", "amplitude", "intensity"]
SAR_FILES, OPTICAL_FILES = r"\bsar\b|\bgrd\b|\bs1\b|[_.-]s1[_.-]|^s1[_.-]|[_.-]s1$|sentinel[_-]?1", r"\boptical\b|\bmsi\b|\bs2\b|[_.-]s2[_.-]|^s2[_.-]|[_.-]s2$|sentinel[_-]?2"


def modality(sensor: Column, descriptions: Column, filename: Column, n_bands: Column, dtype: Column, readable: Column) -> Column:
    """FLT7. struct(modality, confidence, method, verified), the first rule that holds. Sensor names count as whole
    words, so that s1 inside another word is none."""
    word = lambda names: r"(?<![a-z0-9])(?:" + "|".join(names) + r")(?![a-z0-9])"
    named = F.filter(F.transform(descriptions, F.lower), lambda d: d != "")
    sar_bands = (F.size(named) > 0) & F.forall(named, lambda d: d.rlike("|".join(SAR_BANDS)))
    s, f, t = F.lower(F.coalesce(sensor, F.lit(""))), F.lower(F.coalesce(filename, F.lit(""))), F.lower(dtype)
    rules = [
        (~readable, "optical", 0.0, "unreadable-raster-fallback", False),
        (s.rlike(word(SAR_SENSORS)), "sar", 0.99, "sensor-tag metadata", True),
        (s.rlike(word(OPTICAL_SENSORS)), "optical", 0.99, "sensor-tag metadata", True),
        (sar_bands, "sar", 0.95, "polarization-band tag metadata", True),
        (f.rlike(SAR_FILES), "sar", 0.85, "filename convention heuristic", False),
        (f.rlike(OPTICAL_FILES), "optical", 0.85, "filename convention heuristic", False),
        (n_bands.isin(3, 4) & t.isin("uint8", "uint16"), "optical", 0.75, "band-structure heuristic", False),
        (n_bands.isin(1, 2) & F.contains(t, F.lit("float")), "sar", 0.68, "band-structure heuristic", False),
        ((n_bands >= 8) & t.isin("uint16", "float32"), "multispectral", 0.70, "band-structure heuristic", False),
    ]
    as_row = lambda m, c, how, ok: F.struct(
        F.lit(m).alias("modality"),
        F.lit(c).alias("confidence"),
        F.lit(how).alias("method"),
        F.lit(ok).alias("verified"),
    )
    out = as_row("optical", 0.30, "unresolved fallback heuristic", False)
    for cond, *rest in reversed(rules):
        out = F.when(cond, as_row(*rest)).otherwise(out)
    return out


def overlap(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    """JN3. Overlapping area of two rectangles (minx, miny, maxx, maxy), and its share of each, four decimals."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    part = lambda r: F.round(area / ((r[2] - r[0]) * (r[3] - r[1])), 4)
    return area, part(a), part(b)


def single_raster_issues(w: Column, h: Column, n_bands: Column, crs: Column, verified: Column) -> tuple[Column, Column]:
    """FLT8. Errors and warnings."""
    errors = F.array_compact(F.array(F.when((w < 16) | (h < 16), "too_small"), F.when(n_bands == 0, "no_bands")))
    return errors, F.array_compact(F.array(F.when(crs.isNull(), "no_crs"), F.when(~verified, "unverified_modality")))


def pair_issues(
    crs1: Column,
    crs2: Column,
    share: Column,
    res1: Column,
    res2: Column,
    d1: Column,
    d2: Column,
    score: Column,
) -> tuple[Column, Column]:
    """FLT9, FLT12. The first error of a bi-temporal pair, and its warnings."""
    mapped = crs1.isNotNull() & crs2.isNotNull()
    error = F.coalesce(
        F.when(mapped & (crs1 != crs2), "crs_mismatch"),
        F.when(mapped & (share < 0.50), "low_overlap"),
        F.when(~mapped & (score < 0.15), "low_alignment"),
    )
    warn = F.array_compact(
        F.array(
            F.when(mapped & (share < 0.95), "partial_overlap"),
            F.when(F.abs(res1 - res2) / F.greatest(res1, res2) > 0.10, "resolution_mismatch"),
            F.when(
                d1.isNull() & d2.isNull(),
                "missing_dates",
            ).when(d1.isNull() | d2.isNull(), "missing_date").when(d1 >= d2, "reversed_dates"),
        )
    )
    return error, warn


def cross_modal_issue(m1: Column, m2: Column, crs1: Column, crs2: Column, share: Column) -> tuple[Column, Column]:
    """FLT10. The error of an optical and SAR pair, and whether the two are to be swapped."""
    optical = lambda m: m.isin("optical", "multispectral")
    ok = (optical(m1) & (m2 == "sar")) | ((m1 == "sar") & optical(m2))
    return F.coalesce(
        F.when(crs1.isNull() | crs2.isNull(), "no_crs"),
        F.when(~ok, "not_optical_and_sar"),
        F.when(share < 0.20, "low_overlap"),
    ), ok & (m1 == "sar")


REQUEST_TYPE = "request long, query string, t1 string, t2 string, hint string"


def requests_of(df: DataFrame, body: str) -> DataFrame:
    """SRC5: request, query, t1, t2, hint of each JSON body, one row a request; t2 and hint may be missing."""
    return df.select(F.from_json(body, REQUEST_TYPE).alias("r")).select("r.*")


def temporal_status(d1: Column, d2: Column) -> Column:
    """FLT11. What is known of a pair's order in time."""
    return F.when(
        d1.isNull() & d2.isNull(),
        "missing_dates",
    ).when(d1.isNull() | d2.isNull(), "unverified").when(d1 >= d2, "reversed").otherwise("valid")


def validation_result(errors: Column, warnings: Column) -> Column:
    """FLT11. struct(ok, status, errors, warnings) of lists of issues."""
    status = F.when(F.size(errors) > 0, "invalid").when(F.size(warnings) > 0, "valid_with_warnings").otherwise("valid")
    return F.struct((F.size(errors) == 0).alias("ok"), status.alias("status"), errors.alias("errors"), warnings.alias("warnings"))


def pair_compatibility(error: Column, warnings: Column, share: Column, d1: Column, d2: Column) -> Column:
    """FLT11. struct(compatible, reason, overlap_pct, temporal, warnings) of a pair's issues."""
    return F.struct(
        error.isNull().alias("compatible"),
        error.alias("reason"),
        F.round(share * 100.0, 2).alias("overlap_pct"),
        temporal_status(d1, d2).alias("temporal"),
        warnings.alias("warnings"),
    )
