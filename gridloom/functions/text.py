"""Text expressions: query normalising, parsing of model answers, answer matching, dates, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of referring queries.
PREFIXES = [
    "where is the",
    "where are the",
    "where is a",
    "where is an",
    "where are",
    "where is",
    "locate the",
    "locate a",
    "locate an",
    "locate",
    "find the",
    "find a",
    "find an",
    "find",
    "highlight the",
    "highlight a",
    "highlight an",
    "highlight",
    "detect the",
    "detect a",
    "detect an",
    "detect",
    "identify the",
    "identify a",
    "identify an",
    "identify",
    "show me the",
    "show me a",
    "show me",
    "can you find the",
    "can you locate the",
    "can you highlight the",
]
PREFIX_PATTERN = "(?i)^(" + "|".join(sorted(PREFIXES, key=len, reverse=True)) + ")"


def referring_phrase(q: Column) -> Column:
    """STR1. What a referring query asks for, as a phrase that ends with a period."""
    t = F.trim(F.regexp_replace(F.trim(q), PREFIX_PATTERN, ""))
    t = F.trim(F.regexp_replace(t, r"(?i)^(the |an |a )", ""))
    t = F.trim(F.regexp_replace(t, r"[?!.]+$", ""))
    return F.concat(F.when(t == "", "object").otherwise(t), F.lit("."))


def boxes_in_text(answer: Column, w: Column, h: Column) -> Column:
    """STR2. Quadruples of numbers in an answer, as arrays x0, y0, x1, y1 in pixels. A `box_2d` key means
    y0, x0, y1, x1 in thousandths; box tokens hold (x, y) pairs in thousandths; else brackets: all at most 1 are
    shares of the sides, all at most 1000 are thousandths in y, x order, larger ones are pixels."""
    num = r"(-?\d+(?:\.\d+)?)"
    quad = r"\[\s*" + r"\s*,\s*".join([num] * 4) + r"\s*\]"
    pairs = r"<\|box_start\|>\s*\(" + num + r"\s*,\s*" + num + r"\)\s*,\s*\(" + num + r"\s*,\s*" + num + r"\)"

    def numbers(pattern: str) -> Column:
        parts = [F.regexp_extract_all(answer, F.lit(pattern), F.lit(i)) for i in range(1, 5)]
        return F.transform(
            F.arrays_zip(*[p.alias(f"n{i}") for i, p in enumerate(parts)]),
            lambda x: F.array(*[x[f"n{i}"].cast("double") for i in range(4)]),
        )

    thousand = lambda x, order: F.array(*[F.get(x, F.lit(i)) / 1000.0 * (w if k % 2 == 0 else h) for k, i in enumerate(order)])

    def bracket(x: Column) -> Column:
        most = F.array_max(x)
        return (F.when(most <= 1.0, F.array(F.get(x, F.lit(0)) * w, F.get(x, F.lit(1)) * h, F.get(x, F.lit(2)) * w, F.get(x, F.lit(3)) * h))
                .when(most <= 1000.0, thousand(x, (1, 0, 3, 2))).otherwise(x))

    json_ = F.transform(numbers(r'"box_2d"\s*:\s*' + quad), lambda x: thousand(x, (1, 0, 3, 2)))
    token = F.transform(numbers(pairs), lambda x: thousand(x, (0, 1, 2, 3)))
    loose = F.transform(numbers(quad), bracket)
    return F.when(F.size(json_) > 0, json_).when(F.size(token) > 0, token).otherwise(loose)


def json_answer(t: Column, schema: str, fields: list[str]) -> Column:
    """STR3. The outermost braces as JSON, else the whole text, else each field by pattern, else null fields."""
    # Fields are text, so that one unusual value doesn't lose the others.
    strict = F.from_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1), schema)
    whole = F.from_json(t, schema)
    pick = lambda f: F.nullif(F.regexp_extract(t, rf'"{f}"\s*:\s*"?([^",}}]+)', 1), F.lit(""))
    return F.struct(*[F.coalesce(strict[f], whole[f], F.trim(pick(f))).alias(f) for f in fields])


def answer_matches(pred: Column, truth: Column) -> dict[str, Column]:
    """STR10 to STR12: three ways of calling an answer right. In `either` an empty answer matches (as named)."""
    p, g = F.lower(F.trim(pred)), F.lower(F.trim(truth))
    bare = lambda c: F.trim(F.regexp_replace(c, r"(?U)[^\w\s]", ""))
    tokens = lambda c: F.split(bare(c), r"(?U)\s+")
    long_in = lambda n: F.exists(tokens(g), lambda w: (F.length(w) > n) & F.contains(p, w))
    strict = (bare(p) == bare(g)) | ((F.size(tokens(g)) == 1) & F.array_contains(tokens(p), bare(g))) | F.contains(bare(p), bare(g))
    return {
        "strict": strict,
        "relaxed": strict | long_in(3),
        "either": F.contains(p, g) | F.contains(g, p) | long_in(4),
        "contained": F.contains(p, g),
        "contained_relaxed": F.contains(p, g) | long_in(3),
    }


def change_answer_correct(answer: Column, direction: Column, truth: Column, truth_direction: Column) -> Column:
    """STR13. A yes or no against the predicted direction or else the answer's text; any other truth by its direction."""
    g, d = F.lower(F.coalesce(truth, F.lit(""))), F.coalesce(F.nullif(F.lower(direction), F.lit("")), F.lit("unknown"))
    said = ((g == "yes") & d.isin("increased", "modified", "decreased")) | ((g == "no") & (d == "no_change")) | F.contains(
        F.lower(F.coalesce(answer, F.lit(""))),
        g,
    )
    return F.when(g.isin("yes", "no"), said).otherwise(F.coalesce(d == F.nullif(F.lower(truth_direction), F.lit("")), F.lit(False)))


# Words of each class, as parts of words, and patterns of whole words, of which the first match counts.
CLASS_WORDS = {
    "built_structure": ["built", "building", "urban", "structure", "construction", "roof"],
    "water_body": ["water", "aquatic", "lake", "river", "reservoir", "flood"],
    "vegetation_or_cropland": ["vegetation", "crop", "cropland", "agriculture", "forest", "tree"],
    "bare_ground_or_soil": ["bare", "soil", "ground", "dirt", "cleared"],
    "road_or_infrastructure": ["road", "highway", "infrastructure", "pavement", "runway"],
}
CLASS_PATTERNS = {
    "built-up / building": "buildings?|structures?|houses?|settlements?|residential|commercial|industrial|urban|built[- ]up",
    "vegetation / cropland": "vegetation|crops?|cropland|farmland|pasture|grassland|agricultural",
    "forest / canopy": "forests?|trees?|woodlands?|deforestation|timber",
    "water body": "water(?:[- ]body)?|lakes?|rivers?|reservoirs?|ponds?|floods?|flooding|wetlands?",
    "bare ground / soil": "bare[- ]ground|bare[- ]soil|soils?|dirt|sand|cleared[- ]land|unpaved",
    "road / infrastructure": "roads?|highways?|runways?|bridges?|infrastructure|pavement",
}


def target_classes(q: Column) -> Column:
    """STR5. All classes of which the query has a word, also as a part of another word."""
    return F.array_compact(F.array(*[F.when(F.lower(q).rlike("|".join(ws)), k) for k, ws in CLASS_WORDS.items()]))


def target_class(q: Column) -> Column:
    """STR5. The first class that the query names by a whole word, else null."""
    return F.coalesce(*[F.when(F.lower(q).rlike(rf"(?U)\b(?:{p})\b"), k) for k, p in CLASS_PATTERNS.items()])


def question_kind(q: Column) -> Column:
    """STR8. The kind of a question by its words, first match."""
    l = F.lower(q)  # noqa: E741
    return (
        F.when(F.contains(l, F.lit("how many")) | F.contains(l, F.lit("number of")), "count").when(
            F.contains(l, F.lit("is there")) | F.contains(l, F.lit("are there")),
            "presence",
        ) .when(F.contains(l, F.lit("more")) | F.contains(l, F.lit("less")), "comparison").when(
            F.contains(l, F.lit("rural")) | F.contains(l, F.lit("urban")),
            "rural_urban",
        ).otherwise("other")
    )


# Words that tell a scene's domain, the first that occurs counts.
DOMAINS = ["urban", "forest", "agri", "water", "infra", "coastal", "mining", "nuisance", "industrial"]


def scene_domain(*texts: Column, domains: list[str] | None = None, other: str = "other") -> Column:
    """STR9. The first of the domains that one of the texts contains, also within a word."""
    holds = lambda d: F.exists(F.array(*[F.coalesce(F.lower(t), F.lit("")) for t in texts]), lambda t: F.contains(t, d))
    found = F.filter(F.array(*[F.lit(d) for d in domains or DOMAINS]), holds)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(other))


# Tags that name the sensor, those that hold the date, and how dates are written.
SENSOR_TAGS = ["SENSOR_ID", "SPACECRAFT_NAME", "PLATFORM", "MISSION"]
DATE_TAGS = ["ACQUISITION_DATETIME", "TIFFTAG_DATETIME", "ACQUISITION_DATE", "DATE_ACQUIRED", "DATETIME", "date"]
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd"]


def sensor(tags: Column) -> Column:
    """SRC3. The first tag that names the sensor and isn't empty."""
    return F.coalesce(*[F.nullif(F.element_at(tags, k), F.lit("")) for k in SENSOR_TAGS])


def acquisition_date(tags: Column, filename: Column) -> Column:
    """STR6. The first readable date among tags, else one in the file's name, of the years 1970 to 2035."""
    read = lambda v: F.coalesce(*[F.to_date(F.try_to_timestamp(F.substring(v, 1, 19), F.lit(f))) for f in DATE_FORMATS])
    part = lambda i: F.regexp_extract(filename, r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", i)
    named = F.to_date(F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")))
    found = F.coalesce(*[read(F.element_at(tags, k)) for k in DATE_TAGS], named)
    return F.when(F.year(found).between(1970, 2035), found)


def without_paths(t: Column) -> Column:
    """STR7. Local paths of either system replaced."""
    return F.regexp_replace(F.regexp_replace(t, r"[A-Za-z]:\\\\?[^\s'\"]+", "<path>"), r"/(?:tmp|home|var)/[^\s'\"]+", "<path>")


def stable_id(prefix: str, *keys: Column) -> Column:
    """STR17. An id that the keys alone decide."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws(":", *keys).cast("binary"), 256), 1, 8))


def hash_order(seed: str, key: Column) -> Column:
    """WIN10, WIN11. What a seeded shuffle sorts by."""
    return F.sha2(F.concat(F.lit(seed), key.cast("string")).cast("binary"), 256)


# Directions of change, roots of class names, and words that tell a scene's domain.
DIRECTIONS = ["increased", "decreased", "no_change", "modified"]


def semantic_validation(direction: Column, changed_px: Column, from_: Column, to: Column, confidence: Column, classes: list[str]) -> Column:
    """STR4. struct(direction, uncertain, confidence, uncertainty): a direction that isn't known, or no change beside many
    changed pixels, is `modified`; an unknown class or one that stays the same is uncertain, which caps the confidence."""
    ok = F.when(
        ~direction.isin(DIRECTIONS) | direction.isNull() | ((direction == "no_change") & (changed_px > 500)),
        "modified",
    ).otherwise(direction)
    unsure = F.coalesce(~from_.isin(classes) | (from_ == to), F.lit(True))
    sure = F.when(unsure, F.least(confidence, F.lit(0.60))).otherwise(confidence)
    return F.struct(ok.alias("direction"), unsure.alias("uncertain"), sure.alias("confidence"), F.round(1.0 - sure, 4).alias("uncertainty"))


def change_narrative(px: Column, parts: Column, m2_per_px: float) -> Column:
    """STR14."""
    said = F.format_string("%d px changed over %d parts (%.2f ha).", px, parts, px * m2_per_px / 10000.0)
    return F.when(px == 0, "No change was found.").otherwise(said)


def fusion_narrative(built: Column, water: Column) -> Column:
    """STR14, CMP6."""
    return F.format_string("Both sensors together show %d pixels of buildings, by double bounce, and %d of open water, by its smooth surface.", built, water)


def stages_narrative(stages: Column) -> Column:
    """STR14: what a request's stages, an array of struct(name, finding) in order, found one after the other; a stage without a
    finding says so, and without any stage there is nothing to tell."""
    said = F.transform(stages, lambda x, i: F.format_string("Step %d, %s: %s.", i + 1, x["name"], F.coalesce(x["finding"], F.lit("nothing was found"))))
    return F.when(F.coalesce(F.size(stages), F.lit(0)) == 0, "No stage ran.").otherwise(F.concat_ws(" ", said))


def scene_questions(scene: Column, kinds: Column, absent: Column, crs: Column, bounds: Column | None = None, pixel: Column | None = None) -> Column:
    """STR15. Questions and answers of a scene's annotations: what it is, what is there, what isn't, its map grid, the ground
    that its bounds (minx, miny, maxx, maxy, in m) hold, and its pixels' size in m. An array of struct(family, question,
    answer); those without an annotation are left out."""
    bounds = F.lit(None).cast("array<double>") if bounds is None else bounds
    pixel = F.lit(None).cast("double") if pixel is None else pixel
    qa = lambda family, q, a, cond: F.when(cond, F.struct(F.lit(family).alias("family"), q.alias("question"), a.alias("answer")))
    first = F.get(kinds, F.lit(0))
    return F.array_compact(
        F.array(
            qa("scene", F.format_string("What does scene %s show?", scene), F.concat_ws(", ", kinds), F.size(kinds) > 0),
            qa(
                "inventory",
                F.format_string("How many kinds are there in scene %s?", scene),
                F.size(kinds).cast("string"),
                F.size(kinds) > 0,
            ),
            qa("presence", F.format_string("Is there %s in scene %s?", first, scene), F.lit("yes"), F.size(kinds) > 0),
            qa(
                "hard_negative",
                F.format_string("Is there %s in scene %s?", absent, scene),
                F.lit("no"),
                absent.isNotNull() & ~F.array_contains(kinds, absent),
            ),
            qa("crs", F.format_string("Which map grid has scene %s?", scene), crs, crs.isNotNull()),
            qa(
                "extent",
                F.format_string("How much ground does scene %s show?", scene),
                F.format_string("%.2f x %.2f km", (F.get(bounds, F.lit(2)) - F.get(bounds, F.lit(0))) / 1000.0, (F.get(bounds, F.lit(3)) - F.get(bounds, F.lit(1))) / 1000.0),
                F.size(bounds) == 4,
            ),
            qa("gsd", F.format_string("How large is a pixel of scene %s?", scene), F.format_string("%.2f m", pixel), pixel > 0),
        )
    )


def spatial_summary(sensor: Column, crs: Column, width: Column, height: Column) -> Column:
    """SRC4. A raster in a line, with words for what is missing."""
    return F.concat_ws(
        ", ",
        F.coalesce(sensor, F.lit("unknown sensor")),
        F.coalesce(crs, F.lit("no CRS")),
        F.when(width.isNotNull() & height.isNotNull(), F.format_string("%d x %d px", width, height)).otherwise("size unknown"),
    )
