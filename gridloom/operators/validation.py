"""FLT9, FLT10, FLT12. Whether two rasters make a pair: the first error in order, and what to warn of where there is none.

Both validators take two structs of a raster's header, of HEADER's fields and these: found, filename, modality, date. Errors and
warnings are codes, each with a sentence of its numbers. Grids of two map systems would need a projection, which isn't
here: such a pair is refused as such."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least side, the least shares of ground in common, the share from which ground counts as whole, the
#: relative difference of pixels and the alignment score that are remarked on or refused.
LEAST_SIDE, LEAST_SHARE, LEAST_CROSS_SHARE, WHOLE, PIXELS_DIFFER, LEAST_SCORE = 16, 0.50, 0.20, 0.95, 10.0, 0.15
#: What stands for no map system.
NO_CRS = ["", "none", "null"]

#: The header's fields that are looked at, for a struct of nulls where a file isn't there.
SIDE = "struct<found: boolean, filename: string, error_kind: string, width: int, height: int, n_bands: int, crs: string, transform: array<double>, bounds: array<double>, resolution: array<double>, modality: string, date: timestamp>"


def has_crs(side: Column) -> Column:
    return side["crs"].isNotNull() & ~F.lower(side["crs"]).isin(NO_CRS)


def shared_ground(a: Column, b: Column) -> Column:
    """struct(area, share1, share2) of two bounds (minx, miny, maxx, maxy), shares with four decimals; null without any."""
    low, high = [F.greatest(a[i], b[i]) for i in (0, 1)], [F.least(a[i], b[i]) for i in (2, 3)]
    area = (high[0] - low[0]) * (high[1] - low[1])
    share = lambda r: F.round(F.least(F.lit(1.0), area / F.greatest(F.lit(1e-6), (r[2] - r[0]) * (r[3] - r[1]))), 4)
    found = F.struct(area.alias("area"), share(a).alias("share1"), share(b).alias("share2"))
    return F.when((low[0] < high[0]) & (low[1] < high[1]), found)


def _issue(code: str, text: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def _first(*rules: tuple[Column, str, Column | str]) -> Column:
    """The first rule that holds; a condition of unknowns doesn't."""
    return F.coalesce(*[F.when(cond, _issue(code, text)) for cond, code, text in rules])


def _all(*rules: tuple[Column, str, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, _issue(code, text)) for cond, code, text in rules]))


def _found(a: Column, b: Column) -> list:
    say = lambda s, what: F.format_string(f"%s {what}", F.coalesce(s["filename"], F.lit("a file")))
    missing = [(~F.coalesce(s["found"], F.lit(False)), f"{n}_not_found", say(s, "isn't there.")) for s, n in ((a, "first"), (b, "second"))]
    broken = [(s["error_kind"].isNotNull(), f"{n}_unreadable", F.format_string("%s can't be read: %s.", s["filename"], s["error_kind"])) for s, n in ((a, "first"), (b, "second"))]
    return missing + broken


def _no_size(a: Column, b: Column) -> Column:
    return F.least(a["width"], a["height"], b["width"], b["height"]) <= 0


def temporal_rules(d1: Column, d2: Column) -> list:
    """FLT12: what is to be remarked on two dates' order."""
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    return [
        (d1.isNull() & d2.isNull(), "missing_dates", "Neither image has a date, so their order isn't known."),
        (d1.isNull() & d2.isNotNull(), "first_date_missing", "The first image has no date, so their order isn't known."),
        (d1.isNotNull() & d2.isNull(), "second_date_missing", "The second image has no date, so their order isn't known."),
        (d1 >= d2, "reversed_dates", F.format_string("The first image, of %s, isn't earlier than the second, of %s.", day(d1), day(d2))),
    ]


def _result(error: Column, warnings: Column, **more: Column) -> Column:
    none = F.array().cast("array<struct<code: string, text: string>>")
    own = [v.alias(k) for k, v in more.items()]
    return F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(error.isNull(), warnings).otherwise(none).alias("warnings"), *own)


def _percent(share: Column) -> Column:
    return F.round(share * 100.0, 1)


def bitemporal(a: Column, b: Column, score: Column, least_share: float = LEAST_SHARE) -> Column:
    """FLT9: struct(valid, error, warnings, mode, overlap, ordered) of two images of one place, error and warnings being
    struct(code, text). Where both have a map system the mode is `map`, else `pixels`: then score, how alike the images
    are (see alignment), stands for the shared ground."""
    mapped = has_crs(a) & has_crs(b)
    ground = shared_ground(a["bounds"], b["bounds"])
    least = F.least(ground["share1"], ground["share2"])
    other = a["modality"] != b["modality"]
    apart = F.abs(a["resolution"][0] - b["resolution"][0]) / F.greatest(a["resolution"][0], F.lit(1e-6)) * 100.0
    size = lambda s: F.format_string("%d x %d", s["width"], s["height"])
    small = F.least(a["width"], a["height"], b["width"], b["height"]) < LEAST_SIDE
    pixels = ~mapped
    error = _first(
        *_found(a, b),
        (mapped & a["transform"].isNull(), "first_without_transform", "The first image has no transform to the map."),
        (mapped & b["transform"].isNull(), "second_without_transform", "The second image has no transform to the map."),
        (_no_size(a, b), "no_size", "An image has no lines or columns."),
        (pixels & small, "too_small", f"An image has fewer than {LEAST_SIDE} lines or columns."),
        (pixels & (score < LEAST_SCORE), "unrelated", F.format_string("The images have nothing in common (alignment %.2f).", score)),
        (mapped & (a["crs"] != b["crs"]), "other_crs", F.format_string("The images are in %s and %s, and nothing here projects one to the other.", a["crs"], b["crs"])),
        (mapped & ground.isNull(), "disjoint", "The images share no ground."),
        (mapped & (least < least_share), "low_overlap", F.format_string("The images share %.1f per cent of their ground, less than %.0f.", _percent(least), F.lit(least_share * 100))),
    )
    same_size = (a["width"] == b["width"]) & (a["height"] == b["height"])
    warnings = F.concat(
        _all(
            (pixels, "pixels_only", "Without a map system areas on the ground can't be told; the pair is compared by pixels."),
            (pixels & ~same_size, "size_differs", F.format_string("The images have %s and %s pixels; the second is resampled.", size(a), size(b))),
            (pixels, "alignment", F.format_string("The images' alignment is %.2f.", score)),
            (mapped & (apart > PIXELS_DIFFER), "resolution_differs", F.format_string("Pixels of %.2f and %.2f m differ by %.1f per cent; the second image is resampled.", a["resolution"][0], b["resolution"][0], apart)),
            (mapped & (least < WHOLE), "partial_overlap", F.format_string("The images share %.1f per cent of their ground; the rest is cut off.", _percent(least))),
        ),
        _all(
            *temporal_rules(a["date"], b["date"]),
            (other, "other_modality", F.format_string("The first image is %s, the second %s.", a["modality"], b["modality"])),
            (mapped & (a["n_bands"] != b["n_bands"]), "bands_differ", F.format_string("The images have %d and %d bands; those in common are taken.", a["n_bands"], b["n_bands"])),
        ),
    )
    overlap = F.when(mapped, least).otherwise(score)
    ordered = F.coalesce(a["date"] < b["date"], F.lit(False))
    return _result(error, warnings, mode=F.when(mapped, "map").otherwise("pixels"), overlap=overlap, ordered=ordered)


def cross_modal(a: Column, b: Column, least_share: float = LEAST_CROSS_SHARE) -> Column:
    """FLT10: struct(valid, error, warnings, swapped, overlap) of an optical image and one of radar, in either order; swapped
    where the radar one came first."""
    optical = lambda s: s["modality"].isin("optical", "multispectral")
    radar = lambda s: s["modality"] == "sar"
    swapped = radar(a) & optical(b)
    ground = shared_ground(a["bounds"], b["bounds"])
    least = F.least(ground["share1"], ground["share2"])
    error = _first(
        *_found(a, b),
        (~has_crs(a), "first_without_crs", F.format_string("%s has no map system.", a["filename"])),
        (~has_crs(b), "second_without_crs", F.format_string("%s has no map system.", b["filename"])),
        (_no_size(a, b), "no_size", "An image has no lines or columns."),
        (a["transform"].isNull() | b["transform"].isNull(), "without_transform", "An image has no transform to the map."),
        (optical(a) & optical(b), "both_optical", "Both images are optical; one of radar is needed."),
        (radar(a) & radar(b), "both_sar", "Both images are of radar; an optical one is needed."),
        (~F.coalesce((optical(a) & radar(b)) | swapped, F.lit(False)), "unsupported_pair", F.format_string("%s and %s make no pair; an optical image and one of radar are needed.", F.coalesce(a["modality"], F.lit("unknown")), F.coalesce(b["modality"], F.lit("unknown")))),
        (a["crs"] != b["crs"], "other_crs", F.format_string("The images are in %s and %s, and nothing here projects one to the other.", a["crs"], b["crs"])),
        (ground.isNull(), "disjoint", "The images share no ground."),
        (least < least_share, "low_overlap", F.format_string("The images share %.1f per cent of their ground, less than %.0f.", _percent(least), F.lit(least_share * 100))),
    )
    warnings = _all(
        (swapped, "swapped", "The radar image came first; the two are taken the other way round."),
        (least < WHOLE, "partial_overlap", F.format_string("The images share %.1f per cent of their ground; the rest is cut off.", _percent(least))),
    )
    return _result(error, warnings, swapped=F.coalesce(swapped, F.lit(False)), overlap=least)
