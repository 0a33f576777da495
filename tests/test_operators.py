"""Hand-computed cases and properties of the operators."""

import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import text as T
from gridloom.operators import alignment as A
from gridloom.operators import change as CH
from gridloom.operators import corpus as K
from gridloom.operators import detections as D
from gridloom.operators import evidence as E
from gridloom.operators import routing as R
from gridloom.operators import scoring as S
from gridloom.plans import registry as P
from gridloom.sources import documents as SD
from gridloom.operators import passages as PS
from gridloom.sources import archives as AR
from gridloom.sources import blocks as BL
from gridloom.sources import raster as SR


def mask(spark, points):
    return spark.createDataFrame([(0, y, x) for y, x in points], "scene long, y int, x int")


def points(df):
    return {(r["y"], r["x"]) for r in df.collect()}


def opened_closed(m):
    pad = lambda a: np.pad(a, 1)
    win = lambda a, f: f([pad(a)[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0)
    e = lambda a: win(a, np.min)
    d = lambda a: win(a, np.max)
    return e(d(d(e(m))))


def labels_of(m):
    """Flood fill in raster order."""
    out, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m)):
        if out[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not out[a, b]:
                out[a, b] = n
                stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


def test_morphology_and_components_like_numpy(spark):
    m = np.random.default_rng(3).random((24, 20)) < 0.6
    m[2:9, 3:12] = True
    df = mask(spark, [(int(y), int(x)) for y, x in zip(*np.nonzero(m))])
    want = opened_closed(m.astype(int))
    assert points(CH.opened_closed(df, 24, 20)) == {(int(y), int(x)) for y, x in zip(*np.nonzero(want))}
    lab = labels_of(m)
    assert {
        (r["y"], r["x"], r["label"])
        for r in CH.components(df, 20).collect()
    } == {(int(y), int(x), int(lab[y, x])) for y, x in zip(*np.nonzero(lab))}


def test_morphology_across_words_like_numpy(spark):
    """Widths below, at and above the number of pixels in a word, with runs over the seams and at the borders."""
    r = np.random.default_rng(5)
    for width in (1, 3, 63, 64, 65, 130):
        m = r.random((9, width)) < 0.75
        m[2:7, max(0, width - 70) :] = True
        df = mask(spark, [(int(y), int(x)) for y, x in zip(*np.nonzero(m))])
        assert points(CH.pixels_of(CH.words(df))) == {(int(y), int(x)) for y, x in zip(*np.nonzero(m))}
        assert points(CH.opened_closed(df, 9, width)) == {(int(y), int(x)) for y, x in zip(*np.nonzero(opened_closed(m)))}, width


def test_regions_over_cells(spark):
    """Regions larger than a cell: the mean over the whole bounding box."""
    h, w = 150, 140
    diff = spark.range(h * w).select(
        F.lit(0).alias("scene"),
        F.floor(F.col("id") / w).cast("int").alias("y"),
        (F.col("id") % w).cast("int").alias("x"),
        (F.col("id") % 97 / 97).alias("d"),
    )
    box = lambda y0, y1, x0, x1: (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    found = CH.regions(CH.components(diff.where(box(3, 140, 60, 130) | box(0, 20, 5, 40)), w), diff).orderBy("label").collect()
    d = (np.arange(h * w) % 97 / 97).reshape(h, w)
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["pixels"]) for r in found] == [(5, 0, 40, 20, 700), (60, 3, 130, 140, 137 * 70)]
    assert all(abs(r["mean_d"] - round(d[r["y0"] : r["y1"], r["x0"] : r["x1"]].mean(), 4)) < 2e-4 for r in found)


def test_snake_component(spark):
    """A spiral that no label crosses in a few steps."""
    path = [(0, x) for x in range(15)] + [(1, 14)] + [(2, x) for x in range(15)] + [(3, 0)] + [(4, x) for x in range(15)]
    assert {r["label"] for r in CH.components(mask(spark, path), 15).collect()} == {1}


def test_two_by_two_opening_keeps_squares_only(spark):
    assert points(
        CH.opened_2x2(mask(spark, [(0, 0), (0, 1), (1, 0), (1, 1), (5, 5), (7, 7), (7, 8)]), 10, 10)
    ) == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_injected_block_is_found_and_equal_images_are_not(spark):
    px = [
        (0, y, x, [70.0, 140.0, 60.0], [210.0, 215.0, 220.0] if 10 <= y < 20 and 10 <= x < 20 else [70.0, 140.0, 60.0])
        for y in range(30)
        for x in range(30)
    ]
    pair = spark.createDataFrame(px, "scene long, y int, x int, a array<double>, b array<double>")
    o = CH.detect(pair, 30, 30)
    assert o["zonal"].first().asDict() == {
        "scene": 0,
        "total": 900,
        "changed": 100,
        "ratio_pct": 11.1111,
        "area_m2": 10000.0,
        "area_ha": 1.0,
        "warning": None,
    }
    same = CH.detect(pair.withColumn("b", F.col("a")), 30, 30)["zonal"].first()
    assert (same["changed"], same["warning"]) == (0, "no_change")


def test_roughness_mirrors_the_border(spark):
    v = np.random.default_rng(1).random((7, 6))
    df = spark.createDataFrame([(0, y, x, float(v[y, x])) for y in range(7) for x in range(6)], "scene long, y int, x int, sar double")
    p = np.pad(v, 2, mode="symmetric")
    got = {(r["y"], r["x"]): r["rough"] for r in CH.roughness(df, 7, 6).collect()}
    assert all(abs(got[y, x] - p[y : y + 5, x : x + 5].std()) < 1e-9 for y in range(7) for x in range(6))


box = st.tuples(*[st.integers(0, 40)] * 4).map(lambda t: (min(t[0], t[2]), min(t[1], t[3]), max(t[0], t[2]) + 1, max(t[1], t[3]) + 1))


@settings(max_examples=3, deadline=None)
@given(st.lists(box, min_size=1, max_size=12))
def test_suppression_is_idempotent_and_iou_symmetric(spark, found):
    df = spark.createDataFrame(
        [(1, i, *map(float, b), round(1 - i / 20, 2)) for i, b in enumerate(found)],
        "image long, ord int, x0 double, y0 double, x1 double, y1 double, score double",
    )
    once = D.suppress(df, 0.5)
    assert {r["ord"] for r in D.suppress(once, 0.5).collect()} == {r["ord"] for r in once.collect()}
    a, b = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.lit(v) for v in (3.0, 3.0, 20.0, 21.0))
    assert all(r["p"] == r["q"] and 0 <= r["p"] <= 1 for r in df.select(B.iou(a, b).alias("p"), B.iou(b, a).alias("q")).collect())


def test_box_facts(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 100.0, 100.0), (float("nan"), 0.0, 1.0, 1.0), (5.0, 5.0, 5.0, 9.0), (9.0, 0.0, 1.0, 1.0), (-5.0, 3.0, 300.0, 40.0)],
        "x0 double, y0 double, x1 double, y1 double",
    )
    c = tuple(F.col(n) for n in df.columns)
    out = df.select(
        B.degeneracy(*c, F.lit(100.0), F.lit(100.0)).alias("d"),
        B.area(*c).alias("a"),
        F.array(*B.clamped(*c, F.lit(100.0), F.lit(100.0))).alias("c"),
    ).collect()
    assert [r["d"] for r in out] == ["full_image_coverage_100pct", "non_finite", "zero_area", "inverted", "full_image_coverage_112pct"]
    assert [r["a"] for r in out] == [10000.0, 0.0, 0.0, 0.0, 305.0 * 37]
    assert out[4]["c"] == [0.0, 3.0, 100.0, 40.0]


def test_processed_boxes_filter_reads_columns(spark):
    """The optimizer doesn't put the clamped expressions into the filter, for each of their uses; odd boxes go."""
    nan, inf = float("nan"), float("inf")
    odd = [(nan, 0.0, 1.0, 1.0), (0.0, 0.0, inf, 9.0), (None, 0.0, 50.0, 50.0), (9.0, 9.0, 5.0, 20.0), (5.0, 5.0, 5.0, 9.0), (0.0, 0.0, 512.0, 508.0), (3.0, 3.0, 6.0, 6.0)]
    fine = [(10.0, 10.0, 30.0, 40.0), (-5.0, 3.0, 300.004, 40.0), (500.0, 500.0, 600.0, 700.0)]
    rows = [(i, 1, *b, 0.5) for i, b in enumerate(odd + fine)]
    df = spark.createDataFrame(rows, "image long, ord int, x0 double, y0 double, x1 double, y1 double, score double")
    out = D.processed(df.withColumn("x0", F.col("x0") + F.lit(0.0)))
    got = sorted((r["image"] - len(odd), r["x0"], r["y0"], r["x1"], r["y1"]) for r in out.collect())
    assert got == [(0, 10.0, 10.0, 30.0, 40.0), (1, 0.0, 3.0, 300.0, 40.0), (2, 500.0, 500.0, 512.0, 512.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("round(" in line for line in plan if "Filter" in line)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 50)] * 4).filter(lambda t: sum(t) > 0), min_size=1, max_size=6))
def test_metric_bounds(spark, cells):
    c = spark.createDataFrame(cells, "tp long, fp long, fn long, tn long")
    for r in S.metrics_explicit(c).collect():
        assert 0 <= r["iou"] <= r["f1"] + 1e-4 <= 1.0002
    m = S.micro(c).first()
    tp, fp, fn = (sum(t[i] for t in cells) for i in range(3))
    assert m["iou"] == (1.0 if tp + fp + fn == 0 else round(tp / (tp + fp + fn) + 1e-12, 4)) or abs(m["iou"] - tp / max(1, tp + fp + fn)) < 1e-4


def test_empty_masks_differ_by_variant(spark):
    c = spark.createDataFrame([(0, 0, 0, 10)], "tp long, fp long, fn long, tn long")
    assert (S.metrics_eps(c).first()["f1"], S.metrics_explicit(c).first()["f1"], S.metrics_bench(c).first()["f1"]) == (0.0, 1.0, 1.0)


def test_routes(spark):
    rows = [
        ("What changed between these two dates?", "optical", "optical", None),
        ("Did buildings increase?", "optical", "optical", None),
        ("Where is the lake?", "optical", None, None),
        ("what changed over time?", "optical", None, None),
        ("land cover?", "optical", "sar", None),
        ("anything", "optical", None, "fusion"),
        ("Generate a caption", "optical", None, None),
    ]
    got = [
        (r["task"], r["rejection"])
        for r in R.route(spark.createDataFrame(rows, "query string, m1 string, m2 string, hint string")).collect()
    ]
    assert got == [
        ("change_detection", None),
        ("change_vqa", None),
        ("grounding", None),
        ("change_detection", "temporal_on_single"),
        ("optical_sar_analysis", None),
        ("optical_sar_analysis", "needs_two_images"),
        ("caption", None),
    ]


def test_boxes_in_answers(spark):
    rows = [
        ('{"box_2d": [100, 200, 300, 400]}',),
        ("<|box_start|>(10,20),(30,40)<|box_end|>",),
        ("[0.1, 0.2, 0.5, 0.6]",),
        ("[100, 200, 900, 950]",),
        ("[1200, 30, 1500, 600]",),
        ("no",),
    ]
    out = [
        r["b"]
        for r in spark.createDataFrame(rows, "a string").select(T.boxes_in_text(F.col("a"), F.lit(2000.0), F.lit(1000.0)).alias("b")).collect()
    ]
    assert out == [
        [[400.0, 100.0, 800.0, 300.0]],
        [[20.0, 20.0, 60.0, 40.0]],
        [[200.0, 200.0, 1000.0, 600.0]],
        [[400.0, 100.0, 1900.0, 900.0]],
        [[1200.0, 30.0, 1500.0, 600.0]],
        [],
    ]


def test_confidence_is_capped_by_status(spark):
    one = F.lit(1.0)
    rows = spark.createDataFrame(
        [("consistent", False), ("contradictory", True), ("uncertain", False)],
        "s string, c boolean",
    ).select(S.confidence(one, one, F.lit(0.95), one, F.col("s"), F.lit(1), F.col("c")).alias("v"))
    v = [r["v"] for r in rows.collect()]
    assert v == [0.975, 0.05, 0.4825]


def test_phase_shift_of_a_rolled_image():
    a = np.random.default_rng(0).random((40, 32))
    r = A.phase_shift(a, np.roll(a, (3, -2), (0, 1)))
    assert (r["dy"], r["dx"]) == (3, -2) and r["score"] > 0.9
    assert A.phase_shift(a * 0, a)["score"] == 0.20


def test_split_and_caps_are_deterministic(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("s"))
    a, b = K.split(df, 120, "v", "doc_id"), K.split(df.repartition(7), 120, "v", "doc_id")
    assert a.where("split = 'val'").count() == 120 and a.exceptAll(b).count() == 0
    assert K.capped(df, "s", 5, "x", "doc_id").count() == 15


def tiff(arr: np.ndarray, deflate: bool = False) -> bytes:
    """A little-endian strip TIFF of (height, width) samples with a map grid."""
    data = arr.tobytes()
    body = zlib.compress(data) if deflate else data
    extra = struct.pack("<3d", 10.0, 10.0, 0.0) + struct.pack("<6d", 0, 0, 0, 725000.0, 3130000.0, 0) + struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 32643)
    kind = {"f": 3, "u": 1}[arr.dtype.kind]
    at = 8 + len(body)
    tags = [
        (256, 4, 1, arr.shape[1]),
        (257, 4, 1, arr.shape[0]),
        (258, 3, 1, arr.itemsize * 8),
        (259, 3, 1, 8 if deflate else 1),
        (273, 4, 1, 8),
        (277, 3, 1, 1),
        (278, 4, 1, arr.shape[0]),
        (279, 4, 1, len(body)),
        (339, 3, 1, kind),
        (33550, 12, 3, at),
        (33922, 12, 6, at + 24),
        (34735, 3, 8, at + 72),
    ]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, at + len(extra)) + body + extra + ifd


def test_raster_files(spark, tmp_path):
    a, b = np.arange(12, dtype="<f4").reshape(3, 4) / 7, np.arange(6, dtype="<u2").reshape(2, 3)
    (tmp_path / "a.tif").write_bytes(tiff(a))
    (tmp_path / "b.tif").write_bytes(tiff(b, True))
    (tmp_path / "c.tif").write_bytes(b"II*\0garbage")
    (tmp_path / "d.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 5, 6, 8, 2, 0, 0, 0))
    (tmp_path / "e.txt").write_bytes(b"hello")
    h = {r["path"][-5:]: r for r in SR.inspect(spark, str(tmp_path)).collect()}
    assert (
        h["a.tif"]["width"],
        h["a.tif"]["dtype"],
        h["a.tif"]["crs"],
        list(h["a.tif"]["transform"]),
    ) == (4, "float32", "EPSG:32643", [10.0, 0.0, 725000.0, 0.0, -10.0, 3130000.0])
    assert (h["d.png"]["width"], h["d.png"]["n_bands"]) == (5, 3)
    assert (h["c.tif"]["error_kind"], h["e.txt"]["error_kind"]) == ("corrupted", "unreadable")
    got = {(r["path"][-5:], r["y"], r["x"]): r["value"] for r in BL.read_bands(spark, str(tmp_path), pattern="*.tif").collect()}
    assert len(got) == 18 and got["b.tif", 1, 2] == 5.0 and abs(got["a.tif", 2, 3] - 11 / 7) < 1e-6


def test_manifests_and_archives(spark, tmp_path):
    import io
    import tarfile

    (tmp_path / "m.json").write_text('[{"sample_id": "a", "gt_mask_path": "g.png"}, {"sample_id": "b", "scene_category": "water"}]')
    rows = {
        r["sample_id"]: (r["scene_category"], r["is_quantitative"])
        for r in SD.read_manifest(spark, str(tmp_path / "m.json")).collect()
    }
    assert rows == {"a": ("urban", True), "b": ("water", False)}
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for n in ("x.0.img", "x.json"):
            i = tarfile.TarInfo(n)
            i.size = 2
            t.addfile(i, io.BytesIO(b"hi"))
    (tmp_path / "bad.tar").write_bytes(b"nope")
    got = sorted((r["key"] or "", r["ext"] or "") for r in AR.read_members(spark, str(tmp_path), "*.tar").collect())
    assert got == [("", ""), ("x", "0.img"), ("x", "json")]


def test_registry_and_report(spark):
    r = P.Registry()
    assert r.register("A", lambda d: d) and not r.register("A", lambda d: d.limit(0)) and r.names() == ["A"]
    assert r.run("B", spark.range(2)).select("status").distinct().first()["status"] == "unavailable"
    requests = spark.createDataFrame([(1, "where is it?"), (2, "and that?")], "request long, query string")
    boxes = spark.createDataFrame([(1, 1, 0.9)], "request long, ord int, score double")
    judged = spark.createDataFrame([(1, "consistent", 0.8, "HIGH")], "request long, status string, confidence double, tier string")
    out = {x["request"]: x for x in E.report(requests, E.fused(E.from_boxes(requests, boxes)), judged).collect()}
    assert out[1]["findings"] == ["RS_GROUND box_01: 0.90"] and out[2]["status"] == "insufficient_evidence"
    text = SD.markdown(E.report(requests, E.from_boxes(requests, boxes), judged).where("request = 1")).first()["value"]
    assert text.startswith("# where is it?\n") and "- RS_GROUND box_01: 0.90" in text


def test_request_stream(spark, tmp_path):
    from gridloom.streaming.requests import routed_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"request": 1, "query": "locate the runway", "m1": "optical"}\n')
    s = routed_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("routed").outputMode("append").start()
    s.processAllAvailable()
    s.stop()
    assert [r["task"] for r in spark.sql("select task from routed").collect()] == ["grounding"]


def test_whole_answers_like_brute_force(spark, tmp_path):
    import re

    from gridloom.queries.language import str10

    def matches(pred, truth):
        p, g = pred.strip(" ").lower(), truth.strip(" ").lower()
        bp, bg = (re.sub(r"[^\w\s]", "", x).strip(" ") for x in (p, g))
        tokens, long_in = re.split(r"\s+", bg), lambda n: any(len(w) > n and w in p for w in re.split(r"\s+", bg))
        strict = bp == bg or len(tokens) == 1 and bg in re.split(r"\s+", bp) or bg in bp
        return (strict, strict or long_in(3), g in p or p in g or long_in(4), g in p, g in p or long_in(3))

    def check(d):
        rows = spark.read.parquet(f"{d}/conversations.parquet").collect()
        text = {}
        for r in rows:
            text.setdefault((r["conv_id"], r["turn"]), []).append(r["text"])
        want = [
            (r["conv_id"], r["turn"], *matches(r["text"], t))
            for r in rows if r["role"] == "user"
            for t in text.get((r["conv_id"], r["turn"] + 1), [])
        ]
        got = [tuple(r) for r in str10(spark, d).collect()]
        assert want and sorted(got) == sorted(want)
        return {r[:2]: r[2:] for r in got}

    check("/root/testdata/sf0.01")
    far = "word " * 20 + "harbour"
    rows = [
        (1, 1, "user", far),
        (1, 2, "assistant", "the new one, near the harbour"),
        (2, 1, "user", "漢字"),
        (2, 2, "assistant", "かな"),
        (3, 1, "user", "Größe"),
        (3, 2, "assistant", "größe!"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = check(str(tmp_path))
    # A word after the 40th character counts, and letters outside ASCII are letters.
    assert got[1, 1] == (False, True, True, False, True) and not any(got[2, 1]) and got[3, 1][0]


def test_change_answers_and_target_classes(spark):
    rows = [
        ("", "Increased", "Yes", None, True),
        ("", "no_change", "yes", "no_change", False),
        ("Yes, it did", None, "yes", None, True),
        (None, "no_change", "no", None, True),
        ("none", "lost", "No", None, True),
        (None, None, "no", None, False),
        ("x", "lost", "forest lost", "Lost", True),
        ("forest lost", "modified", "forest lost", "lost", False),
        ("x", None, None, None, False),
        ("x", None, "", "", False),
        ("x", "", "y", "unknown", True),
    ]
    df = spark.createDataFrame(rows, "a string, d string, t string, td string, want boolean")
    assert [
        r
        for r in df.select(
            "*",
            T.change_answer_correct(*[F.col(c) for c in ("a", "d", "t", "td")]).alias("got"),
        ).collect() if r["got"] is not r["want"]
    ] == []
    asked = {
        "Did the Buildings near the lake change?": (["built_structure", "water_body"], "built-up / building"),
        "rebuilt waterfront roads": (["built_structure", "water_body", "road_or_infrastructure"], "road / infrastructure"),
        "the bare-soil area": (["bare_ground_or_soil"], "bare ground / soil"),
        "street": (["vegetation_or_cropland"], None),
        "élake": (["water_body"], None),
        "what is it": ([], None),
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {
        r["q"]: (r["c"], r["f"])
        for r in df.select("q", T.target_classes(F.col("q")).alias("c"), T.target_class(F.col("q")).alias("f")).collect()
    } == asked


def test_suppression_in_rounds_like_the_fold(spark):
    r = np.random.default_rng(8)
    rows = [
        (i % 3, i, float(x), float(y), float(x + 40), float(y + 30), float(s))
        for i, (x, y, s) in enumerate(zip(r.integers(0, 150, 240), r.integers(0, 120, 240), r.integers(0, 9, 240) / 8))
    ]
    df = spark.createDataFrame(rows, "image long, ord long, x0 double, y0 double, x1 double, y1 double, score double")
    for threshold in (0.2, 0.5):
        fold, rounds = (sorted(map(tuple, D.suppress(df, threshold, n).collect())) for n in (1000, 10))
        assert fold == rounds and 3 < len(fold) < 240
    want = []
    for image in range(3):
        kept = []
        for b in sorted((x for x in rows if x[0] == image), key=lambda x: (-x[6], x[1])):
            inter = lambda k: max(0, min(b[4], k[4]) - max(b[2], k[2])) * max(0, min(b[5], k[5]) - max(b[3], k[3]))  # noqa: E731, B023
            if all(inter(k) / (2400 - inter(k)) < 0.5 for k in kept):
                kept.append(b)
        want += kept
    assert fold == sorted(want)


def test_processed_boxes_like_brute_force(spark):
    """CMP8: clamped, small, unsound and degenerate boxes dropped, the rest suppressed."""
    rows = [
        (0, 0, 10.0, 10.0, 60.0, 60.0, 0.9),
        (0, 1, 12.0, 11.0, 61.0, 60.0, 0.8),
        (0, 2, 500.0, 500.0, 700.0, 700.0, 0.7),
        (0, 3, 5.0, 5.0, 6.0, 6.0, 0.9),
        (0, 4, 50.0, 50.0, 10.0, 10.0, 0.9),
        (0, 5, 200.0, 200.0, 260.0, 240.0, 0.1),
    ]
    out = {
        r["ord"]: tuple(r)[2:6]
        for r in D.processed(
            spark.createDataFrame(rows, "image long, ord long, x0 double, y0 double, x1 double, y1 double, score double")
        ).collect()
    }
    assert out == {0: (10.0, 10.0, 60.0, 60.0), 2: (500.0, 500.0, 512.0, 512.0), 5: (200.0, 200.0, 260.0, 240.0)}


def test_leaks_like_contains(spark, monkeypatch):
    """Passages of all lengths, shorter and longer than a gram, some hundred times in a text, cut by slices; repeated rows."""
    rng = np.random.default_rng(7)
    words = ["the", "quick", "brown", "fox", "öß", "東京", "𝄞x", "aab"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(40)]
    texts += ["the quick brown fox", "aabaab" * 50, "", None, "zz the quick", "Größe quick", "Größe quick"]
    passages = ["quick", "aab", "", None, "the quick brown", "öß", "quick", "not there", "aab" * 30, "a", "x" * 400]
    passages += [texts[k][a : a + n] for k, a, n in ((1, 3, 15), (2, 0, 16), (3, 5, 17), (4, 2, 60), (5, 0, 400)) if len(texts[k]) > a]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    frozen = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    want = sorted(((i if i % 9 else -1), k) for i, t in enumerate(texts) for k, p in enumerate(passages) if t is not None and p is not None and p in t)
    for n_bits, slice_, most in ((1 << 20, 1 << 20, 200_000), (64, 7, 0)):
        monkeypatch.setattr(PS, "SLICE", slice_)
        monkeypatch.setattr(PS, "MAX_BROADCAST", most)
        assert sorted((-1 if i is None else i, k) for i, k in PS.leaks(docs, frozen, filter_bits=n_bits).collect()) == want
    assert K.leaks(docs.limit(0), frozen).count() == 0 and K.leaks(docs, frozen.limit(0)).count() == 0


def test_bilinear_resize_by_hand(spark):
    rows = [(0, y, x, float(v)) for y, line in enumerate([[0, 100], [200, 40]]) for x, v in enumerate(line)]
    df = spark.createDataFrame(rows, "scene long, y int, x int, v double")
    out = {(r["y"], r["x"]): r["v"] for r in A.resize_bilinear(df, (2, 2), (2, 4)).collect()}
    # Centres at 0.25, 0.75, 1.25 and 1.75 source columns: 0, a quarter, three quarters, 1 of the way.
    assert [out[0, x] for x in range(4)] == [0, 25, 75, 100] and [out[1, x] for x in range(4)] == [200, 160, 80, 40]
    small = A.resize_bilinear(df, (2, 2), (1, 1)).first()["v"]
    assert small == 85
    assert sorted((r["y"], r["x"], r["v"]) for r in A.resize_bilinear(df, (2, 2), (2, 2)).collect()) == [(y, x, v) for _, y, x, v in rows]


def test_tiles_end_at_the_edge():
    assert A.tile_starts(50, 20) == [0, 20, 30] and A.tile_starts(16, 20) == [0] and A.tile_starts(40, 20) == [0, 20]


def test_fixture_scenes(spark):
    from gridloom.operators import benchmark as BE
    from gridloom.operators import fusion as U
    from gridloom.sources import fixtures as X

    audit = {r["scene"]: r for r in BE.format_audit(X.pairs(spark), X.expected(spark), X.SIDE, X.SIDE).collect()}
    assert len(audit) == len(X.PAIRS) and audit["00_core"]["changed"] == 6400 and audit["11_flood"]["changed"] == 128 * 128
    assert audit["06_no_change"]["changed"] == 0 and audit["09_misalignment"]["correct"]
    wrong = {s for s, r in audit.items() if not r["correct"]}
    assert wrong <= {"07_seasonal", "08_compression"}  # CVA takes a shift of all colours for change
    core = X.pairs(spark).where("scene = '00_core'")
    o = CH.detect(core, X.SIDE, X.SIDE)
    region = CH.regions(CH.components(o["mask"], X.SIDE), o["difference"]).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["pixels"]) for r in region] == [(90, 90, 170, 170, 6400)]
    regions = {
        (r["scene"], r["class"]): r
        for r in U.class_regions(U.classes(X.optical_sar(spark), X.SIDE, X.SIDE), X.SIDE, X.SIDE).collect()
    }
    built = regions["built", "built_structure"]
    assert (built["x0"], built["y0"], built["x1"], built["y1"], built["pixels"], built["confidence"]) == (60, 60, 180, 180, 14400, 0.88)
    assert ("smooth", "road_or_infrastructure") in regions and ("water", "water_body") in regions and ("vegetation", "vegetation_or_cropland") in regions


def test_requests_are_executed(spark):
    from gridloom.plans import executor as X
    from gridloom.sources import fixtures as F14

    asked = [
        (1, "How much total area changed?", "optical", "optical", None, "00_core"),
        (2, "Is there any change?", "optical", "optical", None, "06_no_change"),
        (3, "Did the buildings increase over time?", "optical", "optical", None, "11_flood"),
        (4, "dual-sensor view", "optical", "sar", None, "built"),
        (5, "Where is the water body?", "optical", None, None, "00_core"),
        (6, "What changed between these two dates?", "optical", None, None, "00_core"),
        (7, "Is there any change?", "optical", "optical", None, "nowhere"),
    ]
    q = spark.createDataFrame(asked, "request long, query string, m1 string, m2 string, hint string, scene string")
    o = X.execute(q, F14.pairs(spark), F14.optical_sar(spark), F14.SIDE, F14.SIDE)
    states = {(r["request"], r["specialist"]): r["state"] for r in o["stages"].collect()}
    assert states == {
        (1, "CHANGE_DETECT"): "ok",
        (2, "CHANGE_DETECT"): "ok",
        (3, "CHANGE_DETECT"): "ok",
        (3, "CHANGE_VQA"): "unavailable",
        (4, "OPTICAL_SAR_FUSION"): "ok",
        (5, "RS_GROUND"): "unavailable",
        (6, ""): "rejected",
        (7, "CHANGE_DETECT"): "no_input",
    }
    values = {(r["request"], r["type"], r["region"]): r["value"] for r in o["items"].collect()}
    assert values[1, "statistic", None] == 6400.0 and values[1, "region", "changed_region_01"] == 6400.0 and values[2, "statistic", None] == 0.0
    assert (4, "class", "built_structure") in values and not any(r in (5, 6, 7) for r, *_ in values)
    judged = {r["request"]: r for r in o["judged"].collect()}
    assert set(judged) == {1, 2, 3, 4} and judged[2]["confidence"] > judged[1]["confidence"] and judged[1]["tier"] == "HIGH"
    report = {r["request"]: r for r in o["report"].collect()}
    assert len(report) == len(asked) and report[6]["status"] == "insufficient_evidence" and report[1]["status"] == "consistent"
    trace = {}
    for r in X.trace(o["stages"]).orderBy("request", "step").collect():
        trace.setdefault(r["request"], []).append((r["name"], r["state"]))
    assert all(s == "ok" for _, s in trace[1]) and [n for n, _ in trace[1]] == P.STEPS["change_detection"]
    assert trace[6][2] == ("route", "ok") and trace[6][-1][1] == "rejected" and trace[5][-1][1] == "unavailable"


def test_semantic_answers_are_validated(spark):
    rows = [
        ("increased", 900, "bare", "water", 0.9),
        ("no_change", 900, "bare", "water", 0.9),
        ("odd", 0, "lava", "water", 0.9),
        (None, 0, "water", "water", 0.5),
    ]
    df = spark.createDataFrame(rows, "d string, px long, f string, t string, c double")
    out = [
        tuple(r["v"])
        for r in df.select(
            T.semantic_validation(F.col("d"), F.col("px"), F.col("f"), F.col("t"), F.col("c"), ["bare", "water"]).alias("v")
        ).collect()
    ]
    assert out == [
        ("increased", False, 0.9, 0.1),
        ("modified", False, 0.9, 0.1),
        ("modified", True, 0.6, 0.4),
        ("modified", True, 0.5, 0.5),
    ]


def test_a_cluster_needs_a_shared_folder(spark):
    from gridloom import store

    class Conf:
        def __init__(self, **kv):
            self.kv = kv

        def get(self, key, default=None):
            return self.kv.get(key.rsplit(".", 2)[-2] if key.startswith("spark.checkpoint") else "master", default)

    class Session:
        def __init__(self, **kv):
            self.conf = Conf(**kv)

    assert store.shared_dir(Session(checkpoint="hdfs://x/y/", master="yarn")) == "hdfs://x/y"
    assert store.shared_dir(Session(master="local[8]")) == store.LOCAL_DIR
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]"):
        try:
            store.shared_dir(Session(master=master))
        except RuntimeError:
            continue
        raise AssertionError(master)


def test_exact_percentiles_like_numpy(spark):
    from gridloom.operators.percentiles import exact_percentiles

    r = np.random.default_rng(4)
    groups = {
        0: r.standard_normal(501),
        1: np.full(40, 3.0),
        2: np.concatenate([np.full(300, 1.0), [1e9, -1e9, 1.0000001]]),
        3: np.array([7.0]),
        4: r.integers(0, 5, 1000).astype(float),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(3)
    for bins in (1024, 4):
        out = {x["k"]: x["q"] for x in exact_percentiles(df, ["k"], "v", [0.02, 0.5, 0.98], bins).collect()}
        for k, vs in groups.items():
            assert np.allclose(out[k], np.percentile(vs, [2, 50, 98]), rtol=1e-12, atol=1e-12), (k, bins)
    assert exact_percentiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def png(a, bits, colour, filters, palette=None):
    """A PNG file of an array (height, width, samples), each line filtered by one of `filters` in turn."""
    h, w, n = a.shape
    raw = a.astype(">u2" if bits == 16 else np.uint8).tobytes()
    step, size = n * bits // 8, w * n * bits // 8
    lines, up = [], bytes(size)
    for y in range(h):
        line, how = raw[y * size : (y + 1) * size], filters[y % len(filters)]
        out = bytearray()
        for i, v in enumerate(line):
            left, above, corner = (line[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = left + above - corner
            paeth = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
            out.append((v - (0, left, above, (left + above) // 2, paeth)[how]) & 255)
        lines.append(bytes([how]) + bytes(out))
        up = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + (
        chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    )
    return b"\x89PNG\r\n\x1a\n" + body + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def lzw(data):
    """TIFF's LZW, written plainly."""
    out, table, width, last = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    for v in data:
        now = last + bytes([v])
        if now in table:
            last = now
            continue
        out.append((table[last], width))
        table[now] = len(table) + 2
        last = bytes([v])
        size = len(table) + 2
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            out.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
    out += [(table[last], width)] if last else []
    size = len(table) + 3
    out.append((257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12))
    bits = "".join(format(c, f"0{w}b") for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def tiff_parts(a, part, packed, predictor, planar, tiled):
    """A little-endian TIFF of an array (bands, height, width) of uint16 in strips of `part` lines or tiles of part x part."""
    n, h, w = a.shape
    pack = {1: bytes, 5: lzw, 8: zlib.compress}[packed]
    pw, ph = (part, part) if tiled else (w, part)
    parts = []
    for plane in [a[k : k + 1] for k in range(n)] if planar == 2 else [a]:
        for y in range(0, h, ph):
            for x in range(0, w, pw):
                p = plane[:, y : y + ph, x : x + pw]
                if tiled:
                    p = np.pad(p, ((0, 0), (0, ph - p.shape[1]), (0, pw - p.shape[2])))
                p = np.moveaxis(p, 0, 2).astype("<u2")
                if predictor == 2:
                    p = np.diff(p, axis=1, prepend=p[:, :1] * 0).astype("<u2")
                parts.append(pack(np.ascontiguousarray(p).tobytes()))
    starts, at = [], 8
    for p in parts:
        starts.append(at)
        at += len(p)
    fields = [
        (256, 4, [w]),
        (257, 4, [h]),
        (258, 3, [16] * n),
        (259, 3, [packed]),
        (277, 3, [n]),
        (284, 3, [planar]),
        (317, 3, [predictor]),
        (339, 3, [1] * n),
        (33550, 12, [10.0, 10.0, 0.0]),
        (33922, 12, [0.0, 0.0, 0.0, 500.0, 900.0, 0.0]),
    ]
    fields += [
        (322, 4, [pw]),
        (323, 4, [ph]),
        (324, 4, starts),
        (325, 4, [len(p) for p in parts]),
    ] if tiled else [(273, 4, starts), (278, 4, [ph]), (279, 4, [len(p) for p in parts])]
    extra, entries = b"", []
    base = at + 2 + 12 * len(fields) + 4
    for tag, kind, v in sorted(fields):
        raw = struct.pack("<" + f"{len(v)}" + {3: "H", 4: "I", 12: "d"}[kind], *v)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, kind, len(v), base + len(extra)))
            extra += raw
        else:
            entries.append(struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<I", at) + b"".join(parts) + struct.pack("<H", len(fields)) + b"".join(entries) + b"\0" * 4 + extra


def test_png_samples(spark, tmp_path):
    r = np.random.default_rng(1)
    grey, rgb, deep, index = r.integers(0, 256, (7, 9, 1)), r.integers(0, 256, (7, 9, 3)), r.integers(0, 65536, (5, 4, 2)), r.integers(0, 4, (6, 5, 1))
    colours = r.integers(0, 256, (4, 3))
    for a, bits, colour, palette in ((grey, 8, 0, None), (rgb, 8, 2, None), (deep, 16, 4, None), (index, 8, 3, colours)):
        want = np.moveaxis(colours[a[..., 0]] if palette is not None else a, 2, 0)
        for filters in ([0], [1], [2], [3], [4], [4, 0, 3, 1, 2]):
            assert np.array_equal(SR.array_of(png(a, bits, colour, filters, palette)), want), (bits, colour, filters)
    (tmp_path / "a.png").write_bytes(png(rgb, 8, 2, [4, 1]))
    (tmp_path / "b.png").write_bytes(png(rgb, 8, 2, [0])[:60])
    rows = BL.read_bands(spark, str(tmp_path), [2]).collect()
    assert {(x["y"], x["x"]): x["value"] for x in rows} == {(y, x): float(rgb[y, x, 1]) for y in range(7) for x in range(9)}


def test_tiff_tiles_lzw_and_differences(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 300, (3, 21, 37)).astype(np.uint16)
    a[:, 5:9] = 7
    for packed in (1, 5, 8):
        for predictor in (1, 2):
            for planar in (1, 2):
                for tiled, part in ((False, 4), (False, 21), (True, 16)):
                    assert np.array_equal(
                        SR.array_of(tiff_parts(a, part, packed, predictor, planar, tiled)),
                        a,
                    ), (packed, predictor, planar, tiled)
    big = np.random.default_rng(3).integers(0, 2**16, (1, 60, 90)).astype(np.uint16)
    assert np.array_equal(SR.array_of(tiff_parts(big, 60, 5, 1, 1, False)), big)
    (tmp_path / "a.tif").write_bytes(tiff_parts(a, 16, 5, 2, 1, True))
    h = SR.inspect(spark, str(tmp_path)).first()
    assert h["bounds"] == [500.0, 690.0, 870.0, 900.0] and h["resolution"] == [10.0, 10.0] and h["error_kind"] is None


def test_settings(spark, tmp_path, monkeypatch):
    from gridloom.session import Settings

    (tmp_path / "env").write_text("# a comment\nGRIDLOOM_TILE='256'\nGRIDLOOM_LEAST_REGION=4\n")
    monkeypatch.setenv("GRIDLOOM_LEAST_REGION", "8")
    spark.conf.set("gridloom.iou_threshold", "0.5")
    try:
        assert Settings.of(spark, str(tmp_path / "env")) == Settings(tile=256, least_region=8, iou_threshold=0.5)
    finally:
        spark.conf.unset("gridloom.iou_threshold")
    assert Settings.of(spark) == Settings(least_region=8)


def test_shared_models():
    from gridloom.plans import runtime as RT

    loaded = []
    load = lambda: loaded.append(1) or {"n": 1}
    with RT.shared("m", load) as a, RT.shared("m", load) as b:
        assert a is b and RT.users("m") == 2
        RT.release()
    with RT.shared("m", load) as c:
        assert c is a and len(loaded) == 1
    RT.release("m")
    with RT.shared("m", load, keep=False):
        pass
    assert len(loaded) == 2 and RT.users("m") == 0
    with RT.shared("m", load):
        assert len(loaded) == 3
    RT.release()


def test_validation_results(spark):
    df = spark.createDataFrame([(["a"], ["w"]), ([], ["w"]), ([], [])], "e array<string>, w array<string>")
    assert [
        (r["v"]["ok"], r["v"]["status"])
        for r in df.select(R.validation_result(F.col("e"), F.col("w")).alias("v")).collect()
    ] == [(False, "invalid"), (True, "valid_with_warnings"), (True, "valid")]


def test_specialists(spark):
    from gridloom.plans import specialist as SP
    from gridloom.sources import fixtures as X

    r = P.Registry()
    one = SP.ChangeDetector(X.SIDE, X.SIDE)
    assert r.register(one.capability.name, one) and not one.is_loaded and r.health() == {"CHANGE_DETECT": True}
    out = r.run("CHANGE_DETECT", X.pairs(spark).where("scene = '00_core'")).first()
    assert one.is_loaded and (out["changed"], out["status"]) == (6400, "ok")
    one.cleanup()
    assert not one.is_loaded and not r.register("CHANGE_DETECT", SP.SensorFusion(8, 8)) and r.names() == ["CHANGE_DETECT"]
    fused = SP.SensorFusion(X.SIDE, X.SIDE)(X.optical_sar(spark).where("scene = 'built'")).collect()
    assert {x["class"]: x["pixels"] for x in fused}["built_structure"] == 14400 and abs(sum(x["pct"] for x in fused) - 100) < 0.05


def test_fallback_and_stillness(spark):
    rows = lambda scene, n: [(scene, i // 8, i % 8) for i in range(n)]
    frame = lambda rs: spark.createDataFrame(rs, "scene long, y int, x int")
    neural, cva = frame(rows(0, 20) + rows(1, 3) + rows(2, 3) + rows(3, 0)), frame(rows(0, 30) + rows(1, 30) + rows(2, 10) + rows(3, 30))
    pair = spark.createDataFrame(
        [(s, i // 8, i % 8, [0.0], [1.0 if i < n else 0.0]) for s, n in enumerate((40, 40, 40, 10)) for i in range(64)],
        "scene long, y int, x int, a array<double>, b array<double>",
    )
    out = CH.with_fallback(neural, cva, pair).groupBy("scene", "source").count().collect()
    assert sorted(map(tuple, out)) == [(0, "neural", 20), (1, "cva", 30), (2, "neural", 3)]
    still = spark.createDataFrame(
        [(0, 0), (5, 0), (5, 1), (None, None)],
        "c long, r long",
    ).select(CH.is_still(F.col("c"), F.col("r")).alias("s"))
    assert [x["s"] for x in still.collect()] == [True, True, False, True]


def test_pair_scores(spark):
    """WIN6: half overlap, half phase where the overlap is known; the score's grades."""
    shift = spark.createDataFrame([(i, 0, 0, 0.0, 0.0, 0.0, 0.0, s) for i, s in enumerate((0.9, 0.9, 0.01, 0.4))], A.SHIFT)
    share = spark.createDataFrame([(0, 1.0), (2, 0.05), (3, 1.0)], "scene long, share double")
    assert [
        (r["scene"], r["score"], r["grade"])
        for r in A.pair_score(shift, share).orderBy("scene").collect()
    ] == [(0, 0.95, "excellent"), (1, 0.9, "excellent"), (2, 0.1, "poor"), (3, 0.7, "good")]


def test_items_of_one_id_and_different_requests_all_stay(spark):
    """Ids have 32 bits: these two requests' first boxes share one. A repeated item goes, an item without a value stays."""
    boxes = spark.createDataFrame([(100159, 1, 0.5), (115470, 1, 0.25), (115470, 1, 0.25), (7, 2, None)], "request long, ord int, score double")
    items = E.fused(E.from_boxes(boxes.select("request").limit(0), boxes))
    rows = sorted((r["request"], r["item_id"], r["region"], r["value"]) for r in items.collect())
    assert [(r[0], r[2], r[3]) for r in rows] == [(7, "box_02", None), (100159, "box_01", 0.5), (115470, "box_01", 0.25)]
    assert rows[1][1] == rows[2][1] == "ev_70349383"
    assert {r["request"]: r["boxes"] for r in E.metrics(items).collect()} == {7: 1, 100159: 1, 115470: 1}


def test_components_send_no_table_to_the_driver(spark, monkeypatch):
    """Runs and labels are joined by shuffles, however few they are."""
    plans = []
    write = CH._written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(CH, "_written", written)
    mask = spark.createDataFrame([(s, y, x) for s in (1, 2) for y in range(6) for x in range(6) if (x + y) % 3], "scene long, y int, x int")
    out = CH.components(mask, 6)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 5 and not [p for p in plans if "BroadcastExchange" in p]
    assert out.groupBy("scene").agg(F.max("label").alias("m")).where("m = 4").count() == 2
