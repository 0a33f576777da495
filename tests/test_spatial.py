"""Rectangles that meet against all pairs; thresholds in one pass against loops; validation of pairs; ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import scoring as S
from gridloom.operators import spatial as SP
from gridloom.operators import validation as VA


def rectangles(seed, n, scale, hot=0, over_all=True):
    r = np.random.default_rng(seed)
    at, size = np.round(r.random((n, 2)) * 1000), np.round(r.random((n, 2)) * scale)
    rows = [(i, *map(float, (*a, *(a + s)))) for i, (a, s) in enumerate(zip(at, size))]
    rows += [(n + i, 500.0, 500.0, 501.0, 501.0) for i in range(hot)]
    k = n + hot
    rows += [(k, 0.0, 0.0, 1000.0, 1000.0), (k + 1, -50.0, 300.0, 1050.0, 302.0), (k + 2, 7.0, -90.0, 7.0, 2000.0)] if over_all else []
    return rows + [(k + 3, None, 1.0, 2.0, 3.0), (k + 4, 5.0, 5.0, 4.0, 9.0)]


def all_pairs(a, b, touching):
    out = []
    for i, *r in a:
        for j, *q in b:
            if None in r or None in q or r[0] > r[2] or q[0] > q[2]:
                continue
            w, h = min(r[2], q[2]) - max(r[0], q[0]), min(r[3], q[3]) - max(r[1], q[1])
            if (w >= 0 and h >= 0) if touching else (w > 0 and h > 0):
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("touching", [False, True])
@pytest.mark.parametrize("sides", [((1, 300, 30, 120), (2, 250, 60, 100)), ((3, 10, 30), (4, 5, 60)), ((5, 200, 0, 0, False), (6, 200, 0, 90, False)), ((7, 0, 1), (8, 0, 1)), ((9, 300, 900), (10, 60, 5))])
def test_rectangles_that_meet(spark, sides, touching, monkeypatch):
    """With one over everything, long thin ones, many at one place, points and lines, edges on the cells' edges, nulls."""
    monkeypatch.setattr(SP, "NODE_ROWS", 20)
    a, b = (rectangles(*s) for s in sides)
    table = lambda r: spark.createDataFrame([(*x, "z") for x in r], "id long, x0 double, y0 double, x1 double, y1 double, node string")
    got = SP.meeting(table(a), table(b), touching=touching)
    assert sorted(map(tuple, got.select("id_1", "id_2").collect())) == all_pairs(a, b, touching)
    assert {"node_1", "node_2", "x0_1", "y1_2"} <= set(got.columns)


def test_a_large_rectangle_has_few_rows_and_a_hot_cell_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(SP, "NODE_ROWS", 20)
    rows = rectangles(1, 2000, 3, 400)
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").where("x0 <= x1")
    tree = SP.grown(df)
    assert len(tree.cover(0.0, 0.0, 1000.0, 1000.0)) <= 80
    assert max(len(tree.cover(*r[1:])) for r in rows if r[0] < 2000) <= 100
    assert max(tree.salts.values()) >= 400 // 20
    # The nodes of a rectangle lie apart and hold it.
    for box in ((3.0, 4.0, 700.0, 650.0), (499.0, 499.0, 502.0, 502.0)):
        cells = [tree.cell(n) for n in tree.cover(*box)]
        area = sum(max(0, min(x + s, box[2]) - max(x, box[0])) * max(0, min(y + s, box[3]) - max(y, box[1])) for x, y, s in cells)
        assert abs(area - (box[2] - box[0]) * (box[3] - box[1])) < 1e-6


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, x0 double, y0 double, x1 double, y1 double")
    some = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], none.schema)
    for a, b in ((none, some), (some, none), (none, none)):
        assert SP.meeting(a, b).collect() == []


@pytest.mark.parametrize("touching", [False, True])
def test_copies_of_a_rectangle_meet_once_and_all_count(spark, monkeypatch, touching):
    """400 and 300 rows of three rectangles a side: what the tree pairs has a row a pair of rectangles."""
    monkeypatch.setattr(SP, "BLOCK_ROWS", 50)
    some = lambda n, w: [(i, *map(float, (i % 3 * 10, 0, i % 3 * 10 + w, 5))) for i in range(n)] + [(n, None, 1.0, 2.0, 3.0)]
    a, b = some(400, 10), some(300, 4)
    one, two = (spark.createDataFrame(r, "id long, x0 double, y0 double, x1 double, y1 double") for r in (a, b))
    (each_1, rows_1), (each_2, _) = SP.classes(one), SP.classes(two)
    assert (each_1.count(), each_2.count(), rows_1.count()) == (3, 3, 400)
    assert rows_1.groupBy("rectangle", "block").count().agg(F.max("count")).first()[0] < 100
    want = all_pairs(a, b, touching)
    assert SP.rectangles_meeting(each_1, each_2, touching=touching).count() == (5 if touching else 3)
    assert sorted(map(tuple, SP.meeting(one, two, touching=touching).select("id_1", "id_2").collect())) == want
    hits = {r["id"]: r["hits"] for r in SP.counted(one, two, touching=touching).collect()}
    assert hits == {j: sum(k == j for _, k in want) for j in {k for _, k in want}}


@pytest.mark.parametrize("touching", [False, True])
def test_rectangles_beyond_the_sampled_ground_meet(spark, monkeypatch, touching):
    """The tree knows 40 of 400 and more: some lie before its ground, some beyond, some without an end."""
    monkeypatch.setattr(SP, "NODE_ROWS", 10)
    monkeypatch.setattr(SP, "SAMPLE", 40)
    ends = [(-np.inf, -np.inf, np.inf, np.inf), (3.5, -np.inf, 9.5, np.inf), (-np.inf, 1e300, -1e300, np.inf)]
    far = [(x + i / 3, y, x + i / 3 + 1.1, y + 2.0) for x in (-7000.1, 400.2, 9000.3) for y in (-8000.0, 500.0, 9500.7) for i in range(4)]
    a, b = ([r for r in rectangles(seed, 400, 40) if None not in r] for seed in (11, 12))
    a, b = ([*r, *((1000 + i, *map(float, box)) for i, box in enumerate(far + ends))] for r in (a, b))
    one, two = (spark.createDataFrame(r, "id long, x0 double, y0 double, x1 double, y1 double") for r in (a, b))
    assert sorted(map(tuple, SP.meeting(one, two, touching=touching).select("id_1", "id_2").collect())) == all_pairs(a, b, touching)
    hits = {r["id"]: r["hits"] for r in SP.counted(one, two, touching=touching).collect()}
    assert sum(hits.values()) == len(all_pairs(a, b, touching))


def test_every_place_is_in_one_cell_of_a_level():
    """On grounds whose halves aren't exact, a value between two cells' ends would belong to neither."""
    r = np.random.default_rng(3)
    for _ in range(20):
        boxes = np.sort(r.random((300, 2, 2)) * r.random() * 10 + r.random(), axis=1).reshape(-1, 4)
        tree = SP._grown(boxes)
        for box, at in zip(boxes[:40], tree.places(boxes[:40]).tolist()):
            squares = [tree.square(n) for n in tree.cover(*box)]
            for x, y in ((at[0], at[1]), (at[2], at[3]), (at[0], at[3])):
                assert sum(a <= x < a + s and b <= y < b + s for a, b, s in squares) == 1


def test_whole_numbers_that_doubles_do_not_tell_apart(spark):
    big = 2**53
    one = spark.createDataFrame([(1, big, 0, big + 1, 5)], "id long, x0 long, y0 long, x1 long, y1 long")
    two = spark.createDataFrame([(7, big, 0, big + 1, 5), (8, big + 1, 0, big + 2, 5)], one.schema)
    assert [tuple(r) for r in SP.meeting(one, two).select("id_1", "id_2").collect()] == [(1, 7)]
    assert sorted(r["id"] for r in SP.counted(one, two, touching=True).collect()) == [7, 8]


def test_copies_are_unfolded_after_the_last_shuffle(spark, monkeypatch):
    """Pairs of rows take part in no join; facts are of the pairs of rectangles."""
    monkeypatch.setattr(SP, "BLOCK_ROWS", 50)
    monkeypatch.setattr(SP, "TASK_PAIRS", 10_000)
    rows = lambda n, w: [(i, f"n{i}" if i % 5 else None, *map(float, (i % 3 * 10, 0, i % 3 * 10 + w, 5))) for i in range(n)]
    a, b = rows(400, 13), rows(300, 4)
    one, two = (spark.createDataFrame(r, "id long, name string, x0 double, y0 double, x1 double, y1 double") for r in (a, b))
    every = SP.meeting(one, two)
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(rows_2") < plan.index("Generate explode(rows_1") < plan.index("Repartition") < plan.index("Join")
    assert every.columns == [f"{c}_{k}" for k in (1, 2) for c in one.columns]
    some = SP.meeting(one, two, keep=(["id"], ["id", "name"]), facts={"width": F.least("x1_1", "x1_2") - F.greatest("x0_1", "x0_2")})
    assert some.columns == ["id_1", "id_2", "name_2", "width"] and some.rdd.getNumPartitions() == 1 + 65_000 // 10_000
    width = lambda i, j: min(a[i][4], b[j][4]) - max(a[i][2], b[j][2])
    want = [(i, j, b[j][1], width(i, j)) for i in range(400) for j in range(300) if width(i, j) > 0]
    key = lambda r: r[:2]
    assert sorted(map(tuple, some.collect()), key=key) == want
    assert sorted(((r["id_1"], r["id_2"], r["name_2"], r["name_1"]) for r in every.collect()), key=key) == [(i, j, n, a[i][1]) for i, j, n, _ in want]


def test_sweep_equals_loops(spark):
    r = np.random.default_rng(1)
    rows = [(c, bool(t), float(s)) for c in "ab" for t, s in zip(r.random(300) < 0.3, np.round(r.random(300), 2))] + [("a", None, 0.5), ("b", True, None), ("c", False, 1.0)]
    df = spark.createDataFrame(rows, "candidate string, truth boolean, score double")
    got = {(x["candidate"], x["bin"]): x for x in S.sweep(df, bins=16).collect()}
    assert len(got) == 48
    for (c, k), x in got.items():
        mine = [(t, min(int(s * 16), 15) >= k) for n, t, s in rows if n == c and t is not None and s is not None]
        tp, fp = sum(t and y for t, y in mine), sum(not t and y for t, y in mine)
        fn, tn = sum(t and not y for t, y in mine), sum(not t and not y for t, y in mine)
        assert (x["tp"], x["fp"], x["fn"], x["tn"]) == (tp, fp, fn, tn)
        assert x["f1"] == round(2 * tp / (2 * tp + fp + fn), 6) if tp + fp + fn else x["f1"] == 0
    best = {x["candidate"]: x for x in S.best_of(S.sweep(df, bins=16)).collect()}
    assert all(best[c]["f1"] == max(x["f1"] for (n, _), x in got.items() if n == c) for c in "abc")
    assert max(x["d_f1"] for x in best.values()) == 0 and best["c"]["d_f1"] < 0


GOOD = {"found": True, "filename": "a.tif", "error_kind": None, "width": 100, "height": 80, "n_bands": 3, "crs": "EPSG:32643", "transform": [10.0, 0.0, 0.0, 0.0, -10.0, 800.0], "bounds": [0.0, 0.0, 1000.0, 800.0], "resolution": [10.0, 10.0], "modality": "optical", "date": None}


def validated(spark, f, changes, score=0.5):
    rows = [({**GOOD, **a}, {**GOOD, **b}, score) for a, b in changes]
    df = spark.createDataFrame(rows, f"a {VA.SIDE}, b {VA.SIDE}, score double")
    return [r["v"] for r in df.select(f.alias("v")).collect()]


def test_each_error_of_a_pair_has_its_case(spark):
    f = VA.bitemporal(F.col("a"), F.col("b"), F.col("score"))
    far = {"bounds": [5000.0, 0.0, 6000.0, 800.0]}
    cases = [
        ({"found": False}, {}, "first_not_found"), ({}, {"found": None}, "second_not_found"), ({"error_kind": "corrupted"}, {}, "first_unreadable"), ({}, {"error_kind": "x"}, "second_unreadable"),
        ({"transform": None}, {}, "first_without_transform"), ({}, {"transform": None}, "second_without_transform"), ({"width": 0}, {}, "no_size"), ({"crs": None, "width": 0}, {}, "no_size"),
        ({"crs": "None", "height": 15}, {}, "too_small"), ({}, {"crs": "EPSG:4326"}, "other_crs"), ({}, far, "disjoint"), ({}, {"bounds": [600.0, 0.0, 1600.0, 800.0]}, "low_overlap"), ({}, {}, None),
    ]
    got = validated(spark, f, [c[:2] for c in cases])
    assert [v["error"] and v["error"]["code"] for v in got] == [c[2] for c in cases]
    assert all(v["warnings"] == [] for v in got if v["error"]) and all(v["error"]["text"] for v in got if v["error"])
    assert validated(spark, f, [({"crs": ""}, {})], 0.1)[0]["error"]["code"] == "unrelated"
    assert validated(spark, f, [({"crs": ""}, {})], None)[0]["valid"]


def test_each_warning_of_a_pair_has_its_case(spark):
    import datetime

    f = VA.bitemporal(F.col("a"), F.col("b"), F.col("score"))
    d = [datetime.datetime(2020, 1, k) for k in (1, 2)]
    dated = ({"date": d[0]}, {"date": d[1]})
    cases = [
        ({**dated[0]}, {**dated[1]}, []), ({}, {}, ["missing_dates"]), ({}, dated[1], ["first_date_missing"]), (dated[0], {}, ["second_date_missing"]), ({"date": d[1]}, {"date": d[1]}, ["reversed_dates"]),
        (dated[0], {**dated[1], "modality": "sar"}, ["other_modality"]), (dated[0], {**dated[1], "n_bands": 4}, ["bands_differ"]), (dated[0], {**dated[1], "resolution": [12.0, 12.0]}, ["resolution_differs"]),
        (dated[0], {**dated[1], "bounds": [100.0, 0.0, 1100.0, 800.0]}, ["partial_overlap"]), ({**dated[0], "crs": None}, {**dated[1], "width": 120}, ["pixels_only", "size_differs", "alignment"]),
    ]
    got = validated(spark, f, [c[:2] for c in cases])
    assert [[w["code"] for w in v["warnings"]] for v in got] == [c[2] for c in cases] and all(v["valid"] for v in got)
    assert [v["mode"] for v in got][-2:] == ["map", "pixels"] and [v["overlap"] for v in got][-2:] == [0.9, 0.5]
    assert [v["ordered"] for v in got][:5] == [True, False, False, False, False]


def test_optical_and_radar_pairs(spark):
    f = VA.cross_modal(F.col("a"), F.col("b"))
    sar = {"modality": "sar"}
    cases = [
        ({"found": False}, sar, "first_not_found"), ({}, {**sar, "error_kind": "x"}, "second_unreadable"), ({"crs": None}, sar, "first_without_crs"), ({}, {**sar, "crs": "null"}, "second_without_crs"),
        ({}, {**sar, "height": 0}, "no_size"), ({"transform": None}, sar, "without_transform"), ({}, {"modality": "multispectral"}, "both_optical"), (sar, sar, "both_sar"), ({"modality": "thermal"}, sar, "unsupported_pair"),
        ({"modality": None}, sar, "unsupported_pair"), ({}, {**sar, "crs": "EPSG:4326"}, "other_crs"), ({}, {**sar, "bounds": [1000.0, 0.0, 2000.0, 800.0]}, "disjoint"), ({}, {**sar, "bounds": [900.0, 0.0, 1900.0, 800.0]}, "low_overlap"),
        ({}, sar, None), (sar, {"modality": "multispectral", "bounds": [100.0, 0.0, 1100.0, 800.0]}, None),
    ]
    got = validated(spark, f, [c[:2] for c in cases])
    assert [v["error"] and v["error"]["code"] for v in got] == [c[2] for c in cases]
    assert [w["code"] for w in got[-1]["warnings"]] == ["swapped", "partial_overlap"] and got[-1]["swapped"] and not got[-2]["swapped"]
