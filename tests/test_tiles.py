"""Tiles: filters against their pixel forms and plain numpy, components against flood fill, warps and spectra against loops."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import views as V
from gridloom.operators import alignment as A
from gridloom.operators import change as CH
from gridloom.operators import spectrum as SP
from gridloom.operators import tile_filters as TF
from gridloom.operators import tile_labels as TL
from gridloom.operators import tiles as T
from gridloom.operators import warp as WP
from gridloom.operators.ranks import ranked
from gridloom.store import written

SF = "/root/testdata/sf0.001"
H, W = 50, 16


def rows(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def scenes(spark, arrays, names, side, kind="<f8"):
    """A written tile table of (layers, lines, columns) arrays of one size."""
    px = [(s, y, x, *map(float, a[:, y, x])) for s, a in enumerate(arrays) for y in range(a.shape[1]) for x in range(a.shape[2])]
    df = spark.createDataFrame(px, "scene long, y int, x int, " + ", ".join(f"{n} double" for n in names))
    return written(T.from_pixels(df, names, *arrays[0].shape[1:], side=side, kind=kind), "tiles")


def back(tiles, layers=1):
    """{scene: array} of a tile table."""
    out = {}
    for r in tiles.collect():
        a = out.setdefault(r["scene"], np.zeros((layers, r["height"], r["width"])))
        y, x = r["ty"] * r["side"], r["tx"] * r["side"]
        part = np.frombuffer(r["data"], r["kind"]).reshape(layers, min(r["side"], r["height"] - y), -1)
        a[:, y : y + part.shape[1], x : x + part.shape[2]] = part
    return out


@pytest.mark.parametrize("side", [5, 16, 64])
def test_filters_equal_their_pixel_forms(spark, side):
    os_ = V.optical_sar(spark, SF)
    rough = TF.roughness(T.partitioned(T.from_pixels(os_, ["sar"], H, W, side=side)))
    assert rows(T.to_pixels(rough, ["rough"]), "scene", "y", "x", "rough") == rows(CH.roughness(os_, H, W), "scene", "y", "x", "rough")
    rng = np.random.default_rng(side)
    mask = rng.random((1, 40, 33)) < 0.8
    tiles = scenes(spark, [mask], ["m"], side, "|u1")
    px = T.to_pixels(tiles, ["m"], only="m")
    got = T.to_pixels(TF.opened_closed(T.partitioned(tiles)), ["m"], only="m")
    assert rows(got, "scene", "y", "x") == rows(CH.opened_closed(px, 40, 33), "scene", "y", "x")


def test_change_detection_equals_its_pixel_form(spark):
    pair = V.changed_pair(spark, SF)
    names = [f"{c}{i}" for c in "ab" for i in range(4)]
    px = pair.select("scene", "y", "x", *[F.get(c, F.lit(i)).alias(f"{c}{i}") for c in "ab" for i in range(4)])
    got, want = TF.detect(written(T.from_pixels(px, names, H, W, side=7), "pairs")), CH.detect(pair, H, W)
    assert rows(T.to_pixels(got["mask"], ["m"], only="m"), "scene", "y", "x") == rows(want["mask"], "scene", "y", "x")
    assert rows(got["cuts"], "scene", "mu", "sigma", "threshold") == rows(want["thresholds"], "scene", "mu", "sigma", "threshold")
    assert rows(got["zonal"], *want["zonal"].columns) == rows(want["zonal"], *want["zonal"].columns)


def test_a_filter_shuffles_tiles_once_and_edges_once(spark):
    tiles = scenes(spark, [np.random.default_rng(0).random((1, 40, 40))], ["v"], 10)
    out = TF.roughness(T.partitioned(tiles))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    # The exchange of the tiles stands in both uses and runs once.
    assert len(re.findall(r"REPARTITION_BY_COL", final)) - len(re.findall("ReusedExchange", final)) <= 1
    assert len(re.findall(r"ENSURE_REQUIREMENTS", final)) == 1
    # What that one moves is the edges: the strips of radius 2 around 16 tiles of 10 x 10.
    strips = T._strips(T.partitioned(tiles), 2).select(F.explode("strips").alias("s")).agg(F.sum(F.length("s.strip"))).first()[0]
    assert strips < 16 * 8 * (4 * 2 * 10 + 4 * 2 * 2)


def test_filters_of_whole_scenes_of_odd_sizes(spark):
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (1, 30), (11, 10), (20, 10), (21, 19)):
        a = rng.random((1, h, w))
        want = np.pad(a[0], 2, "symmetric") if min(h, w) > 1 else np.pad(a[0], 2, "symmetric")
        want = np.array([[want[y : y + 5, x : x + 5].std() for x in range(w)] for y in range(h)])
        got = back(TF.roughness(T.partitioned(scenes(spark, [a], ["v"], 10))))[0][0]
        assert np.allclose(got, want, atol=1e-7)


def test_a_radius_beyond_a_tile_is_refused(spark):
    with pytest.raises(Exception, match="more than a tile"):
        TF.opened_closed(T.partitioned(scenes(spark, [np.ones((1, 8, 8))], ["m"], 3, "|u1"))).collect()


def test_missing_tiles_count_as_zeros(spark):
    tiles = scenes(spark, [np.ones((1, 12, 12))], ["m"], 6, "|u1").where("not (ty = 0 and tx = 1)")
    got = back(TF.opened_closed(T.partitioned(tiles)))[0][0]
    assert got[6:, :].sum() > 0 and got[:6, 6:].sum() == 0


def test_opened_classes_equal_squares(spark):
    c = np.random.default_rng(9).integers(0, 3, (1, 23, 17))
    want = np.zeros((23, 17))
    for y in range(22):
        for x in range(16):
            if c[0, y, x] and (c[0, y : y + 2, x : x + 2] == c[0, y, x]).all():
                want[y : y + 2, x : x + 2] = c[0, y, x]
    assert (back(TF.opened_classes(T.partitioned(scenes(spark, [c], ["k"], 6, "<i4"))))[0][0] == want).all()


@pytest.mark.parametrize("target", [(20, 40), (9, 77), (50, 16), (1, 1)])
def test_resize_equals_its_pixel_form(spark, target):
    v = V.pixels(spark, SF).where("scene < 2").select((F.col("scene") * 2 + F.col("t")).alias("scene"), "y", "x", F.floor(F.get("bands", F.lit(0)) * 127.0).alias("v"))
    want = rows(A.resize_bilinear(v, (H, W), target), "scene", "y", "x", "v")
    assert rows(T.to_pixels(TF.resize_bilinear(T.from_pixels(v, ["v"], H, W, side=7), target), ["v"]), "scene", "y", "x", "v") == want


# --- components ---


def flood(m):
    out, n = np.zeros(m.shape, int), 0
    for start in zip(*np.nonzero(m)):
        if out[start]:
            continue
        n += 1
        out[start], todo = n, [start]
        while todo:
            y, x = todo.pop()
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1] and m[p] and not out[p]:
                    out[p] = n
                    todo.append(p)
    return out


def serpentine(h, w):
    m = np.zeros((h, w), bool)
    m[::2] = True
    for k, y in enumerate(range(1, h, 2)):
        m[y, -1 if k % 2 == 0 else 0] = True
    return m


def masks():
    rng = np.random.default_rng(4)
    ring = np.zeros((40, 40), bool)
    for k in range(0, 20, 2):
        ring[k : 40 - k, k : 40 - k] = True
        ring[k + 1 : 39 - k, k + 1 : 39 - k] = False
    return [*(rng.random((40, 40)) < p for p in (0.4, 0.58, 0.62, 0.9)), serpentine(40, 40), serpentine(40, 40).T, ring, np.zeros((40, 40), bool), np.ones((40, 40), bool)]


def test_labels_inside_a_tile():
    for m in [*masks(), np.zeros((1, 1), bool), np.ones((1, 7), bool), np.ones((7, 1), bool)]:
        assert (TL.label(m) == flood(m)).all()


@pytest.mark.parametrize("side", [4, 9, 64])
def test_components_over_tiles(spark, side):
    """Among them a serpentine over ten tiles by ten (side 4): one component in as many rounds as ten tiles halve."""
    found = masks()
    tiles = scenes(spark, [m[None] for m in found], ["m"], side, "|u1")
    got = written(TL.components(tiles), "labels")
    arrays = back(got)
    for s, m in enumerate(found):
        assert (arrays[s][0] == flood(m)).all(), s
    rounds = TL.border_roots(written(T.mapped(tiles, TL._labelled, kind="<i4"), "tile_labels"))[1]
    assert rounds == max(0, (-(-40 // side) - 1).bit_length())
    boxes = {(r["scene"], r["label"]): tuple(r)[2:] for r in TL.boxes(got).collect()}
    for s, m in enumerate(found):
        for k in range(1, flood(m).max() + 1):
            y, x = np.nonzero(flood(m) == k)
            assert boxes.pop((s, k)) == (x.min(), y.min(), x.max() + 1, y.max() + 1, len(y))
    assert not boxes


def test_ranks_over_partitions(spark):
    values = [5, 3, 3, None, 9, 1, 3, 7] * 20
    df = written(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7), "values")
    got = sorted((r["rank"], r["v"]) for r in ranked(df, F.asc_nulls_first("v")).collect())
    assert [k for k, _ in got] == list(range(1, 161))
    assert [v for _, v in got] == sorted(values, key=lambda v: (v is not None, v))
    assert ranked(written(df.where("i < 0"), "none"), F.asc("v")).collect() == []


# --- warps ---


def warp_by_loops(a, h, w, by, ay, bx, ax):
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            v, u = by + ay * (y + 0.5), bx + ax * (x + 0.5)
            if not (0 <= v < a.shape[0] and 0 <= u < a.shape[1]):
                continue
            i, j = int(np.floor(v - 0.5)), int(np.floor(u - 0.5))
            near = [(k, l, (1 - abs(v - 0.5 - k)) * (1 - abs(u - 0.5 - l))) for k in (i, i + 1) for l in (j, j + 1)]
            near = [(k, l, f) for k, l, f in near if 0 <= k < a.shape[0] and 0 <= l < a.shape[1]]
            out[y, x] = sum(a[k, l] * f for k, l, f in near) / sum(f for *_, f in near)
    return out


@pytest.mark.parametrize("side", [4, 7, 64])
def test_warps_equal_loops(spark, side):
    rng = np.random.default_rng(side)
    a = rng.random((2, 23, 31))
    cases = [(10, 12, 0.3, 1.0, 0.7, 1.0), (9, 14, 2.25, 2.1, 1.5, 1.9), (30, 40, -3.0, 0.6, 5.2, 0.75), (6, 5, 100.0, 1.0, 0.0, 1.0), (3, 3, 22.6, 0.1, 30.7, 0.1)]
    w = [(s, h, w_, by, ay, bx, ax) for s, (h, w_, by, ay, bx, ax) in enumerate(cases)]
    windows = written(spark.createDataFrame(w, "scene long, new_height int, new_width int, by double, ay double, bx double, ax double"), "windows")
    got = back(WP.warped(scenes(spark, [a] * len(cases), ["p", "q"], side), windows, layers=2), 2)
    for s, (h, w_, *m) in enumerate(cases):
        for k in range(2):
            assert np.allclose(got[s][k], warp_by_loops(a[k], h, w_, *m)), (s, k)


def test_pairs_on_one_grid(spark):
    """The second image is the first one's ground in pixels of another size: what comes back is nearly the first."""
    f = lambda x, y: np.sin(x / 90.0) + np.cos(y / 70.0)
    ground = lambda left, top, p, h, w: f(left + (np.arange(w) + 0.5) * p, (top - (np.arange(h)[:, None] + 0.5) * p))[None]
    one, two = ground(0.0, 500.0, 10.0, 40, 30), ground(33.25, 471.9, 7.5, 44, 50)
    grid = (0, 0.0, 500.0, 10.0, 10.0, 30, 40, 33.25, 471.9, 7.5, 7.5, 50, 44)
    apart = (1, 0.0, 500.0, 10.0, 10.0, 30, 40, 300.0, 500.0, 7.5, 7.5, 50, 44)
    kind = "scene long, left1 double, top1 double, px1 double, py1 double, width1 int, height1 int, left2 double, top2 double, px2 double, py2 double, width2 int, height2 int"
    pairs, w = WP.aligned(scenes(spark, [one] * 2, ["v"], 8), scenes(spark, [two] * 2, ["v"], 8), spark.createDataFrame([grid, apart], kind), layers=1)
    got = back(pairs, 2)
    assert list(got) == [0] and [r["scene"] for r in w.collect()] == [0]
    r = w.first()
    assert (r["off_x"], r["off_y"], r["new_width"], r["new_height"]) == (3, 2, 27, 33)
    assert np.allclose(got[0][0], one[0, 2:35, 3:30])
    inside = got[0][1][2:-3, 2:-3]
    assert np.abs(inside - got[0][0][2:-3, 2:-3]).max() < 0.01
    whole = back(WP.warped(scenes(spark, [np.round(two * 100)] * 2, ["v"], 8), w, layers=1, kind="<i2"))[0][0]
    assert np.abs(whole[2:-3, 2:-3] - inside * 100).max() < 1.5


# --- spectra ---


@pytest.mark.parametrize("side,band_lines", [(8, 3), (64, 1000)])
def test_shifts_equal_the_transform_of_a_whole_scene(spark, side, band_lines, monkeypatch):
    rng = np.random.default_rng(6)
    h, w = 37, 53
    pairs = []
    for k, (dy, dx) in enumerate([(0, 0), (2, -3), (-5, 20), (18, 26), (1, 1), (0, 0)]):
        a = rng.random((h, w))
        b = np.roll(a, (dy, dx), (0, 1)) + 0.2 * rng.random((h, w))
        pairs.append(np.stack([a, np.zeros((h, w)) if k == 4 else b if k < 5 else rng.random((h, w))]))
    monkeypatch.setattr(SP, "BAND_BYTES", 16 * 2 * w * band_lines)
    got = {r["scene"]: r.asDict() for r in SP.shifts(scenes(spark, pairs, ["a", "b"], side)).collect()}
    for s, (a, b) in enumerate(pairs):
        want = A.phase_shift(a, b)
        assert all(abs(got[s][k] - v) < 1e-9 for k, v in want.items()), (s, want)
