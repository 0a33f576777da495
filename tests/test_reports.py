"""Gated answers, evidence look-up and metrics, whole reports with their fallback, and the sink that commits."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evidence as E
from gridloom.operators import scoring as S
from gridloom.sources import reports as RP

ITEMS = [
    ("a1", 1, "CHANGE_DETECT", "statistic", None, 320.0, 0.95, False), ("a2", 1, "CHANGE_DETECT", "region", "changed_region_01", 200.0, 0.6, False), ("a3", 1, "CHANGE_DETECT", "region", "changed_region_02", 120.0, 0.7, True),
    ("a4", 1, "OPTICAL_SAR_FUSION", "class", "water_body", 12.5, 0.92, False), ("a5", 1, "OPTICAL_SAR_FUSION", "class", "unknown", 3.0, 0.5, True),
    ("b1", 2, "RS_GROUND", "negative", None, 0.0, 0.25, True), ("c1", 3, "RS_GROUND", "box", "box_01", 0.8, 0.8, False), ("c2", 3, "RS_GROUND", "box", "box_02", 0.9, 0.9, False), ("d1", 4, "CHANGE_DETECT", "statistic", None, 0.0, 0.95, False),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, request long, specialist string, type string, region string, value double, confidence double, is_uncertain boolean")


def test_gated_answers(spark):
    c = lambda *rules: [(r, s) for r, s in rules]
    warn, bad = ("C2_UNSUPPORTED_REGION", "warning"), ("C1_ZERO_CHANGE_CONTRADICTION", "critical")
    rows = [("It grew.", "consistent", c()), ("It grew.", "contradictory", c(warn, bad)), ("It grew.", "contradictory", c()), (None, "insufficient_evidence", c()), ("It grew.", "uncertain", c(warn, warn)), ("It grew.", "partially_consistent", c(warn)), (None, "consistent", None), ("x", "partially_consistent", c(("OTHER", "warning")))]
    df = spark.createDataFrame(rows, "a string, s string, c array<struct<rule: string, severity: string>>")
    got = [r["v"] for r in df.select(S.gated_answer(F.col("a"), F.col("s"), F.col("c")).alias("v")).collect()]
    assert got[0] == "It grew." and got[6] is None
    assert got[1].startswith("[contradiction] " + S.SAYS[bad[0]]) and "It grew" not in got[1]
    assert got[2].startswith("[contradiction] The evidence contradicts itself.")
    assert got[3].startswith("[insufficient evidence] There is too little evidence.")
    assert got[4] == "[provisional] It grew. (The evidence is ambiguous; conflicts noted: 2.)"
    assert got[5] == f"It grew. [partly consistent: {S.SAYS[warn[0]]}]" and got[7] == "x [partly consistent: OTHER]"


def test_lookup_and_metrics(items):
    ids = lambda **k: sorted(r["item_id"] for r in E.lookup(items, **k).collect())
    assert ids(specialist="RS_GROUND") == ["b1", "c1", "c2"] and ids(region="box_01") == ["c1"] and ids(kind="statistic") == ["a1", "d1"]
    assert ids(specialist="CHANGE_DETECT", kind="region", region="changed_region_02") == ["a3"] and len(ids()) == len(ITEMS)
    m = {r["request"]: r for r in E.metrics(items).collect()}
    one = m[1]
    assert (one["changed_pixels"], one["regions"], one["largest_region"], one["boxes"], one["best_confidence"]) == (320, 2, 200, 0, 0.95)
    assert one["classes"] == {"unknown": 3.0, "water_body": 12.5} and one["notes"] == ["Uncertain items: 2."]
    assert m[2]["notes"] == ["Nothing was found of what was looked for.", "Uncertain items: 1."] and m[3]["boxes"] == 2 and m[4]["notes"] == ["No pixel changed."]


@pytest.fixture(scope="module")
def reports(spark, items):
    requests = spark.createDataFrame([(k, f"question {k}?", "change_detection", f"answer {k}.", "the scene can't be read" if k == 3 else None) for k in range(1, 6)], "request long, query string, task string, answer string, error string")
    inputs = spark.createDataFrame([(k, r, f"{r}{k}.tif", 10, 20, 3, None, "optical") for k in (1, 3) for r in ("t1", "t2")], "request long, role string, filename string, width int, height int, n_bands int, crs string, modality string")
    judged = spark.createDataFrame([(1, "partially_consistent", 0.6, "MEDIUM", [("C4_AREA_CONSISTENCY", "warning")]), (2, "insufficient_evidence", 0.2, "UNSUPPORTED", []), (4, "consistent", 0.9, "HIGH", None)], "request long, status string, confidence double, tier string, conflicts array<struct<rule: string, severity: string>>")
    ran = spark.createDataFrame([(1, "CHANGE_DETECT", "ok"), (1, "OPTICAL_SAR_FUSION", "ok"), (3, "RS_GROUND", "failed")], "request long, specialist string, state string")
    return E.full_report(requests, inputs, items, judged, ran).cache()


def test_one_bad_request_gives_one_fallback(reports):
    r = {x["request"]: x for x in reports.collect()}
    assert len(r) == 5 and [k for k in r if r[k]["error"]] == [3]
    bad = r[3]
    assert bad["answer"] == "The report couldn't be made: the scene can't be read" and bad["title"] == "question 3?" and len(bad["inputs"]) == 2
    assert bad["statistics"] is None and bad["confidence"] is None and bad["findings"] == [] and bad["n_findings"] == 0 and bad["provenance"][0]["state"] == "failed"
    one = r[1]
    assert one["answer"] == f"answer 1. [partly consistent: {S.SAYS['C4_AREA_CONSISTENCY']}]" and one["consistency"]["action"] == "qualify"
    assert [i["role"] for i in one["inputs"]] == ["t1", "t2"] and one["n_findings"] == 5 and one["findings"][0] == "CHANGE_DETECT statistic: 320.00"
    assert one["statistics"]["classes"]["water_body"] == 12.5 and [p["specialist"] for p in one["provenance"]] == ["CHANGE_DETECT", "OPTICAL_SAR_FUSION"]
    assert r[4]["answer"] == "answer 4." and r[4]["confidence"]["tier"] == "HIGH"
    assert r[5]["consistency"]["status"] == "insufficient_evidence" and r[5]["findings"] == []


def test_many_findings_are_listed_up_to_a_bound(spark, items, monkeypatch):
    monkeypatch.setattr(E, "MOST_FINDINGS", 2)
    requests = spark.createDataFrame([(1, "q", "t", "a", None)], "request long, query string, task string, answer string, error string")
    inputs = spark.createDataFrame([], "request long, role string, filename string, width int, height int, n_bands int, crs string, modality string")
    judged = spark.createDataFrame([], "request long, status string, confidence double, tier string, conflicts array<struct<rule: string, severity: string>>")
    r = E.full_report(requests, inputs, items, judged, spark.createDataFrame([], "request long, specialist string, state string")).first()
    assert r["findings"] == ["CHANGE_DETECT statistic: 320.00", "OPTICAL_SAR_FUSION water_body: 12.50"] and r["n_findings"] == 5


def files(path):
    return sorted(f for d, _, names in os.walk(path) for f in names if not f.startswith("."))


def test_reports_are_published_by_the_commit(reports, tmp_path):
    RP.write_json_reports(reports, str(tmp_path / "json"))
    RP.write_markdown_reports(reports, f"file://{tmp_path}/md")
    assert files(tmp_path / "json") == [f"report-{k}.json" for k in range(1, 6)] and files(tmp_path / "md") == [f"report-{k}.md" for k in range(1, 6)]
    assert not [d for d in os.listdir(tmp_path / "json") if d.startswith("_")]
    by_name = {f: os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names}
    with open(by_name["report-1.json"], encoding="utf-8") as f:
        assert json.load(f)["statistics"]["changed_pixels"] == 320
    with open(by_name["report-3.md"], encoding="utf-8") as f:
        assert f.read().startswith("# question 3?\n\nThe report couldn't be made")
    RP.write_json_reports(reports.where("request = 1").withColumn("request", F.lit(9)), str(tmp_path / "json"))
    assert len(files(tmp_path / "json")) == 6


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("r"), F.col("id")).alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        RP.write_files(rows, str(tmp_path / "out"))
    assert files(tmp_path / "out") == [] and (not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == [])
    with pytest.raises(Exception, match="no file's name"):
        RP.write_files(spark.createDataFrame([("../up", "x")], RP.FILES), str(tmp_path / "out"))
    assert files(tmp_path) == []


def test_only_a_reported_try_of_a_task_is_published(tmp_path):
    w = RP.ReportWriter(str(tmp_path / "out"))
    batch = lambda *names: iter([pa.RecordBatch.from_pydict({"name": list(names), "content": ["x"] * len(names)})])

    def dies():
        yield from batch("a")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        w.write(dies())
    w.write(batch("a"))  # a try whose message never came
    w.commit([w.write(batch("a", "b")), None, w.write(iter([]))])
    assert files(tmp_path / "out") == ["a", "b"]
    w = RP.ReportWriter(str(tmp_path / "out"))
    w.abort([w.write(batch("c")), None])
    assert files(tmp_path / "out") == ["a", "b"] and len(os.listdir(tmp_path / "out")) == 1


def test_narratives_of_stages(spark):
    from gridloom.functions import text as T

    rows = [([("detect", "3 regions"), ("interpret", None)],), ([],), (None,)]
    df = spark.createDataFrame(rows, "s array<struct<name: string, finding: string>>")
    assert [r["v"] for r in df.select(T.stages_narrative(F.col("s")).alias("v")).collect()] == [
        "Step 1, detect: 3 regions. Step 2, interpret: nothing was found.", "No stage ran.", "No stage ran."
    ]


def test_training_tiles_keep_all_with_change_and_some_without(spark):
    from gridloom.operators.alignment import training_tiles

    px = [(0, y, x, y < 4 and x < 4) for y in range(13) for x in range(9)]
    t = training_tiles(spark.createDataFrame(px, "scene long, y int, x int, changed boolean"), 13, 9, (4, 4), least_changed=5, most_still=2)
    assert sorted((r["ty"], r["tx"], r["pixels"], r["changed"]) for r in t.collect()) == [(0, 0, 16, 16), (0, 1, 16, 0), (1, 0, 16, 0)]


def test_split_scenes_and_caps(spark):
    from gridloom.operators import corpus as K

    rows = [("train", s) for s in "cabba"] + [("val", "z"), ("val", None), (None, "q")]
    got = sorted(map(tuple, K.split_scenes(spark.createDataFrame(rows, "split string, scene string"), "split", "scene").collect()), key=str)
    assert got == sorted([(None, "q", 1, 1), ("train", "a", 2, 1), ("train", "b", 2, 2), ("train", "c", 1, 3), ("val", None, 1, 1), ("val", "z", 1, 2)], key=str)
    df = spark.range(40).withColumn("k", F.col("id") % 3)
    assert sorted(r["id"] for r in K.two_caps(df, "k", 4, 10, "id").collect()) == list(range(10))
    assert K.two_caps(df, "k", 2, 10, "id").count() == 6
