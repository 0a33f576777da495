"""Specialists as table functions of SQL: results, schemas, what they refuse, models shared in a worker."""

import numpy as np
import pytest
from test_tiles import scenes

from gridloom.operators import tile_filters as TF
from gridloom.plans import functions as FN
from gridloom.store import written


@pytest.fixture(scope="module")
def views(spark):
    r = np.random.default_rng(2)
    d = [r.random((1, 20, 13)) for _ in range(3)]
    k = [r.integers(0, 6, (1, 20, 13)) for _ in range(2)]
    FN.register(spark)
    distance = scenes(spark, d, ["d"], 7)
    TF.with_scene(distance, TF.cuts(distance)).createOrReplaceTempView("test_distances")
    scenes(spark, k, ["k"], 7, "<i4").createOrReplaceTempView("test_classes")
    return d, k, {x["scene"]: x["threshold"] for x in TF.cuts(distance).collect()}


def test_change_statistics(spark, views):
    d, _, cuts = views
    got = {x["scene"]: x for x in spark.sql("select * from change_statistics(table(select * from test_distances) partition by scene)").collect()}
    assert sorted(got) == [0, 1, 2]
    for s, a in enumerate(d):
        n = int((a / a.max() >= cuts[s]).sum())
        assert (got[s]["total"], got[s]["changed"], got[s]["largest"]) == (260, n, 1.0) and abs(got[s]["ratio_pct"] - n / 2.6) < 1e-9


def test_class_shares(spark, views):
    got = spark.sql("select scene, class, pixels from class_shares(table(select *, 'x' as other from test_classes) partition by scene)").collect()
    names = FN._names()
    want = {(s, names[k], int((a == k).sum())) for s, a in enumerate(views[1]) for k in range(6) if (a == k).any()}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    none = spark.sql("select * from class_shares(table(select * from test_classes where scene < 0) partition by scene)")
    assert none.collect() == [] and none.columns == ["scene", "class", "pixels", "pct"]


def test_tables_without_tiles_are_refused(spark, views):
    with pytest.raises(Exception, match="no columns"):
        spark.sql("select * from change_statistics(table(select * from test_classes) partition by scene)").collect()
    with pytest.raises(Exception, match="table"):
        spark.sql("select * from class_shares(5)").collect()


def test_tiles_written_between(spark, views):
    assert written(spark.table("test_classes"), "again").count() == 2 * 6
