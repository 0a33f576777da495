"""Scenes that lack lines at their end, at their beginning, inside and of one time only: tile queries beside their SQL."""

import duckdb
import pytest

from gridloom import queries as q

from test_oracle import SF, rows

q.load()
NAMES = """agg3_tiles_boxes agg6_agg7_tiles_thresholds cmp1_win2_tiles_mask cmp3_agg1_tiles_zonal jn1_win6_affine_warp map9_tiles_resize
udf1_change_statistics udf1_udf7_class_shares win1_tiles_roughness win3_tiles_opened_classes win4_tiles_components""".split()


@pytest.fixture(scope="module")
def lacking(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lacking"))
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e.where("(vec_id < 148 or vec_id between 248 and 290 or vec_id = 300) and vec_id not in (20, 21, 22, 23, 31, 120)").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_pixels_that_are_not_there(spark, lacking, name):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{lacking}/embeddings.parquet/*.parquet'")
    got, want = q.QUERIES[name](spark, lacking).toPandas(), c.execute(q.SQL[name]).df()
    assert rows(got) == rows(want)
