"""Ranged reads: headers, blocks of rasters with pushed filters, members of archives."""

import io
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan
from test_operators import png, tiff_parts
from test_tiles import back

from gridloom.sources import archives as AR
from gridloom.sources import blocks as BL
from gridloom.sources import raster as SR
from gridloom.sources.ranges import Ranged, listed

BIG = np.random.default_rng(0).integers(0, 60000, (3, 600, 400)).astype(np.uint16)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("rasters")
    (d / "planes.tif").write_bytes(tiff_parts(BIG, 4, 1, 1, 2, False))
    (d / "tiles.tif").write_bytes(tiff_parts(BIG, 64, 8, 2, 1, True))
    (d / "bad.tif").write_bytes(b"II*\0garbage")
    (d / "_hidden.tif").write_bytes(b"")
    (d / "rgb.png").write_bytes(png(np.moveaxis(BIG[:, :50, :30] % 256, 0, 2), 8, 2, [4, 1, 2]))
    return str(d)


def reader(path, filters=(), **options):
    r = BL.BlockReader({"path": path, **options})
    return r, list(r.pushFilters(list(filters)))


def test_ranges(tmp_path):
    data = bytes(range(256)) * 2000
    (tmp_path / "f").write_bytes(data)
    with Ranged(str(tmp_path / "f")) as r:
        for a, b in ((0, 10), (65530, 65550), (511990, 600000), (5, 5), (100, 300000)):
            assert r[a:b] == data[a:b]
        assert r[70000] == data[70000] and len(r) == len(data)
    with Ranged(f"file://{tmp_path}/f") as r:
        r[:8], r[8:16], r[400:500]
        assert r.read == 1 << 16  # one page
    assert [p.rsplit("/", 1)[1] for p, _ in listed(str(tmp_path))] == ["f"] and listed(str(tmp_path / "none")) == []


def test_a_band_and_a_window_read_only_their_bytes(folder):
    """Of 450 strips in planes those of one band and 20 lines: five strips of 4 lines, and pages of the header."""
    r, left = reader(f"{folder}/planes.tif", [EqualTo(("band",), 2), GreaterThan(("y1",), 100), LessThan(("y0",), 120), IsNotNull(("band",))])
    assert left == []
    assert reader(f"{folder}/planes.tif", [EqualTo(("kind",), "<u2")])[1] == [EqualTo(("kind",), "<u2")]
    got = [b.to_pylist()[0] for p in r.partitions() for b in r.read(p)]
    assert [(g["band"], g["y0"], g["y1"]) for g in got] == [(2, y, y + 4) for y in range(100, 120, 4)]
    assert np.array_equal(np.concatenate([np.frombuffer(g["data"], g["kind"]).reshape(4, 400) for g in got]), BIG[1, 100:120])
    whole = BIG.nbytes
    assert r.took <= 8 * (1 << 16) < whole / 2 and r.took >= 20 * 400 * 2


def test_shares_of_a_file_read_their_blocks_alone(folder):
    r, _ = reader(f"{folder}/planes.tif", sharebytes=str(200_000))
    shares, seen = r.partitions(), []
    assert len(shares) == -(-len(tiff_parts(BIG, 4, 1, 1, 2, False)) // 200_000)
    for s in shares:
        seen += [(x["band"], x["y0"]) for b in r.read(s) for x in b.to_pylist()]
        assert r.took < 200_000 + 6 * (1 << 16) + 3 * 4 * 800 * 20
    assert sorted(seen) == [(b, y) for b in (1, 2, 3) for y in range(0, 600, 4)]


def test_bands_that_are_asked_for_twice(folder):
    r, _ = reader(f"{folder}/tiles.tif", [In(("band",), (1, 2)), In(("band",), (2, 3))])
    assert {x["band"] for p in r.partitions() for b in r.read(p) for x in b.to_pylist()} == {2}
    r, _ = reader(f"{folder}/tiles.tif", [EqualTo(("band",), 9)])
    assert [b for p in r.partitions() for b in r.read(p)] == []


def test_filters_are_pushed_by_spark(spark, folder):
    df = BL.read_blocks(spark, folder, bands=[3], window=(70, 10, 130, 100), pattern="*.tif", share_bytes=100_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    rows = df.where("path like '%tiles.tif'").select("band", "y0", "x0").collect()
    assert sorted(map(tuple, rows)) == [(3, y, x) for y in (64, 128) for x in (0, 64)]
    assert df.select(F.spark_partition_id()).distinct().count() > 1


def test_samples_of_a_window(spark, folder):
    got = BL.read_bands(spark, folder, [2, 3], window=(30, 20, 45, 29)).collect()
    want = {(n, b, y, x): float(int(BIG[b - 1, y, x]) % (256 if n == "rgb.png" else 1 << 16)) for n in ("planes.tif", "tiles.tif", "rgb.png") for b in (2, 3) for y in range(30, 45) for x in range(20, 29)}
    assert {(r["path"].rsplit("/", 1)[1], r["band"], r["y"], r["x"]): r["value"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("side", [50, 256])
def test_files_to_tiles(spark, folder, side):
    blocks = BL.read_blocks(spark, folder, pattern="*.tif", share_bytes=300_000)
    scenes = spark.createDataFrame([(f"{folder}/planes.tif", 5), (f"{folder}/tiles.tif", 6)], "path string, scene long")
    got = back(BL.to_tiles(blocks, scenes, [3, 1], side=side), 2)
    assert sorted(got) == [5, 6] and all(np.array_equal(a, BIG[[2, 0]]) for a in got.values())


def jp2(width, height, n, bits=7, geo=b""):
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    head = box(b"jp2h", box(b"ihdr", struct.pack(">IIHBBBB", height, width, n, bits, 7, 0, 0)))
    uuid = box(b"uuid", SR.GEO_BOX + geo) if geo else b""
    return box(b"jP  ", b"\r\n\x87\n") + box(b"ftyp", b"jp2 \0\0\0\0jp2 ") + head + uuid + struct.pack(">I4s", 0, b"jp2c") + b"\xff\x4f\xff\x51"


def nitf(width, height, n, kind="INT", bits=11, where="N"):
    f = lambda v, size: str(v).ljust(size).encode()
    d = lambda v, size: str(v).rjust(size, "0").encode()
    at = 404
    head = b"NITF02.10" + f("", 30) + f("a title", 80) + f("", 223) + f("", 12) + d(at, 6) + b"001" + d(439, 6) + d(9, 10)
    image = b"IM" + f("scene", 10) + f("", 14 + 17 + 80 + 167 + 1 + 42) + d(height, 8) + d(width, 8) + f(kind, 3) + f("MULTI", 8) + f("MS", 8) + d(bits, 2) + b"R" + where.encode()
    image += (b"43" + f("", 58) if where.strip() else b"") + b"1" + f("a comment", 80) + b"C8" + f("", 4) + (str(n).encode() if n < 10 else b"0" + d(n, 5))
    return head.ljust(at, b" ") + image


def test_headers_of_jp2_and_nitf(spark, tmp_path):
    geo = tiff_parts(np.zeros((1, 1, 1), np.uint16), 1, 1, 1, 1, False)
    (tmp_path / "a.jp2").write_bytes(jp2(300, 200, 4, 15, geo))
    (tmp_path / "b.j2k").write_bytes(b"\xff\x4f\xff\x51" + struct.pack(">HHIIIIIIIIH", 47, 0, 110, 70, 10, 20, 64, 64, 0, 0, 3) + b"\x8b\x01\x01")
    (tmp_path / "c.ntf").write_bytes(nitf(1024, 512, 12))
    (tmp_path / "d.ntf").write_bytes(nitf(64, 32, 1, "R", 32, " "))
    (tmp_path / "e.jp2").write_bytes(jp2(300, 200, 4)[:20])
    (tmp_path / "f.ntf").write_bytes(b"NITF02.10 cut")
    (tmp_path / "g.gif").write_bytes(b"GIF89a...")
    (tmp_path / "h.bin").write_bytes(b"zz")
    h = {r["path"][-5:]: r for r in SR.inspect(spark, str(tmp_path)).collect()}
    of = lambda n: tuple(h[n][c] for c in ("driver", "width", "height", "n_bands", "dtype", "crs"))
    assert of("a.jp2") == ("JP2OpenJPEG", 300, 200, 4, "uint16", None) and h["a.jp2"]["bounds"] == [500.0, -1100.0, 3500.0, 900.0]
    assert of("b.j2k") == ("JP2OpenJPEG", 100, 50, 3, "int16", None)
    assert of("c.ntf") == ("NITF", 1024, 512, 12, "uint16", "EPSG:32643") and h["c.ntf"]["tags"]["NITF_FTITLE"] == "a title"
    assert of("d.ntf") == ("NITF", 64, 32, 1, "float32", None)
    kinds = {n: h[n]["error_kind"] for n in ("e.jp2", "f.ntf", "g.gif", "h.bin")}
    assert kinds == {"e.jp2": "corrupted", "f.ntf": "corrupted", "g.gif": "unsupported", "h.bin": "unreadable"}


# --- archives ---


def members(n):
    return {f"part/{i:03d}.{'img.bin' if i % 2 else 'json'}": bytes([i % 256]) * (2000 + 7 * i) for i in range(n)}


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    d = tmp_path_factory.mktemp("archives")
    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz"), ("c.tar.xz", "w:xz")):
        with tarfile.open(d / name, mode) as t:
            for k, v in members(60).items():
                i = tarfile.TarInfo(k)
                i.size = len(v)
                t.addfile(i, io.BytesIO(v))
            t.addfile(tarfile.TarInfo("x" * 150 + ".txt"), io.BytesIO(b""))
    for name, method in (("d.zip", zipfile.ZIP_DEFLATED), ("e.zip", zipfile.ZIP_STORED), ("f.zip", zipfile.ZIP_LZMA), ("g.zip", zipfile.ZIP_BZIP2)):
        with zipfile.ZipFile(d / name, "w", method) as z:
            z.writestr("folder/", b"")
            for k, v in members(60).items():
                z.writestr(k, v)
    (d / "h.zip").write_bytes(b"PK\x03\x04 cut off")
    (d / "i.tar").write_bytes(b"nope")
    cut = (d / "a.tar").read_bytes()
    (d / "j.tar").write_bytes(cut[: len(cut) // 2])
    return d


def test_members_of_all_kinds(spark, archives):
    rows = AR.read_members(spark, str(archives), "*", share_bytes=50_000).collect()
    want = {(n.rsplit(".", 2 if n.endswith("bin") else 1)[0], n.split(".", 1)[1]): v for n, v in members(60).items()}
    of = lambda a: {(r["key"], r["ext"]): bytes(r["content"]) for r in rows if r["archive"].endswith(a) and r["key"] and r["content"] is not None}
    for a in ("a.tar", "b.tar.gz", "c.tar.xz"):
        assert of(a) == {**want, ("x" * 150, "txt"): b""}, a
    for a in ("d.zip", "e.zip", "f.zip", "g.zip"):
        assert of(a) == want, a
    assert {r["archive"][-5:] for r in rows if r["key"] is None} == {"h.zip", "i.tar", "j.tar"}
    got = of("j.tar")
    assert got and all(want[k] == v for k, v in got.items())


def test_one_archive_is_read_by_several_tasks(spark, archives):
    got = AR.read_members(spark, str(archives), "d.zip", share_bytes=300).withColumn("task", F.spark_partition_id())
    assert got.select("task").distinct().count() > 1 and got.count() == 60


def test_a_member_is_read_without_the_rest(spark, archives):
    index = {r["name"]: r for r in AR.archive_index(spark, str(archives), "e.zip").collect()}
    r = index["part/041.img.bin"]
    with Ranged(str(archives / "e.zip")) as data:
        content = AR.member(data, r["kind"], r["at"], r["size"], r["packed"], r["crc"])
        assert data.read <= 2 * (1 << 16) < len(data)
    assert content == members(60)["part/041.img.bin"]
    with Ranged(str(archives / "e.zip")) as data, pytest.raises(ValueError, match="check"):
        AR.member(data, r["kind"], r["at"], r["size"], r["packed"], r["crc"] ^ 1)


def test_chosen_members(spark, archives):
    from gridloom.store import written

    index = written(AR.archive_index(spark, str(archives), "*.tar"), "index").where("name like '%.json' and archive like '%a.tar'")
    got = AR.read_indexed(index).collect()
    assert len(got) == 30 and {r["ext"] for r in got} == {"json"} and zlib.crc32(got[0]["content"]) >= 0


def test_samples_of_three_members(spark, tmp_path):
    from gridloom.store import written

    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name, data in [("x/1.0.img", b"one"), ("x/1.1.img", b"two"), ("x/1.json", b"{}"), ("2.0.img", b"no"), ("2.json", b"{}"), ("3.0.img", b"3a"), ("3.json", b"[]"), ("3.1.img", b"3b"), ("3.0.img", b"again"), ("4", b"")]:
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    index = written(AR.archive_index(spark, str(tmp_path), "*.tar"), "index")
    got = AR.read_samples(index, {"t1": "0.img", "t2": "1.img", "meta": "json"}).collect()
    assert sorted((r["key"], bytes(r["t1"]), bytes(r["t2"]), bytes(r["meta"])) for r in got) == [("3", b"3a", b"3b", b"[]"), ("x/1", b"one", b"two", b"{}")]
    assert AR.read_samples(index, {"a": "0.img", "b": "gone"}).collect() == []
