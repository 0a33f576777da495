"""Members of tar and zip archives: an index by ranged reads, then the members themselves, dealt to tasks by their bytes."""

from __future__ import annotations

import bz2
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import written
from .ranges import Ranged

#: kind is tar, zip, or stream for a packed tar, which has no places to begin at and is one row without a name; at is where a
#: tar's member or a zip's entry begins, size its bytes there, packed a zip's method, crc its check.
INDEX = "archive string, name string, kind string, at long, size long, packed int, crc long"
MEMBERS = "archive string, key string, ext string, content binary"
#: Bytes of members that a task reads.
SHARE_BYTES = 64 << 20
ROWS = 1_000


def _entries(path: str) -> Iterator[tuple]:
    with Ranged(path) as data:
        first = data[:6]
        data.file.seek(0)
        if first[:4] == b"PK\x03\x04" or first[:4] == b"PK\x05\x06":
            for i in zipfile.ZipFile(data.file).infolist():
                if not i.is_dir():
                    yield path, i.filename, "zip", i.header_offset, i.compress_size, i.compress_type, i.CRC
        elif first[:2] in (b"\x1f\x8b", b"BZ") or first == b"\xfd7zXZ\x00":
            yield path, None, "stream", 0, len(data), 0, 0
        else:
            with tarfile.open(fileobj=data.file, mode="r:") as t:
                for m in t:
                    # tarfile keeps what it has met; the next header is found without.
                    t.members = []
                    if m.isfile():
                        yield path, m.name, "tar", m.offset_data, m.size, 0, 0


_INDEX = pa.schema([("archive", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("packed", pa.int32()), ("crc", pa.int64())])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        rows.clear()
        return out

    for b in batches:
        for path in b.column("path").to_pylist():
            try:
                for row in _entries(path):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield flush()
            except (tarfile.TarError, zipfile.BadZipFile, OSError, ValueError, struct.error, EOFError):
                rows.append((path, None, None, None, None, None, None))
    if rows:
        yield flush()


def archive_index(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """SRC7, SRC8: rows of INDEX, of tar headers and zip directories alone. An archive that can't be read gives a last row
    without kind."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInArrow(_index, INDEX)


def member(data: Ranged, kind: str, at: int, size: int, packed: int, crc: int) -> bytes:
    """A member's bytes; what is read are its own, and a zip's the header before them."""
    if kind == "tar":
        if at + size > len(data):
            raise ValueError("the member is cut off")
        return data[at : at + size]
    name, extra = struct.unpack("<HH", data[at + 26 : at + 30])
    raw = data[at + 30 + name + extra : at + 30 + name + extra + size]
    unpack = {zipfile.ZIP_STORED: bytes, zipfile.ZIP_DEFLATED: lambda b: zlib.decompress(b, -15), zipfile.ZIP_BZIP2: bz2.decompress}.get(packed)
    if packed == zipfile.ZIP_LZMA:
        # Two bytes of version and two of the properties' length stand before the properties.
        n = struct.unpack("<H", raw[2:4])[0]
        properties = lzma._decode_filter_properties(lzma.FILTER_LZMA1, raw[4 : 4 + n])
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[properties]).decompress(raw[4 + n :])
    elif unpack is None:
        raise ValueError(f"method {packed} isn't supported")
    else:
        out = unpack(raw)
    if zlib.crc32(out) != crc:
        raise ValueError("the member doesn't match its check")
    return out


def _named(name: str) -> tuple[str, str]:
    folder, _, base = name.rpartition("/")
    key, _, ext = base.partition(".")
    return f"{folder}/{key}" if folder else key, ext


def _streamed(path: str) -> Iterator[tuple[str, bytes]]:
    with Ranged(path) as data, tarfile.open(fileobj=data.file, mode="r|*") as t:
        for m in t:
            t.members = []
            if m.isfile():
                yield m.name, t.extractfile(m).read()


def _batch(path: str, name: str | None, content: bytes | None) -> pa.RecordBatch:
    key, ext = _named(name) if name is not None else (None, None)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((path, pa.string()), (key, pa.string()), (ext, pa.string()), (content, pa.binary()))], ["archive", "key", "ext", "content"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, data = None, None
    broken = (tarfile.TarError, OSError, ValueError, EOFError, struct.error, zlib.error, lzma.LZMAError)
    try:
        for b in batches:
            for r in b.to_pylist():
                archive, name, kind, *place = (r[f.name] for f in _INDEX)
                if kind is None:
                    yield _batch(archive, None, None)
                    continue
                try:
                    if kind == "stream":
                        for inner, content in _streamed(archive):
                            yield _batch(archive, inner, content)
                        continue
                    if archive != path:
                        if data is not None:
                            data.file.close()
                        path, data = archive, Ranged(archive)
                    yield _batch(archive, name, member(data, kind, *place))
                except broken:
                    yield _batch(archive, None if kind == "stream" else name, None)
    finally:
        if data is not None:
            data.file.close()


def read_indexed(index: DataFrame, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Rows of MEMBERS of an index's rows, any choice of them: key is a member's name to its first dot, ext the rest. One that
    can't be read has no content, an archive that can't be a row without a key. index is a written table; its rows are
    dealt to as many tasks as their bytes ask for, and each task reads its members' bytes alone."""
    total = index.agg(F.sum("size").alias("s")).first()["s"] or 0
    dealt = index.repartition(max(1, -(-total // share_bytes)), F.xxhash64("archive", "at")).sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(_contents, MEMBERS)


def read_members(spark: SparkSession, path: str, pattern: str, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """SRC7, SRC8: rows of MEMBERS of the archives at path whose names match."""
    return read_indexed(written(archive_index(spark, path, pattern), "members"), share_bytes)


def read_samples(index: DataFrame, exts: dict[str, str], share_bytes: int = SHARE_BYTES) -> DataFrame:
    """JN9: archive, key and a binary column a name of exts (such as {"t1": "0.img", "t2": "1.img", "meta": "json"}) of each key
    that has a member of every one of these endings. What is joined are the index's rows; then each sample's members are
    read side by side, by one task. Of members of one name the first in the archive counts. Packed tars have no index.
    index is a written table."""
    base = F.element_at(F.split("name", "/"), -1)
    folder = F.regexp_extract("name", r"^(.*/)", 1)
    rows = index.where("name is not null").withColumns({"key": F.concat(folder, F.substring_index(base, ".", 1)), "ext": F.when(F.contains(base, F.lit(".")), F.regexp_extract(base, r"^[^.]*\.(.*)$", 1)).otherwise("")})
    place = F.struct("kind", "at", "size", "packed", "crc")
    out = None
    for column, ext in exts.items():
        one = rows.where(F.col("ext") == ext).groupBy("archive", "key").agg(F.min_by(place, "at").alias(column))
        out = one if out is None else out.join(one, ["archive", "key"])
    out = written(out, "samples")
    sizes = [F.col(f"{c}.size") for c in exts]
    total = out.agg(F.sum(sum(sizes[1:], sizes[0])).alias("s")).first()["s"] or 0
    dealt = out.repartition(max(1, -(-total // share_bytes)), F.xxhash64("archive", "key")).sortWithinPartitions("archive", f"{next(iter(exts))}.at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = []
                with Ranged(r["archive"]) as data:
                    for c in exts:
                        try:
                            found.append(member(data, *r[c].values()))
                        except (OSError, ValueError, EOFError, struct.error, zlib.error, lzma.LZMAError):
                            found.append(None)
                cols = [pa.array([r["archive"]]), pa.array([r["key"]]), *[pa.array([v], pa.binary()) for v in found]]
                yield pa.RecordBatch.from_arrays(cols, ["archive", "key", *exts])

    return dealt.mapInArrow(read, "archive string, key string, " + ", ".join(f"{c} binary" for c in exts))
