"""Raster headers and samples from files, own parsers: headers of TIFF, PNG, JPEG, JP2 and NITF; samples of TIFF (strips
and tiles; none, deflate or LZW) and PNG. Files are read by ranges: a header takes some pages, a block its own bytes.

Every file gives a row of headers; what can't be read has error_kind and never raises."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .ranges import Ranged

HEADER = "path string, driver string, width int, height int, n_bands int, dtype string, crs string, transform array<double>, bounds array<double>, resolution array<double>, descriptions array<string>, nodata double, tags map<string,string>, error_kind string, error string"

# TIFF field types (size, struct code), sample formats, and names of text tags.
FIELD = {
    1: (1, "B"),
    2: (1, "s"),
    3: (2, "H"),
    4: (4, "I"),
    5: (8, "II"),
    6: (1, "b"),
    8: (2, "h"),
    9: (4, "i"),
    11: (4, "f"),
    12: (8, "d"),
    16: (8, "Q"),
}
DTYPES = {
    (1, 8): "uint8",
    (1, 16): "uint16",
    (1, 32): "uint32",
    (2, 8): "int8",
    (2, 16): "int16",
    (2, 32): "int32",
    (3, 32): "float32",
    (3, 64): "float64",
}
TEXT_TAGS = {270: "TIFFTAG_IMAGEDESCRIPTION", 271: "TIFFTAG_MAKE", 305: "TIFFTAG_SOFTWARE", 306: "TIFFTAG_DATETIME"}


def tiff_fields(data: bytes) -> tuple[str, dict[int, list]]:
    """Byte order and the first directory's fields; raises ValueError on what isn't one."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF header")
    at = struct.unpack(order + "I", data[4:8])[0]
    if at + 2 > len(data):
        raise ValueError("directory beyond the end")
    fields: dict[int, list] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        e = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(e) < 12:
            raise ValueError("directory is cut off")
        tag, kind, n = struct.unpack(order + "HHI", e[:8])
        if kind not in FIELD:
            continue
        size, code = FIELD[kind]
        raw = e[8 : 8 + size * n] if size * n <= 4 else data[(p := struct.unpack(order + "I", e[8:])[0]) : p + size * n]
        if len(raw) < size * n:
            raise ValueError(f"field {tag} is cut off")
        if kind == 2:
            fields[tag] = [raw.rstrip(b"\0").decode("latin-1")]
        elif kind == 5:
            v = struct.unpack(order + f"{2 * n}I", raw)
            fields[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2])]
        else:
            fields[tag] = list(struct.unpack(order + f"{n}{code}", raw))
    return order, fields


def tiff_header(data: bytes) -> dict:
    _, f = tiff_fields(data)
    one = lambda t, d=None: f.get(t, [d])[0]
    tags = {name: str(f[t][0]) for t, name in TEXT_TAGS.items() if t in f}
    crs, keys = None, f.get(34735, [])
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0:
            crs = f"EPSG:{keys[k + 3]}"
    transform = None
    if 33550 in f and 33922 in f:
        sx, sy, i, j, x, y = *f[33550][:2], *f[33922][:2], *f[33922][3:5]
        transform = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
    nodata = one(42113)
    w, h, n = one(256), one(257), one(277, 1)
    bounds = resolution = None
    if transform and w and h:
        sx, _, x, _, sy, y = transform
        bounds, resolution = [min(x, x + w * sx), min(y, y + h * sy), max(x, x + w * sx), max(y, y + h * sy)], [abs(sx), abs(sy)]
    said = {int(k): v for k, v in re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)<', str(one(42112, "")))}
    return {
        "bounds": bounds,
        "resolution": resolution,
        "descriptions": [said.get(k, "") for k in range(n)] if said else None,
        "driver": "GTiff",
        "width": one(256),
        "height": one(257),
        "n_bands": one(277, 1),
        "dtype": DTYPES.get((one(339, 1), one(258, 1))),
        "crs": crs,
        "transform": transform,
        "nodata": float(nodata) if nodata not in (None, "") else None,
        "tags": tags,
    }


# Fixed value: the identifier of a JP2 box that holds a map grid as a TIFF of one pixel.
GEO_BOX = bytes.fromhex("b14bf8bd083d4b43a5ae8cd7d5a6ce03")


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the contents of the boxes of a JP2."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        begin = at + 8
        if size == 1:
            size, begin = struct.unpack(">Q", data[at + 8 : at + 16])[0], at + 16
        stop = end if size == 0 else at + size
        if stop < begin:
            raise ValueError("a box of no size")
        yield kind, begin, min(stop, end)
        at = stop


def _whole(bits: int) -> str | None:
    """The type of whole numbers of JPEG 2000's bits: one less than their number, and their sign above."""
    size = next((n for n in (8, 16, 32) if (bits & 127) + 1 <= n), None)
    return size and f"{'int' if bits & 128 else 'uint'}{size}"


def jp2_header(data: bytes) -> dict:
    """Size, bands and type stand in the header box or at the codestream's begin, the map grid in a box of its own."""
    h = {"driver": "JP2OpenJPEG", "tags": {}}
    if data[:2] == b"\xff\x4f":
        x1, y1, x0, y0 = struct.unpack(">4I", data[8:24])
        return {**h, "width": x1 - x0, "height": y1 - y0, "n_bands": struct.unpack(">H", data[40:42])[0], "dtype": _whole(data[42])}
    for kind, begin, end in _boxes(data, 0, len(data)):
        if kind == b"jp2h":
            for inner, at, _ in _boxes(data, begin, end):
                if inner == b"ihdr":
                    height, width, n, bits = struct.unpack(">IIHB", data[at : at + 11])
                    h |= {"width": width, "height": height, "n_bands": n, "dtype": _whole(bits) if bits != 255 else None}
        elif kind == b"uuid" and data[begin : begin + 16] == GEO_BOX:
            geo = tiff_header(data[begin + 16 : end])
            h |= {"crs": geo["crs"], "transform": geo["transform"]}
        elif kind == b"jp2c":
            break
    if not h.get("width") or not h.get("height"):
        raise ValueError("no header box")
    return _placed(h)


def _placed(h: dict) -> dict:
    """h with the bounds and the resolution of its transform."""
    if h.get("transform"):
        sx, _, x, _, sy, y = h["transform"]
        w, n = h["width"] * sx, h["height"] * sy
        h |= {"bounds": [min(x, x + w), min(y, y + n), max(x, x + w), max(y, y + n)], "resolution": [abs(sx), abs(sy)]}
    return h


def nitf_header(data: bytes) -> dict:
    """The file's header and its first image's (versions 2.1 and NSIF): fields of fixed places, in ASCII."""
    text = lambda at, n: data[at : at + n].decode("latin-1")
    if int(text(360, 3)) == 0:
        return {"error_kind": "unsupported", "error": "no image"}
    at = int(text(354, 6))
    if text(at, 2) != "IM":
        raise ValueError("no image header")
    bits, where = int(text(at + 368, 2)), text(at + 371, 1)
    kind = {"INT": "uint", "B": "uint", "SI": "int", "R": "float", "C": "complex"}.get(text(at + 349, 3).strip())
    here = at + 372 + (60 if where.strip() else 0)
    here += 1 + 80 * int(text(here, 1))
    here += 2 if text(here, 2) in ("NC", "NM") else 6
    n = int(text(here, 1)) or int(text(here + 1, 5))
    crs = {"G": "EPSG:4326", "D": "EPSG:4326"}.get(where)
    if where in "NS" and where.strip():
        crs = f"EPSG:32{6 if where == 'N' else 7}{int(text(at + 372, 2)):02d}"
    size = next(k for k in (8, 16, 32, 64) if bits <= k)
    tags = {"NITF_FTITLE": text(39, 80).strip(), "NITF_IID1": text(at + 2, 10).strip(), "NITF_IREP": text(at + 352, 8).strip(), "NITF_IC": text(here - 2, 2)}
    h = {"driver": "NITF", "width": int(text(at + 341, 8)), "height": int(text(at + 333, 8)), "n_bands": n, "dtype": kind and f"{kind}{size}", "crs": crs}
    return {**h, "tags": {k: v for k, v in tags.items() if v and k != "NITF_IC"}}


def header(data: bytes) -> dict:
    """Fields of HEADER but the path."""
    try:
        if data[:4] in (b"II*\0", b"MM\0*"):
            h = tiff_header(data)
            if not h["width"] or not h["height"]:
                return {"error_kind": "corrupted", "error": "no size"}
            return h
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            if len(data) < 26:
                return {"error_kind": "corrupted", "error": "cut off"}
            w, h, bits, colour = struct.unpack(">IIBB", data[16:26])
            return {
                "driver": "PNG",
                "width": w,
                "height": h,
                "n_bands": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0),
                "dtype": "uint16" if bits == 16 else "uint8",
                "tags": {},
            }
        if data[:3] == b"\xff\xd8\xff":
            at = 2
            while at + 9 < len(data) and data[at] == 0xFF:
                if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                    h, w, n = struct.unpack(">HHB", data[at + 5 : at + 10])
                    return {"driver": "JPEG", "width": w, "height": h, "n_bands": n, "dtype": "uint8", "tags": {}}
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
            return {"error_kind": "corrupted", "error": "no frame"}
        if data[4:8] == b"jP  " or data[:4] == b"\xff\x4f\xff\x51":
            return jp2_header(data)
        if data[:4] == b"NITF":
            return nitf_header(data)
        known = data[:6] in (b"GIF87a", b"GIF89a") or data[:2] == b"BM" or data[:4] == b"\x89HDF"
        return {"error_kind": "unsupported" if known else "unreadable", "error": "a format that isn't read" if known else "unknown format"}
    except (ValueError, struct.error, IndexError) as e:
        return {"error_kind": "corrupted", "error": str(e)}


def inspect(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SRC1, SRC3: one row of HEADER a file. Only the pages that a header stands in are read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path")

    def one(p: str) -> dict:
        try:
            with Ranged(p) as data:
                return {"path": p, **header(data)}
        except OSError as e:
            return {"path": p, "error_kind": "unreadable", "error": str(e)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HEADER.split(", ")]
        for b in batches:
            rows = pd.DataFrame([one(p) for p in b["path"]], columns=names, dtype=object)
            yield rows.where(rows.notna(), None)

    return files.mapInPandas(run, HEADER)


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first, the width growing one code early."""
    out, table, width, last = [], [], 9, b""
    bits = held = 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            now = table[code]
        else:
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
        out.append(now)
        last = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


class Tiff:
    """A TIFF in strips or tiles, uncompressed, deflated or LZW, with or without horizontal differences; its blocks are read
    one by one, so that data may be Ranged."""

    def __init__(self, data: bytes):
        self.data, (order, f), h = data, tiff_fields(data), tiff_header(data)
        packed, self.planar, self.predictor = f.get(259, [1])[0], f.get(284, [1])[0], f.get(317, [1])[0]
        self.unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress}.get(packed)
        kind = h["dtype"] and np.dtype(h["dtype"]).newbyteorder(order)
        known = self.unpack and kind and self.predictor in (1, 2) and (273 in f or 324 in f)
        if not known or self.predictor == 2 and kind.kind == "f":
            raise ValueError(f"compression {packed}, predictor {self.predictor} or layout isn't supported")
        self.kind, self.n_bands, self.height, self.width = kind, h["n_bands"], h["height"], h["width"]
        self.tiled = 324 in f
        self.w, self.h = (f[322][0], f[323][0]) if self.tiled else (self.width, min(f.get(278, [self.height])[0], self.height))
        self.across, self.down = -(-self.width // self.w), -(-self.height // self.h)
        self.starts, self.sizes = (f[324], f[325]) if self.tiled else (f[273], f[279])
        if len(self.starts) < (self.n_bands if self.planar == 2 else 1) * self.across * self.down:
            raise ValueError("parts are missing")

    def places(self) -> Iterator[tuple[int, int, int, int]]:
        """(y0, x0, lines, columns) of the blocks in order."""
        for k in range(self.across * self.down):
            y, x = k // self.across * self.h, k % self.across * self.w
            yield y, x, min(self.h, self.height - y), min(self.w, self.width - x)

    def block(self, k: int, bands: list[int]) -> np.ndarray:
        """(bands, lines, columns) of block k, bands from 1. Bands in planes of their own are read alone."""
        y, x = k // self.across * self.h, k % self.across * self.w
        deep = 1 if self.planar == 2 else self.n_bands
        lines = self.h if self.tiled else min(self.h, self.height - y)
        out = []
        for plane in [b - 1 for b in bands] if self.planar == 2 else [0]:
            at = plane * self.across * self.down + k
            raw = self.unpack(self.data[self.starts[at] : self.starts[at] + self.sizes[at]])
            part = np.frombuffer(raw, self.kind, lines * self.w * deep).reshape(lines, self.w, deep).astype(self.kind.newbyteorder("="))
            if self.predictor == 2:
                part = np.cumsum(part, 1, part.dtype)
            out.append(np.moveaxis(part[: self.height - y, : self.width - x], 2, 0))
        return np.concatenate(out) if self.planar == 2 else out[0][[b - 1 for b in bands]]


def tiff_array(data: bytes, bands: list[int] | None = None) -> np.ndarray:
    """(bands, height, width) of a TIFF; the bands asked for, from 1."""
    t = Tiff(data)
    bands = bands or list(range(1, t.n_bands + 1))
    out = np.zeros((len(bands), t.height, t.width), t.kind.newbyteorder("="))
    for k, (y, x, h, w) in enumerate(t.places()):
        out[:, y : y + h, x : x + w] = t.block(k, bands)
    return out


#: Bytes of a PNG's lines that are unpacked at once.
PNG_LINES = 4 << 20


def png_blocks(data: bytes, bands: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first line, (bands, lines, width)) of a PNG without interlacing, of 8 or 16 bits, from the top; a palette gives its
    three colours. A stream has no places to begin at, so that it is read from its begin, some lines at a time."""
    at, palette, head = 8, None, None
    unpack, held = zlib.decompressobj(), b""
    above, y = None, 0
    while True:
        entry = data[at : at + 8]
        if len(entry) < 8:
            raise ValueError("cut off")
        size, kind = struct.unpack(">I4s", entry)
        if at + 8 + size > len(data):
            raise ValueError("cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + size])
            if head[2] not in (8, 16) or head[6]:
                raise ValueError("interlaced, or bits that aren't supported")
            width, height, bits, colour = head[:4]
            n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
            step = n * bits // 8
            above = np.zeros((width + 1) * step, np.uint8)
        elif kind == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3)
        elif kind == b"IEND":
            break
        elif kind == b"IDAT":
            if head is None or colour == 3 and palette is None:
                raise ValueError("no header or palette")
            packed = data[at + 8 : at + 8 + size]
            while packed:
                held += unpack.decompress(packed, PNG_LINES)
                packed = unpack.unconsumed_tail
                lines = min(len(held) // (width * step + 1), height - y)
                if lines:
                    raw = np.frombuffer(held, np.uint8, lines * (width * step + 1)).reshape(lines, -1)
                    held = held[raw.size :]
                    flat, above = _unfiltered(raw, above, step)
                    yield y, _png_samples(flat, width, n, bits, palette if colour == 3 else None, bands)
                    y += lines
        at += 12 + size
    if head is None or y < height:
        raise ValueError("cut off")


def _unfiltered(raw: np.ndarray, above: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines whose first byte says what is taken from each byte: nothing, the left, the one above, their mean, or the nearest
    of them and the corner. above has a pixel of zeros on the left, as what is given for the next lines has."""
    size = raw.shape[1] - 1
    lines = np.zeros((len(raw) + 1, size + step), np.uint8)
    lines[0] = above
    for y in range(len(raw)):
        how, line, up, now = raw[y, 0], raw[y, 1:], lines[y], lines[y + 1]
        if how == 0:
            now[step:] = line
        elif how == 1:
            now[step:] = np.cumsum(line.reshape(-1, step), 0, np.uint8).ravel()
        elif how == 2:
            now[step:] = line + up[step:]
        else:
            left, over, value = now.tolist(), up.tolist(), line.tolist()
            for i in range(size):
                a, b, c = left[i], over[i + step], over[i]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                left[i + step] = (value[i] + guess) & 255
            now[:] = left
    return np.ascontiguousarray(lines[1:, step:]), lines[-1]


def _png_samples(flat: np.ndarray, width: int, n: int, bits: int, palette: np.ndarray | None, bands: list[int] | None) -> np.ndarray:
    a = (flat.view(">u2").astype(np.uint16) if bits == 16 else flat).reshape(len(flat), width, n)
    a = np.moveaxis(a if palette is None else palette[a[..., 0]], 2, 0)
    return a if bands is None else a[[b - 1 for b in bands]]


def png_array(data: bytes, bands: list[int] | None = None) -> np.ndarray:
    """(bands, height, width) of a PNG."""
    return np.concatenate([a for _, a in png_blocks(data, bands)], axis=1)


def array_of(data: bytes, bands: list[int] | None = None) -> np.ndarray:
    """The samples of a TIFF or PNG; ValueError for others (a JPEG needs a codec)."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return png_array(data, bands)
    return tiff_array(data, bands)
