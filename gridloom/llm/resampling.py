"""Importance resampling towards a target distribution of hashed word n-grams.

The bucket of an n-gram is the CRC-32 of its bytes, and CRC-32 is linear over GF(2): with Z the map that one more zero byte
is, crc(a b) = Z^len(b) crc(a) ^ crc(b). So each word's CRC is worked out once, those of n-grams are composed of them by
matrices for lengths of 1, 2, 4, ... bytes, and no n-gram is ever written out."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from . import common as C

#: Words of a block, whose arrays stand in memory at once, bytes of text split into words at once, and words whose CRC a
#: worker remembers.
BLOCK_WORDS, SLICE, MEMORY = 1 << 19, 1 << 20, 400_000
#: Buckets, and words in the longest n-gram.
BUCKETS, LONGEST = 10_000, 2

#: What becomes of each byte: A-Z are lowered, a-z, 0-9 and all bytes of other characters stay, the rest separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Fixed value: the polynomial of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320


def _tables() -> list[np.ndarray]:
    """For each k the map of 2^k zero bytes, as four tables of 256: what each byte of a CRC adds to the result."""

    def zero_byte(x: int) -> int:
        for _ in range(8):
            x = (x >> 1) ^ (POLYNOMIAL if x & 1 else 0)
        return x

    columns, out = np.array([zero_byte(1 << j) for j in range(32)], np.uint32), []
    for _ in range(32):
        table = np.zeros((4, 256), np.uint32)
        for j in range(32):
            on = (np.arange(256) >> (j % 8)) & 1 == 1
            table[j // 8, on] ^= columns[j]
        out.append(table)
        columns = _apply(table, columns)
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0, crc & 255]
    for k in range(1, 4):
        out = out ^ table[k, (crc >> np.uint32(8 * k)) & 255]
    return out


ZEROS = _tables()
BLANK = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs moved on by so many zero bytes each."""
    out = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = np.flatnonzero((lengths >> k) & 1)
        out[on] = _apply(ZEROS[k], out[on])
    return out


def gram_crcs(crc: np.ndarray, lengths: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For n = 1, 2, ... the CRCs of all runs of n words joined by a blank."""
    gram = crc
    yield gram
    for n in range(2, longest + 1):
        gram = shifted(_apply(ZEROS[0], gram[:-1]) ^ BLANK, lengths[n - 1 :]) ^ crc[n - 1 :]
        yield gram


class _Crcs(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = crc = zlib.crc32(word)
        return crc


def _word_lists(text: str) -> Iterator[list[bytes]]:
    data = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    at = 0
    while len(data) - at > SLICE:
        end = data.find(b" ", at + SLICE)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


class _Block:
    """Words of several texts, and of parts of texts; what a text's part ends with is carried to its next one."""

    def __init__(self, longest: int):
        self.longest, self.known = longest, _Crcs()
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = []
        self.owners: list[int] = []
        self.sizes: list[int] = []
        self.carried = 0

    def add(self, owner: int, words: list[bytes]) -> None:
        self.words += words
        self.owners.append(owner)
        self.sizes.append(len(words))

    def carry(self, owner: int) -> None:
        """Begin anew with the last words of a text that goes on."""
        own = sum(n for n, o in zip(self.sizes, self.owners) if o == owner)
        words = self.words[len(self.words) - min(self.longest - 1, own) :]
        self.clear()
        self.add(owner, words)
        self.carried = len(words)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(owner, crc) of the n-grams of each n; those wholly of carried words were given before."""
        crc = np.fromiter(map(self.known.__getitem__, self.words), np.uint32, len(self.words))
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        owner = np.repeat(np.array(self.owners, np.int64), np.array(self.sizes, np.int64))
        for n, gram in enumerate(gram_crcs(crc, lengths, self.longest), 1):
            of, last = owner[: len(owner) - n + 1], owner[n - 1 :]
            keep = of == last
            keep[: max(0, self.carried - n + 1)] = False
            yield of[keep], gram[keep]


def _blocks(texts: Iterator[str], longest: int) -> Iterator[_Block]:
    block = _Block(longest)
    for owner, text in enumerate(texts):
        for words in _word_lists(text):
            block.add(owner, words)
            if len(block.words) >= BLOCK_WORDS:
                yield block
                block.carry(owner)
    yield block


def _counting(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for block in _blocks((x.as_py() for b in batches for x in b.column("text")), longest):
            for _, crc in block.features():
                n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, *, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task gives a row a bucket at most, and so many come to the driver."""
    C.require(texts, text_col)
    rows = texts.select(C.texts(texts, text_col).alias("text")).mapInArrow(_counting(buckets, longest), "bucket long, n long")
    rows = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the raw corpus, floored."""
    all_raw, all_target, k = int(raw.sum()), int(target.sum()), len(raw)
    ratio = lambda s, t: float(t + 1) * float(all_raw + k) / (float(s + 1) * float(all_target + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def _weighing(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n, total = (np.zeros(len(b), np.int64) for _ in range(3))
            for block in _blocks((x.as_py() for x in b.column("text")), longest):
                for k, (owner, crc) in enumerate(block.features()):
                    met = np.bincount(owner, minlength=len(b))
                    n += met
                    n_words += met if k == 0 else 0
                    # Sums of whole numbers below 2^53 are exact.
                    total += np.bincount(owner, gain[crc % np.uint32(len(gain))], minlength=len(b)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(x) for x in (n_words, n, weight)]], ["doc_id", "n_words", "n_features", "weight"]
            )

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 25,
    min_words: int = 20,
    seed: str = "7",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the documents with min_words words `percent` per cent are drawn, those of
    the greatest score, which is the mean gain of a document's features plus Gumbel noise of its id and the seed; ties go
    to the smaller id, a null one, whose text is `null`, before all. rank is null where a document isn't drawn.

    Null and empty texts have no feature and weight 0; repeated rows are each drawn or not; an empty target leaves the
    smoothing alone; an empty table gives no rows; other columns are ignored. Plan: two scans of the texts, of which one
    shuffles bucket counts, and one shuffle of numbers by ranges of the score."""
    C.require(docs, id_col, text_col)
    gain = gains(
        bucket_counts(docs, text_col=text_col, buckets=buckets, longest=longest),
        bucket_counts(target, text_col=target_text_col, buckets=buckets, longest=longest),
    )
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), C.texts(docs, text_col).alias("text"))
    rows = rows.mapInArrow(_weighing(gain, longest), "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = C.written(rows.withColumn("score", F.col("weight") + noise).withColumn("few", F.col("n_words") < min_words), "scored")
    drawn = rows.where("not few").count() * percent // 100
    out = ranked(rows, F.asc("few"), F.desc("score"), F.asc_nulls_first("doc_id"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
