"""FLT18. Which texts hold which passages, for any number of either: a passage is looked for by its rarest gram.

Two scans of the texts meet the passages by hashes alone. The first counts, of all passages' grams of K code points, how
often each is met, so that a passage's seed is the gram that the texts have least; one that they don't have at all rules its
passage out. The second gives each text's seeds, which an equi-join turns into candidates, and the candidates' texts are
looked at. What is sent to all tasks is a filter of fixed size, a bit for each gram that is looked for; it never misses one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written

#: Code points in a gram; a shorter passage is a gram of its own length.
K = 16
FILTER_BITS = 1 << 27
#: Rows of seeds, or of candidates, that are broadcast at most; some 40 bytes each. Beyond, they meet by a shuffle.
MAX_BROADCAST = 200_000
#: Code points of a text whose grams stand in memory at once.
SLICE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash modulo 2^64 of each run of k code points, spread over all bits: runs of 1, 2, 4, ... are put together."""
    if len(points) < k:
        return np.zeros(0, np.uint64)
    n = len(points) - k + 1
    power, run, length = _BASE, points.astype(np.uint64) + np.uint64(1), 1
    out, done, at = np.zeros(n, np.uint64), 0, k
    with np.errstate(over="ignore"):
        while at:
            if at & 1:
                # The runs so far are moved up by what stands behind them.
                out = out * power + run[done : done + n]
                done += length
            at >>= 1
            if at:
                run = run[:-length] * power + run[length:]
                power, length = power * power, 2 * length
        out = (out ^ np.uint64(k)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(len(bits) * 64)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _found(text: str, lengths: list[int], bits: np.ndarray) -> np.ndarray:
    """The grams' hashes of a text that the filter lets through, each as often as it is met."""
    points, out = _points(text), []
    for k in lengths:
        for at in range(0, max(len(points) - k + 1, 0), SLICE):
            h = gram_hashes(points[at : at + SLICE + k - 1], k)
            out.append(h[_hits(bits, h)])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, k, hash) of all grams of the passages."""
    for b in batches:
        for item, passage in zip(b.column("item_id").to_pylist(), b.column("passage").to_pylist()):
            points = _points(passage)
            k = min(K, len(points))
            h = np.unique(gram_hashes(points, k))
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(h), pa.int64()), pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64))], ["item_id", "k", "hash"]
            )


def _filter(hashes: DataFrame, n_bits: int):
    """A broadcast array of n_bits bits, those of the hashes set; at most n_bits / 64 rows come to the driver."""
    at = F.pmod(F.expr(f"(hash & {n_bits - 1}L)"), F.lit(n_bits))  # n_bits is a power of two, so that the low bits do
    rows = hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast((hash & {n_bits - 1}L) & 63 as int))").alias("bit"))
    rows = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _counting(lengths: list[int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [_found(x.as_py(), lengths, bits.value) for x in b.column("text")]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *h]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return run


def _seeking(lengths: list[int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column("row").to_pylist(), b.column("text")):
                h = np.unique(_found(text.as_py(), lengths, bits.value))
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row, np.int64)), pa.array(h.view(np.int64))], ["row", "hash"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """df, a written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def seeds(texts: DataFrame, passages: DataFrame, *, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, list[int]]:
    """(item_id, hash, n): each passage's gram that the texts have least, and how often; passages with a gram that no text
    has are left out. Also the grams' lengths, K and those of shorter passages. texts: text; passages: item_id, passage."""
    grams = written(passages.select("item_id", "passage").mapInArrow(_grams, "item_id long, k int, hash long"), "grams")
    lengths = sorted(r["k"] for r in grams.select("k").distinct().collect())  # K of them at most
    bits = _filter(grams, filter_bits)
    counts = texts.select("text").mapInArrow(_counting(lengths, bits), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    bits.unpersist()
    met = grams.join(counts, "hash", "left").select("item_id", "hash", F.coalesce("n", F.lit(0)).alias("n"))
    least = met.groupBy("item_id").agg(F.min(F.struct("n", "hash")).alias("s"))
    return written(least.where("s.n > 0").select("item_id", "s.hash", "s.n"), "seeds"), lengths


def leaks(samples: DataFrame, frozen: DataFrame, *, filter_bits: int = FILTER_BITS) -> DataFrame:
    """FLT18: doc_id, item_id of each sample (doc_id, text) whose text holds a frozen passage (item_id, passage).

    A null text or passage holds nothing and is held by nothing; an empty passage is in every text; repeated samples, and
    passages, are rows of their own. Neither texts nor passages come to the driver."""
    key = F.xxhash64("doc_id", "text")
    rows = samples.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", key)
    # Equal passages are one while they are looked for.
    given = frozen.where("passage is not null").select(F.col("item_id").cast("long").alias("of"), "passage")
    given = written(given.withColumn("item_id", F.xxhash64("passage")), "passages")
    one = given.where("passage <> ''").dropDuplicates(["item_id", "passage"])
    found, lengths = seeds(rows, one, filter_bits=filter_bits)
    bits = _filter(found, filter_bits)
    hits = rows.select("row", "text").mapInArrow(_seeking(lengths, bits), "row long, hash long")
    pairs = written(hits.join(_few(found.select("hash", "item_id")), "hash").select("row", "item_id").distinct(), "candidates")
    bits.unpersist()
    there = rows.join(_few(pairs), "row").join(_few(written(given.where("passage <> ''"), "given")), "item_id")
    held = there.where(F.contains("text", "passage")).select("doc_id", F.col("of").alias("item_id"))
    empty = given.where("passage = ''").select(F.col("of").alias("item_id"))
    if empty.limit(1).count():
        every = rows.select("doc_id").join(F.broadcast(empty.agg(F.collect_list("item_id").alias("items"))))
        held = held.union(every.select("doc_id", F.explode("items").alias("item_id")))
    return held
