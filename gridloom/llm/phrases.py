"""Collocations: n-gram counts from word-id suffix arrays of shards, merged by key, scored by their weakest cut.

A phrase that is met `min_count` times has words and word pairs that are, too. So three passes count words, then pairs of
frequent words, then longer phrases of frequent pairs; between them a filter of fixed size (FILTER_BITS) goes to all tasks,
a bit for each frequent word or pair. It never misses one, and what it lets through beyond them is counted and then cut by
its true count, so that results don't depend on its size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from . import common as C

#: Words in a shard, each of which has its own suffix array; about 60 bytes of arrays a word stand in memory.
SHARD_WORDS = 3 << 19
#: Texts that go to a worker at once.
TEXTS_AT_ONCE = 2_000
#: Pieces of more bytes are taken as runs of RUN_WORDS words, which overlap by what a phrase may reach.
LONG_PIECE, RUN_WORDS = 1 << 20, 1 << 16
FILTER_BITS = 1 << 27
ROWS_PER_BATCH = 50_000

# The characters that end a piece.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_ONE_SEPARATOR = bytes.maketrans(SEPARATORS, b"\n" * len(SEPARATORS))
_WORD = re.compile(rb"[^ \t]+")


def runs(text: str, overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text's pieces, and how many of the last ones begin the next run again: 0 but in a long piece."""
    for piece in text.encode("utf-8", "surrogatepass").lower().translate(_ONE_SEPARATOR).split(b"\n"):
        if len(piece) <= LONG_PIECE:
            words = piece.split()
            if words:
                yield words, 0
            continue
        words = []
        for m in _WORD.finditer(piece):
            words.append(m.group())
            if len(words) == RUN_WORDS:
                yield words, overlap
                words = words[len(words) - overlap :]
        if words:
            yield words, 0


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of word ids in order of their first `depth` words at least, by prefix doubling. left: how many words
    a suffix has before its run ends; a shorter one stands before those that go on from it."""
    rank, d = ids, 1
    while d < depth:
        key = rank * np.int64(rank.max(initial=0) + 2)
        on = np.flatnonzero(left > d)
        key[on] += rank[on + d] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
        d *= 2
    return np.argsort(rank, kind="stable").astype(np.int32)


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words each suffix in order shares with the one before it, `depth` at most; the first shares none."""
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    both = np.minimum(left[a], left[b])
    same = np.ones(len(a), bool)
    for k in range(depth):
        same &= both > k
        at = np.flatnonzero(same)
        same[at] = ids[a[at] + k] == ids[b[at] + k]
        lcp[1:] += same
    return lcp


def gram_counts(ids: np.ndarray, goes_on: np.ndarray, own: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, where a phrase of m words is met, how often) for all distinct phrases of low to high words: the intervals of
    suffixes that share m words. goes_on: a phrase may reach from a word to the one after it; own: it may begin there."""
    n, at = len(ids), np.arange(len(ids), dtype=np.int32)
    left = np.minimum.accumulate(np.where(goes_on, np.int32(n), at)[::-1])[::-1] - at + 1
    begins = np.flatnonzero(np.concatenate([[True], ~goes_on[:-1]]))
    # Runs of fewer than low words hold no phrase, and nothing needs their order.
    at = np.flatnonzero(np.repeat(left[begins] >= low, np.diff(begins, append=n)))
    ids, left, own = ids[at], left[at], own[at]
    order = suffix_array(ids, left, high)
    order = order[own[order] & (left[order] >= low)]
    lcp = common_prefixes(ids, left, order, high)
    for m in range(low, high + 1):
        has = left[order] >= m
        first = has & (lcp < m)
        yield m, at[order[first]], np.bincount(np.cumsum(first)[has], minlength=1)[1:]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\x00" + word)


def _hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(len(bits) * 64)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class _Vocabulary(dict):
    """word -> its number in the shard, given when first asked for."""

    def __init__(self, words: list[bytes]):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class _Shard:
    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.of_lang: dict[str, _Vocabulary] = {}
        self.parts: list[np.ndarray] = []
        self.ends: list[int] = []
        self.again: list[int] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes], again: int) -> None:
        vocabulary = self.of_lang.get(lang)
        if vocabulary is None:
            vocabulary = self.of_lang[lang] = _Vocabulary(self.words)
        self.parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        self.langs += [lang] * (len(self.words) - len(self.langs))
        self.size += len(words)
        self.ends.append(self.size)
        self.again.append(again)

    def counts(self, low: int, high: int, words: np.ndarray | None, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ids = np.concatenate(self.parts)
        ends, again = np.array(self.ends), np.array(self.again)
        goes_on, own = np.ones(len(ids), bool), np.ones(len(ids), bool)
        goes_on[ends - 1] = False
        for e, k in zip(ends[again > 0].tolist(), again[again > 0].tolist()):
            own[e - k : e] = False
        if words is not None:
            h = np.fromiter(map(_word_hash, self.langs, self.words), np.uint64, len(self.words))
            known = _hits(words, h)
            goes_on[:-1] &= known[ids[:-1]] & known[ids[1:]]
            if pairs is not None:
                at = np.flatnonzero(goes_on)
                goes_on[at] = _hits(pairs, _pair_hash(h[ids[at]], h[ids[at + 1]]))
        names, langs = pa.array(self.words, pa.binary()), pa.array(self.langs, pa.string()).dictionary_encode()
        for m, heads, n in gram_counts(ids, goes_on, own, low, high):
            for i in range(0, len(heads), ROWS_PER_BATCH):
                part = heads[i : i + ROWS_PER_BATCH]
                grams = [names.take(pa.array(ids[part + k])) for k in range(m)]
                phrase = pc.binary_join_element_wise(*grams, b" ").cast(pa.string())
                lang = langs.take(pa.array(ids[part])).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [lang, phrase, pa.array(np.full(len(part), m, np.int32)), pa.array(n[i : i + ROWS_PER_BATCH].astype(np.int64))],
                    ["lang", "phrase", "m", "a"],
                )


def _counting(low: int, high: int, shard_words: int, words=None, pairs=None):
    """words, pairs: broadcast filters, or None for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [None if x is None else x.value for x in (words, pairs)]
        shard = _Shard()
        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text")):
                lang = lang.as_py()
                for found, again in runs(text.as_py(), high - 1):
                    shard.add(lang, found, again)
                    if shard.size >= shard_words:
                        yield from shard.counts(low, high, *filters)
                        shard = _Shard()
        yield from shard.counts(low, high, *filters)

    return run


def _bits(n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = []
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist()):
                h.append([_word_hash(lang, w) for w in phrase.encode().split(b" ")])
            h = np.array(h, np.uint64)
            at = (h[:, 0] if h.shape[1] == 1 else _pair_hash(h[:, 0], h[:, 1])) % np.uint64(n_bits)
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bit"])

    return run


def _filter(frequent: DataFrame, n_bits: int):
    """A broadcast array of n_bits bits, those of the frequent phrases set; at most n_bits / 64 rows come to the driver."""
    rows = frequent.select("lang", "phrase").mapInArrow(_bits(n_bits), "word long, bit long")
    rows = rows.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(out)


def phrase_counts(
    docs: DataFrame,
    *,
    min_count: int = 100,
    max_words: int = 5,
    lang_col: str = "lang",
    text_col: str = "text",
    shard_words: int = SHARD_WORDS,
    filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, a) of all phrases of 1 to max_words words met min_count times or more, m being their words, and
    (lang, n), the word occurrences. Written tables.

    Null text is empty; a null lang is `und`; repeated rows count each; a text of any length, also one without
    separators, is taken in parts; an empty table gives no rows; other columns are ignored."""
    C.require(docs, lang_col, text_col)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), C.texts(docs, text_col).alias("text"))

    def counted(name: str, *how) -> DataFrame:
        each = rows.mapInArrow(_counting(*how), "lang string, phrase string, m int, a long")
        counts = each.groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a")).where(F.col("a") >= (min_count if how[0] > 1 else 1))
        return C.written_by(counts, name, TEXTS_AT_ONCE)

    words = counted("words", 1, 1, shard_words)
    totals = C.written(words.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    found = words.where(F.col("a") >= min_count)
    if max_words > 1:
        known = _filter(found, filter_bits)
        pairs = counted("pairs", 2, 2, shard_words, known)
        found = found.union(pairs)
        if max_words > 2:
            both = _filter(pairs, filter_bits)
            found = found.union(counted("phrases", 3, max_words, shard_words, known, both))
            both.unpersist()
        known.unpersist()
    return C.written(found, "counts"), totals


def _part(words: str, start: Column, length: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, start, length))


def scored(counts: DataFrame, totals: DataFrame, scale: int = 1000) -> DataFrame:
    """lang, phrase, m, a, l, r, n, score of the phrases of two words and more: of all cuts the one that scores least, then
    the first. Scores are exact while scale * a * n has 38 digits at most."""
    cuts = counts.where("m > 1").withColumn("ws", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "m", "a", "k", _part("ws", F.lit(1), F.col("k")).alias("first"), _part("ws", F.col("k") + 1, F.col("m") - F.col("k")).alias("rest")
    )
    of = lambda key, count: counts.select("lang", F.col("phrase").alias(key), F.col("a").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals), "lang")
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast({scale} as decimal(9, 0)) * {exact('a')} * {exact('n')} div ({exact('l')} * {exact('r')})")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "m", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "m", "a", "cut.l", "cut.r", "n", "cut.score")


def not_within_longer(phrases: DataFrame, share: int = 100) -> DataFrame:
    """phrases (lang, phrase, m, a) without those inside a longer one of the table that is met `share` per cent as often.

    What lies inside a longer phrase lies inside one of a word more that is met no less often, so those alone are looked at."""
    ws = F.split("phrase", " ")
    inside = phrases.where("m > 2").select(
        "lang", "a", F.explode(F.array(F.concat_ws(" ", F.slice(ws, F.lit(1), F.col("m") - 1)), F.concat_ws(" ", F.slice(ws, F.lit(2), F.col("m") - 1)))).alias("phrase")
    )
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    out = phrases.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("a")))
    return out.drop("longer")


def collocations(docs: DataFrame, *, top: int = 2000, share: int = 100, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, then count, then code points.

    a is how often the phrase is met, overlaps included, l and r its two parts at the cut that scores least, n all words
    of the language; see phrase_counts for nulls, repeats and empty tables."""
    counts, totals = phrase_counts(docs, **options)
    kept = C.written(not_within_longer(scored(counts, totals), share), "scored")
    # Ranks over all languages, less those of the languages before: a language's phrases are dealt to many tasks.
    rows = C.written(ranked(kept, F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")), "ranked")
    before = rows.groupBy("lang").agg((F.min("rank") - 1).alias("before"))
    rows = rows.join(F.broadcast(before), "lang").withColumn("rank", F.col("rank") - F.col("before")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
