"""Collocations, importance resampling and wordpieces against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
import public_tokenizers as P  # noqa: E402

from gridloom.llm import phrases as PH  # noqa: E402
from gridloom.llm import resampling as RS  # noqa: E402
from gridloom.llm import wordpieces as WP  # noqa: E402

SF = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")
rng = random.Random(11)
TYPE = "doc_id long, text string, lang string, phrase string, rank int, row int, ids string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def table(spark, rows, parts=3):
    """Rows (doc_id, text, lang) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], TYPE).repartition(parts)


# --- collocations ---


def brute_collocations(rows, min_count, top, max_words=5, share=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, max_words + 1):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and inside(q) and 100 * b >= share * a for q, b in found.items()):
                continue
            s, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), l, r))
        kept.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(kept[:top])]
    return sorted(out)


def phrase_rows():
    words = "New York Times der die das über ÄB naïve 東京 a b".split()
    common = ["new york times today", "the der die das, über naïve", "a a a a a a a", "東京 東京 x. 東京 東京 x"]
    rows = []
    for i in range(120):
        body = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        body = rng.choice([" ", "\t", ". ", "\n"]).join([body, rng.choice(common)])
        rows.append((i, body, rng.choice(["en", "en", "en", "de", None, "und"])))
    long = " ".join(rng.choice(words) for _ in range(3000))
    return [*rows, (200, long, "en"), (201, long, "en"), (201, long, "en"), (202, "", "en"), (203, None, "de"), (204, " \t ", "xx"), (None, "new york", None)]


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"filter_bits": 64}, {"filter_bits": 1 << 20, "shard_words": 9}, {"share": 60, "top": 5}, {"max_words": 3}])
def test_collocations_against_brute_force(spark, options, monkeypatch):
    rows = phrase_rows()
    # Pieces of more than 200 bytes are taken in runs, so that phrases cross their cuts.
    monkeypatch.setattr(PH, "LONG_PIECE", 200)
    monkeypatch.setattr(PH, "RUN_WORDS", 40)
    got = PH.collocations(table(spark, rows), min_count=12, **{"top": 2000, **options})
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in got.dtypes} == {"string", "bigint"}
    brute = {k: v for k, v in options.items() if k in ("share", "top", "max_words")}
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 12, **{"top": 2000, **brute})


def test_runs_overlap_by_what_a_phrase_may_reach(monkeypatch):
    monkeypatch.setattr(PH, "LONG_PIECE", 20)
    monkeypatch.setattr(PH, "RUN_WORDS", 6)
    for n in range(1, 40):
        shard, ws = PH._Shard(), [b"w%d" % rng.randrange(3) for _ in range(n)]
        for found, again in PH.runs(b" ".join(ws).decode() + " " * 20, 4):
            shard.add("en", found, again)
        got = Counter()
        for b in shard.counts(1, 5, None, None):
            got.update(dict(zip(b.column("phrase").to_pylist(), b.column("a").to_pylist())))
        want = Counter(b" ".join(ws[i : i + m]).decode() for m in range(1, 6) for i in range(n - m + 1))
        assert got == want


def test_suffix_array_orders_suffixes():
    ids = np.array([rng.randrange(3) for _ in range(200)], np.int64)
    left = 200 - np.arange(200)
    order = PH.suffix_array(ids, left, 256).tolist()
    assert order == sorted(range(200), key=lambda i: ids[i:].tolist())
    lcp = PH.common_prefixes(ids, left, np.array(order), 8)
    for k in range(1, 200):
        a, b = ids[order[k - 1] :].tolist(), ids[order[k] :].tolist()
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(same, 8)


def test_scores_are_exact_beyond_64_bits(spark):
    big, n = 3_000_000_000_000_001, 7_000_000_000_000_003
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 2), ("en", "a b", 2, big - 5)], "lang string, phrase string, m int, a long")
    got = PH.scored(counts, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert [r["score"] for r in got] == [1000 * (big - 5) * n // (big * (big - 2))]


def test_collocations_of_an_empty_table(spark):
    assert PH.collocations(table(spark, [])).collect() == []
    assert PH.collocations(table(spark, [(1, None, None), (2, "", "en")]), min_count=1).collect() == []


# --- resampling ---

R_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, target, percent=25, min_words=20):
    def features(text):
        ws = R_WORD.findall(lower(text or ""))
        return ws, [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10000 for n in (1, 2) for i in range(len(ws) - n + 1)]

    s, t = Counter(), Counter()
    for _, x, _ in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for i, x, _ in docs:
        ws, fs = features(x)
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in out], key=str)


def test_composed_crcs_are_those_of_the_strings():
    words = [rng.randbytes(rng.choice([0, 1, 2, 7, 8, 31, 300, 5000])) for _ in range(300)]
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    for n, grams in enumerate(RS.gram_crcs(crc, np.array([len(w) for w in words]), 4), 1):
        assert grams.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("small", [False, True])
def test_resampling_against_brute_force(spark, small, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    docs += [(1001, None, "en"), (1002, "", "en"), (1003, "--- ?? \n", "en"), (1004, "One", None), (1005, "ÉCOLE été 12a\x00b_c " * 30, "fr")]
    docs += [(1006 + i, docs[3][1], "en") for i in range(5)]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None]
    if small:
        # Texts are cut into blocks and slices, over which the last word is carried.
        monkeypatch.setattr(RS, "BLOCK_WORDS", 7)
        monkeypatch.setattr(RS, "SLICE", 40)
        docs = docs[:12] + docs[-10:]
    got = RS.resample(table(spark, docs), spark.createDataFrame([(x,) for x in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, target)


def test_blocks_with_longer_grams():
    text = " ".join(f"w{rng.randrange(9)}" for _ in range(400))
    ws = text.split()
    want = Counter(zlib.crc32(" ".join(ws[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(ws) - n + 1))
    for size in (3, 5, 64, 1000):
        RS.BLOCK_WORDS, before, RS.SLICE, slice_ = size, RS.BLOCK_WORDS, 20, RS.SLICE
        try:
            got = Counter(c for b in RS._blocks(iter([text, "", text]), 3) for _, crc in b.features() for c in crc.tolist())
        finally:
            RS.BLOCK_WORDS, RS.SLICE = before, slice_
        assert got == want + want


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    one = "some words that stand here again and again until there are more than twenty of them in the text as asked for"
    rows = [(None, one, "en")] * 50 + [(7, one, "en")] * 50
    out = RS.resample(table(spark, rows), spark.createDataFrame([], "text string"), percent=30).collect()
    assert len(out) == 100 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 31))
    assert len({r["doc_id"] for r in out if r["rank"]}) == 1
    assert RS.resample(table(spark, []), spark.createDataFrame([], "text string")).collect() == []


# --- wordpieces ---


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_wordpieces_equal_the_librarys(library):
    enc = WP.PieceEncoder(MODEL)
    letters = list("abcdeé tthing  ▁\t\nΩжあ中😀\x00ﬁ<s></s>0x41., \U0001f9ffinterationes   ")
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    for i in range(6000):
        s = "".join(rng.choice(letters if i % 2 else pieces) for _ in range(rng.randrange(0, 30 if i % 2 else 9)))
        s = s.replace(" ", "") if i % 3 == 0 else s
        ids = enc.ids(s).tolist()
        assert ids == library.encode(s), s
        assert enc.decode(ids) == library.decode(ids)


def test_prefix_table_equals_merging(library):
    enc = WP.PieceEncoder(MODEL)
    for _ in range(3000):
        chunk = "".join(rng.choice("▁▁aeionrstdl") for _ in range(rng.randrange(1, 25)))
        assert [enc.pieces[i] for i in enc.chunk_ids(chunk)] == enc.merged(chunk)


def test_wordpieces_of_texts_in_slices_and_with_small_memories(library, monkeypatch):
    monkeypatch.setattr(WP, "SLICE", 50)
    monkeypatch.setattr(WP, "PAIRS", 20)
    monkeypatch.setattr(WP, "CHUNKS", 5)
    enc = WP.PieceEncoder(MODEL)
    for s in ["ab" * 5000, "word " * 999, " " * 3000 + "x", "中文字" * 400, "".join(rng.choice("abc d") for _ in range(4000))]:
        assert enc.ids(s).tolist() == library.encode(s)


def test_wordpieces_of_a_table(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    docs += [(None, "a", None), (1, None, "x"), (1, "", "x"), (2, "same", "x"), (2, "same", "x"), (9003, "long one " * 40000, None)]
    enc = WP.encode_pieces(table(spark, docs), MODEL)
    want = []
    for i, text, _ in docs:
        ids = library.encode(text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, WP.piece_digests(enc).collect()), key=str) == sorted(want, key=str)
    assert enc.where("doc_id = 9003").first()["decoded"] == "long one " * 40000
    assert WP.encode_pieces(table(spark, []), MODEL).collect() == []
