"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bounds of the sample that the network is fitted on: rows of each label with the lowest hash of their id.
MAX_TOXIC, MAX_CLEAN = 1_000, 2_000
#: Words in a window, and from one window's start to the next one's; neighbours overlap.
WINDOW, STRIDE = 32, 24
#: Words known as such, hashed trigrams of characters, and the sizes of both inputs, of a direction's state and of the attention.
MAX_VOCAB, TRIGRAMS = 20_000, 1 << 13
D_WORD, D_CHAR, HIDDEN, D_ATTEND = 8, 8, 8, 8
#: A worker remembers so many words' projected inputs; windows scored at once.
MEMORY, AT_ONCE = 150_000, 4_096
#: Words of a long text that are taken at once.
PART = 1_000 * STRIDE

_find = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    return _find(text.lower())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of characters of all words, one centred on each character, and each word's first."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    mix = (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) * 2654435761 % (1 << 32) % TRIGRAMS
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    inside = codes[1:-1] != 32
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    assert len(starts) == len(words)
    return mix[inside], first


class Network:
    """Inputs: a known word's vector (zero for others) beside the mean of its trigrams' vectors. Both directions' gated
    units read a window; attention weighs the positions; one logit comes out. A text's score is its best window's."""

    def __init__(self, vocab: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocab = vocab
        d, h = D_WORD + D_CHAR, HIDDEN
        self.p = {
            "word": (0.1 * rng.standard_normal((len(vocab) + 1, D_WORD))).astype(np.float32),
            "char": (0.1 * rng.standard_normal((TRIGRAMS, D_CHAR))).astype(np.float32),
            "attend": make(2 * h, D_ATTEND),
            "query": make(D_ATTEND),
            "out": make(2 * h),
            "bias": np.zeros(1, np.float32),
        }
        for k in "fb":
            self.p |= {f"W{k}": make(d, 3 * h), f"U{k}": make(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        self.p["word"][0] = 0
        self.scale, self.shift, self.prior = 1.0, 0.0, 0.1

    # Inputs
    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        ids = np.array([self.vocab.get(w, 0) for w in words], np.int64)
        tri, first = trigrams(words)
        n = np.diff(np.append(first, len(tri)))
        chars = np.add.reduceat(self.p["char"][tri], first, axis=0) / n[:, None]
        return np.concatenate([self.p["word"][ids], chars], 1).astype(np.float32), (ids, tri, n)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors @ self.p["Wf"] + self.p["cf"], vectors @ self.p["Wb"] + self.p["cb"]], 1)

    # A batch of windows: inputs (T, B, 6 h), mask (T, B, 1)
    def _direction(self, x: np.ndarray, mask: np.ndarray, k: str, keep: list | None) -> np.ndarray:
        h, u = HIDDEN, self.p[f"U{k}"]
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((x.shape[0], x.shape[1], h), np.float32)
        for t in range(x.shape[0]) if k == "f" else range(x.shape[0] - 1, -1, -1):
            gates = _sigmoid(x[t, :, : 2 * h] + state @ u[:, : 2 * h])
            r, z = gates[:, :h], gates[:, h:] * mask[t]
            new = np.tanh(x[t, :, 2 * h :] + (r * state) @ u[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, r, gates[:, h:], z, new))
            state = state + z * (new - state)
            out[t] = state
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        h = HIDDEN
        kf, kb = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._direction(x[:, :, : 3 * h], mask, "f", kf), self._direction(x[:, :, 3 * h :], mask, "b", kb)], 2)
        tanh = np.tanh(states @ self.p["attend"])
        e = tanh @ self.p["query"] + (mask[:, :, 0] - 1) * 1e4
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        if keep is not None:
            keep.update(f=kf, b=kb, states=states, tanh=tanh, a=a, pooled=pooled)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """The logits, the parameters' gradients of the mean log loss, and the gradient of x."""
        h, keep, p = HIDDEN, {}, self.p
        logit = self.forward(x, mask, keep)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"bias": np.array([d.sum()], np.float32), "out": keep["pooled"].T @ d}
        dpool = d[:, None] * p["out"]
        a, s, tanh = keep["a"], keep["states"], keep["tanh"]
        da = np.einsum("bh,tbh->tb", dpool, s)
        de = a * (da - (a * da).sum(0))
        dtanh = de[:, :, None] * p["query"] * (1 - tanh**2)
        g["query"] = np.einsum("tb,tbk->k", de, tanh)
        g["attend"] = np.einsum("tbh,tbk->hk", s, dtanh)
        ds = a[:, :, None] * dpool + dtanh @ p["attend"].T
        dx = np.zeros_like(x)
        for k, lo in (("f", 0), ("b", 1)):
            u, gu = p[f"U{k}"], np.zeros_like(p[f"U{k}"])
            dstate = np.zeros((x.shape[1], h), np.float32)
            for t, prev, r, z0, z, new in reversed(keep[k]):
                dstate = dstate + ds[t, :, lo * h : (lo + 1) * h]
                dnew = dstate * z * (1 - new**2)
                dz = dstate * (new - prev) * mask[t] * z0 * (1 - z0)
                drs = dnew @ u[:, 2 * h :].T
                dr = drs * prev * r * (1 - r)
                gates = np.concatenate([dr, dz], 1)
                gu[:, : 2 * h] += prev.T @ gates
                gu[:, 2 * h :] += (r * prev).T @ dnew
                dx[t, :, 3 * h * lo : 3 * h * (lo + 1)] = np.concatenate([gates, dnew], 1)
                dstate = dstate * (1 - z) + drs * r + gates @ u[:, : 2 * h].T
            g[f"U{k}"] = gu
        return logit, g, dx

    def all_gradients(
        self,
        words: list[str],
        back: np.ndarray,
        mask: np.ndarray,
        y: np.ndarray,
    ) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The logits of windows whose places hold the words of numbers `back`, and all parameters' gradients."""
        vec, (wid, tri, n) = self.vectors(words)
        logit, g, dx = self.gradients(self.project(vec)[back], mask, y)
        dx = dx * mask
        flat = np.zeros((len(words), 6 * HIDDEN), dx.dtype)
        np.add.at(flat, back.ravel(), dx.reshape(-1, 6 * HIDDEN))
        dv = np.zeros_like(vec)
        for k, part in (("f", flat[:, : 3 * HIDDEN]), ("b", flat[:, 3 * HIDDEN :])):
            g[f"W{k}"], g[f"c{k}"] = vec.T @ part, part.sum(0)
            dv += part @ self.p[f"W{k}"].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], wid, dv[:, :D_WORD])
        g["word"][0] = 0
        np.add.at(g["char"], tri, np.repeat(dv[:, D_WORD:] / n[:, None], n, axis=0))
        return logit, g

    def windows(self, n: int) -> list[tuple[int, int]]:
        """First and last + 1 of the windows that cover n words."""
        return [(s, min(n, s + WINDOW)) for s in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def _layout(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word numbers from 1 -> (T, B) numbers, 0 where a row has ended, and the mask."""
    at = np.zeros((WINDOW, len(rows)), np.int64)
    for j, r in enumerate(rows):
        at[: len(r), j] = r
    return at, (at > 0).astype(np.float32)[:, :, None]


def train(texts: list[str], labels: list[int], *, rates: tuple[float, float] = (1.0, 1.0), epochs: int = 6, seed: int = 7) -> Network:
    """Multiple-instance learning: a toxic text's window with the strongest evidence is a positive example, a clean
    text's windows are negative ones. At first the evidence is the words' log odds between the two kinds of texts,
    which the first number of each known word's vector starts as, too (a third of them); later it is the network's own logit. At last the logit of texts is calibrated. rates are the shares of all clean and of
    all toxic rows that are given; calibration and prior weigh the rows by their inverse."""
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    y = np.array(labels)
    weight = np.where(y == 1, 1 / rates[1], 1 / rates[0])
    weight = weight / weight.mean() if len(y) else weight
    prior = float((weight * y).mean()) if len(y) else 0.0
    df = [Counter(), Counter()]
    for d, k in zip(docs, y):
        df[k].update(set(d))
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    both = df[0] + df[1]
    known = sorted((w for w, n in both.items() if n >= 4), key=lambda w: (-both[w], w))[:MAX_VOCAB]
    net = Network({w: i for i, w in enumerate(known, 1)}, seed)
    net.prior = prior
    if not 0 < prior < 1:
        net.scale, net.shift = 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return net
    odds = lambda w: np.log((df[1][w] + 0.5) / (n1 + 1)) - np.log((df[0][w] + 0.5) / (n0 + 1)) if both[w] >= 4 else 0.0
    every = sorted(both)
    number = {w: i for i, w in enumerate(every, 1)}
    lo = np.array([0.0, *map(odds, every)])
    net.p["word"][1:, 0] = np.array([lo[number[w]] for w in known], np.float32) / 3
    ids = [np.array([number[w] for w in d], np.int64) for d in docs]
    spans = [net.windows(len(i)) if len(i) else [] for i in ids]
    evidence = [np.array([lo[i[s:e]].max() for s, e in sp]) for i, sp in zip(ids, spans)]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0

    def logits() -> list[np.ndarray]:
        table = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), net.project(net.vectors(every)[0])])
        rows = [i[s:e] for i, sp in zip(ids, spans) for s, e in sp]
        out = []
        for j in range(0, len(rows), AT_ONCE):
            at, mask = _layout(rows[j : j + AT_ONCE])
            out.append(net.forward(table[at], mask))
        flat = np.concatenate(out) if out else np.zeros(0)
        return np.split(flat, np.cumsum([len(sp) for sp in spans])[:-1])

    for epoch in range(epochs):
        if epoch >= 2:
            evidence = logits()
        rows, marks = [], []
        for i, sp, ev, k in zip(ids, spans, evidence, y):
            if not sp:
                continue
            top = int(np.argmax(ev))
            chosen = {top} if k else {top, *rng.integers(len(sp), size=min(len(sp), 2)).tolist()}
            rows += [i[slice(*sp[c])] for c in sorted(chosen)]
            marks += [k] * len(chosen)
        order = rng.permutation(len(rows))
        for j in range(0, len(order), 64):
            pick = order[j : j + 64]
            at, mask = _layout([rows[x] for x in pick])
            used, back = np.unique(at, return_inverse=True)
            words = [every[u - 1] if u else "x" for u in used]
            _, g = net.all_gradients(words, back.reshape(at.shape), mask, np.array([marks[x] for x in pick], np.float32))
            step += 1
            for name, v in net.p.items():
                m, s = moment[name]
                m += 0.1 * (g[name] - m)
                s += 0.001 * (g[name] ** 2 - s)
                v -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    best = np.array([ev.max() if len(ev) else 0.0 for ev in logits()])
    for _ in range(300):  # logistic calibration by Newton's steps, slightly damped
        q = _sigmoid(net.scale * best + net.shift)
        w = weight * q * (1 - q) + 1e-4
        a = np.array([[np.sum(w * best * best) + 1e-2, np.sum(w * best)], [np.sum(w * best), np.sum(w) + 1e-2]])
        d = np.linalg.solve(a, np.array([np.sum(weight * (y - q) * best), np.sum(weight * (y - q))]))
        net.scale, net.shift = net.scale + 0.5 * d[0], net.shift + 0.5 * d[1]
        if np.abs(d).max() < 1e-6:
            break
    return net


class Scorer:
    """Scores batches of texts; remembers the projected inputs of words."""

    def __init__(self, net: Network):
        self.net, self.rows = net, {}
        self.table = np.zeros((MEMORY + 1, 6 * HIDDEN), np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Rows of the table for the words, of which there are MEMORY different ones at most."""
        every = set(words)
        new = {w for w in every if w not in self.rows}
        if len(self.rows) + len(new) > MEMORY:
            self.rows.clear()
            new = every
        if new:
            new = sorted(new)
            at = len(self.rows) + 1
            self.table[at : at + len(new)] = self.net.project(self.net.vectors(new)[0])
            self.rows.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def scores(self, texts: Iterator[str]) -> list[float]:
        best: list[float] = []
        held: list[str] = []  # words whose windows are waiting
        spans: list[tuple[int, int, int]] = []  # text, first and last + 1 of the held words

        def run() -> None:
            numbers = self.numbers(held)
            for j in range(0, len(spans), AT_ONCE):
                part = spans[j : j + AT_ONCE]
                at, mask = _layout([numbers[s:e] for _, s, e in part])
                for (o, _, _), v in zip(part, self.net.forward(self.table[at], mask).tolist()):
                    best[o] = max(best[o], v)
            held.clear()
            spans.clear()

        for text in texts:
            best.append(-np.inf)
            words = words_of(text)
            # A long text goes in parts that end where a window starts, so that its windows are the same.
            for first in range(0, len(words), PART):
                part = words[first : first + PART + WINDOW - STRIDE]
                if first and len(part) <= WINDOW - STRIDE:
                    break
                if len(held) + len(part) > MEMORY // 2:
                    run()
                spans += [(len(best) - 1, len(held) + s, len(held) + e) for s, e in self.net.windows(len(part))]
                held += part
        if held:
            run()
        z = np.array(best)
        known = np.isfinite(z)
        return np.where(known, _sigmoid(self.net.scale * np.where(known, z, 0) + self.net.shift), self.net.prior).tolist()


def held_out(id_col) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> tuple[list[str], list[int], tuple[float, float]]:
    """Texts and labels of at most MAX_TOXIC + MAX_CLEAN rows that aren't held out, by the lowest hash of their id,
    and the shares of all such clean and toxic rows that they are."""
    rows = labels.where(
        F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))
    ).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("y"))
    rows = rows.withColumn("h", F.xxhash64(F.lit("toxic"), "k"))
    take = lambda y, n: rows.where(F.col("y") == y).orderBy("h", "k").limit(n)
    there = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rates = tuple(min(1.0, most / max(1, there.get(y, 0))) for y, most in ((0, MAX_CLEAN), (1, MAX_TOXIC)))
    ids = C.written(take(1, MAX_TOXIC).unionByName(take(0, MAX_CLEAN)).select("k", "y"), "sample")
    got = docs.select(docs[id_col].alias("k"), C.texts(docs, text_col).alias("text")).join(F.broadcast(ids), "k")
    got = sorted(got.dropDuplicates(["k"]).collect(), key=lambda r: r["k"])
    return [r["text"] for r in got], [int(r["y"]) for r in got], rates


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, all windows of its whole text being scored.

    The network is fitted on the driver on a bounded sample (see MAX_TOXIC, MAX_CLEAN) of labelled rows whose
    crc32(doc_id) mod 3 is not 1; nothing but the text is its input. Scores are calibrated to the share of toxic rows
    among all of these, which is also the score of a text without words, null or empty. A null id isn't held out; repeated rows score alike; an empty table
    gives no rows; other columns are ignored. No shuffle but the sample's."""
    C.require(docs, id_col, text_col)
    sample, marks, rates = labelled_sample(docs, labels, id_col, text_col)
    net = train(sample, marks, rates=rates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            texts = b.column("text")
            for i in range(0, len(texts), 512):
                got = scorer.scores(x.as_py() or "" for x in texts[i : i + 512])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[i : i + 512],
                        b.column("held_out")[i : i + 512],
                        pa.array(got, pa.float64()),
                        pa.array([int(s >= threshold) for s in got], pa.int32()),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    given = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), C.texts(docs, text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
