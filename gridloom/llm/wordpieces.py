"""SentencePiece ids of whole texts for models of merges, by a table of prefixes, and the texts that ids stand for.

The ids of a text's prefix are those of a shorter prefix and one more token, whose pieces don't merge with each other. That
last token is the only one of the prefix's suffix tokens that is compatible with the last token of what stands before it:
of two tokens side by side, merging leaves the two. An automaton finds the suffix tokens of all prefixes in one pass, and
the ids are read off the table from the end. The work is linear in the text however long its words are."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .encode import SLICE, Known, each_text

#: How a blank is written in pieces.
BLANK = "▁"
#: Chunks of text and pairs of tokens that a worker remembers; all are forgotten when there are more.
CHUNKS, PAIRS = 600_000, 1_000_000
#: Bytes of ids and texts in an Arrow batch.
BATCH_BYTES = 4 << 20
UNKNOWN, NEVER = -1, float("inf")


def _alike(pieces: Iterable[str]) -> list[set[str]]:
    """The pieces' characters in sets, such that characters side by side in a piece, blanks aside, are of one set."""
    of: dict[str, set[str]] = {}
    for p in pieces:
        p = p.lstrip(BLANK)
        sets = {id(x): x for x in (of.get(c) for c in p) if x is not None}.values()
        one = max(sets, key=len, default=set())
        for c in [*p, *(c for x in sets if x is not one for c in x)]:
            one.add(c)
            of[c] = one
    return list({id(x): x for x in of.values()}.values())


class PieceEncoder:
    """ids(text) as the library's encode(text) gives them, decode(ids) as its decode does.

    No piece holds a blank after another character, nor two characters side by side of which chains of pieces don't lead
    from one to the other. So a text falls into chunks of blanks and what follows them, letters or others, and a chunk met
    again costs one look-up."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        self.pieces = {i: model.id_to_piece(i) for i in own}
        #: Merging takes the greatest score first, then the leftmost.
        self.merges = {p: -model.get_score(i) for i, p in self.pieces.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        letters = {c for p in self.merges for c in p}
        probe = f" a  {BLANK}ÅﬁÅ\t\n "
        if model.normalize(probe) != self._written(probe) or any(model.is_unknown(i) for i in self.bytes):
            raise ValueError("the model changes texts beyond blanks, or has no byte pieces")
        if not letters <= self.merges.keys() or any(BLANK in p.lstrip(BLANK) for p in self.merges):
            raise ValueError("a piece holds a character that is none itself, or a blank within")
        alike = re.escape("".join(max(_alike(self.merges), key=len)))
        self.chunk = re.compile(f"{BLANK}*(?:[{alike}]+|[^{BLANK}{alike}]+)|{BLANK}+")
        self.automaton = ahocorasick.Automaton()
        for i, p in self.pieces.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.decode = model.decode
        self.stable: dict[int, bool] = {}
        self.known = Known(self._packed, CHUNKS)

    @staticmethod
    def _written(text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a short text, step by step."""
        parts, of = list(text), self.merges.get
        costs = [of(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == NEVER:
                break
            i = costs.index(best)
            parts[i] += parts.pop(i + 1)
            costs.pop(i)
            if i:
                costs[i - 1] = of(parts[i - 1] + parts[i], NEVER)
            if i < len(costs):
                costs[i] = of(parts[i] + parts[i + 1], NEVER)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b stays itself after token a; a is UNKNOWN where nothing that merges stands before b."""
        parts = [self.pieces[b]] if a == UNKNOWN else [self.pieces[a], self.pieces[b]]
        text = "".join(parts)
        return not (len(parts) == 2 and text in self.merges) and self.merged(text) == parts

    def chunk_ids(self, chunk: str) -> list[int]:
        last, lengths, stable = [UNKNOWN] * (len(chunk) + 1), [1] * (len(chunk) + 1), self.stable
        # The automaton gives the longest of the tokens that end at a place first.
        for end, (token, length) in self.automaton.iter(chunk):
            if last[end + 1] != UNKNOWN:
                continue
            before = last[end + 1 - length]
            key = (before + 1) << 20 | token
            fits = stable.get(key)
            if fits is None:
                if len(stable) >= PAIRS:
                    stable.clear()
                fits = stable[key] = self.compatible(before, token)
            if fits:
                last[end + 1], lengths[end + 1] = token, length
        ids, at = [], len(chunk)
        while at:
            if last[at] == UNKNOWN:
                ids += [self.bytes[b] for b in reversed(chunk[at - 1].encode())]
            else:
                ids.append(last[at])
            at -= lengths[at]
        return ids[::-1]

    def _packed(self, chunk: str) -> bytes:
        return np.array(self.chunk_ids(chunk), "<i4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        text = self._written(text)
        if len(text) <= SLICE:
            return np.frombuffer(b"".join(map(self.known.__getitem__, self.chunk.findall(text))), "<i4")
        done, part = [], []
        for m in self.chunk.finditer(text):
            part.append(self.known[m.group()])
            if len(part) >= SLICE:
                done.append(b"".join(part))
                part = []
        return np.frombuffer(b"".join([*done, *part]), "<i4")


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One a worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _encoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        keys: list = []
        ids: list[np.ndarray] = []
        texts: list[str] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

        for b in batches:
            for key, text in zip(b.column("doc_id").to_pylist(), each_text(b.column("text"))):
                found = enc.ids(text)
                keys.append(key)
                ids.append(found)
                texts.append(enc.decode(found.tolist()))
                held += 4 * len(found) + len(text)
                if held >= BATCH_BYTES:
                    yield flush()
                    keys, ids, texts, held = [], [], [], 0
        if keys:
            yield flush()

    return run


def encode_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: the ids of each whole text without begin and end, and the text that they stand for.

    Null text is empty and has no ids; characters without a piece are their bytes' ids; a null id stays null; repeated
    rows are rows of their own; an empty table gives no rows; other columns are ignored. No shuffle: each text alone."""
    C.require(docs, id_col, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), C.texts(docs, text_col).alias("text"))
    return rows.mapInArrow(_encoding(model_path), "doc_id long, ids array<int>, decoded string")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_pieces gives."""
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hashed(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        hashed(F.col("decoded")).alias("decoded_sha256"),
    )
