"""Token ids of whole texts with a public tokenizer, on executors, a batch at a time."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

#: Longer chunks aren't remembered.
LONGEST = 64
#: Texts are split into chunks that many code points at a time, so that one text's chunks never stand in memory at once.
SLICE = 1 << 18

# The characters with Unicode's White_Space property; letters of ASCII and Latin-1 that are
# composed, one code point in either case, and letters to every Unicode version; the other ASCII characters.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
OTHERS = "\\x00-\\x08\\x0e-\\x1f!-/:-@\\[-`{-\\x7f"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

_encoders: dict = {}


class Known(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers, worked out when first asked for."""

    def __init__(self, encode: Callable[[str], bytes], memory: int):
        super().__init__()
        self.encode, self.memory = encode, memory

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.memory:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """ids(text) as encode(text, add_special_tokens=False) gives them. A special token's string in a text is that token, as
    the library has it: the text is cut there, and its parts are encoded each by itself.

    Both tokenizers first split a text into pieces and merge within a piece, so a text's ids are those of its
    pieces, and a piece met again costs one look-up. Texts of plain characters are split here, by the tokenizer's
    own pattern for these, and the library's model merges each new piece. Other texts are cut only at white space,
    where pieces end too, and the library encodes each new run by all its steps."""

    plain: str
    runs: str
    lower = False
    #: Chunks of text whose ids a worker remembers; all are forgotten when there are more.
    memory = 700_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenize, spell = tokenizer.model.tokenize, _spelling()
        packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        blank = chr(spell[ord(" ")])

        def of_piece(c: str) -> bytes:
            # Of the printable characters of ASCII only the blank is written as another one.
            c = c.replace(" ", blank) if c.isascii() and c.isprintable() else c.encode().decode("latin-1").translate(spell)
            return b"".join([packed[t.id] for t in tokenize(c)])

        self.pieces = Known(of_piece, self.memory)
        self.others = Known(lambda c: b"".join([packed[i] for i in tokenizer.encode(c, add_special_tokens=False).ids]), self.memory)
        added = tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("a token is added that isn't looked for in the text as it stands")
        self.special = {t.content: packed[i] for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.find_plain, self.find_runs = re.compile(self.plain).finditer, re.compile(self.runs).finditer
        self.odd = re.compile(f"[^{LETTERS}{OTHERS}0-9\\t-\\r ]").search

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            # Every other part is a special token.
            return b"".join(self.special[p] if k % 2 else self._part(p) for k, p in enumerate(self.cut(text)))
        return self._part(text)

    def _part(self, text: str) -> bytes:
        if self.odd(text):
            return self._joined(text, self.find_runs, self.others)
        return self._joined(text.lower() if self.lower else text, self.find_plain, self.pieces)

    def _joined(self, text: str, find, known: Known) -> bytes:
        pattern = find.__self__
        if len(text) <= SLICE:
            return b"".join(map(known.__getitem__, pattern.findall(text)))
        done, part = [], []
        for m in find(text):
            part.append(known[m.group()])
            if len(part) >= SLICE:
                done.append(b"".join(part))
                part = []
        return b"".join([*done, *part])


def _spelling() -> dict[int, int]:
    """How byte-level BPE writes bytes: printable ones as they are, the others from U+0100 on."""
    as_is = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in as_is)
    return {b: 256 + n for n, b in enumerate(rest)}


class ByteLevel(Encoder):
    """Byte-level BPE that keeps white space; a run takes the blank before it along."""

    plain = f" ?[{LETTERS}]+|{CONTRACTIONS}| ?[0-9]+| ?[{OTHERS}]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+"
    runs = f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


class WordEnd(Encoder):
    """BPE with word ends over lower-cased text, which drops white space and takes digits one by one."""

    memory = 500_000
    plain = f"[{LETTERS}]+|{CONTRACTIONS}|[0-9]|[{OTHERS}]+"
    runs = f"[^{SPACES}]+"
    lower = True


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One a worker process, kept from task to task."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]


def each_text(column) -> Iterator[str]:
    """The strings of an Arrow column, one at a time; null is empty."""
    return (x.as_py() or "" for x in column)
