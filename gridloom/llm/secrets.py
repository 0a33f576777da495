"""Secret scans: spans in whole texts, and how widely each candidate value is owned over the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# The base kinds in the order they are listed, then the further kinds of candidates.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
FURTHER = {
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "prefixed": re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|SG\.)[A-Za-z0-9_.-]{16,}"),
    "url": re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{6,64})@"),
    "mixed": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"),
}
KINDS = ("assign", "access", "hex", *FURTHER)
#: A value that at most so many owners have, in at most so many repositories, counts as theirs; one that more owners or
#: more repositories have is an example that is widely copied.
MAX_OWNERS, MAX_REPOSITORIES = 2, 10
#: Bits a character that a "mixed" run of letters and digits must have.
MIN_BITS = 3.5

#: Rows of the table of spans that are broadcast at most.
MAX_BROADCAST = 50_000

SCAN_TYPE = "uid long, key long, doc_id long, owner string, repository long, base array<string>, value array<string>, span array<string>"


def _bits(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) of the base kinds: whole matches, code points, end exclusive."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


class Covered:
    """The places that spans cover, as disjoint runs in order; runs that touch are one."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            self.add(s, e)

    def has(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start) - 1
        return i >= 0 and self.ends[i] >= end

    def add(self, start: int, end: int) -> None:
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]


def further_spans(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """Candidates of the further kinds that reach beyond the base spans and the candidates of earlier kinds."""
    taken = Covered([(s, e) for s, _, e, _ in base])
    found = []
    for k, (kind, pattern) in enumerate(FURTHER.items(), 3):
        for m in pattern.finditer(text):
            value = m.group(m.lastindex or 0)
            if kind == "mixed" and not (
                re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value) and _bits(value) >= MIN_BITS
            ):
                continue
            if not taken.has(*m.span()):
                taken.add(*m.span())
                found.append((m.start(), k, m.end(), value))
    return found


def span_text(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in sorted(spans))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {n: [] for n in ("base", "value", "span")}
        for text in b.column("text").to_pylist():
            base = base_spans(text)
            more = further_spans(text, base)
            out["base"].append([span_text([s]) for s in base])
            out["value"].append([hashlib.sha256(s[3].encode("utf-8", "surrogatepass")).hexdigest() for s in base + more])
            out["span"].append([span_text([s]) for s in base + more])
        lists = [pa.array(out[n], pa.list_(pa.string())) for n in ("base", "value", "span")]
        as_is = ["uid", "key", "doc_id", "owner", "repository"]
        yield pa.RecordBatch.from_arrays([*map(b.column, as_is), *lists], [*as_is, "base", "value", "span"])


def ownership(scan: DataFrame) -> DataFrame:
    """value -> owners, repositories, occurrences: how many different ones have it. An owner's equal texts are one repository.

    Two steps, each combined before its shuffle: a value that a third of the rows have is a row an owner and task."""
    each = scan.select("owner", "repository", F.explode("value").alias("value"))
    by_repo = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(
        F.count(F.lit(1)).alias("owners"),
        F.sum("repositories").alias("repositories"),
        F.sum("n").alias("occurrences"),
    )


def _key(docs: DataFrame, id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(docs[id_col], C.texts(docs, text_col))


def without_secrets(docs: DataFrame, *, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with each live span of the texts replaced by `mark`; overlapping spans are replaced as one. Values that
    are widely copied stay, and so do all rows. Texts with spans are few, so the table of spans is broadcast where it
    has at most MAX_BROADCAST rows, and else joined by a shuffle."""
    hits = scan_secrets(docs, id_col=id_col, text_col=text_col, **options).select(
        "key",
        F.transform(F.filter("found", lambda x: x["live"]), lambda x: x["span"]).alias("spans"),
    ).where(F.size("spans") > 0)
    part = lambda s, n: F.split_part(s, F.lit(":"), F.lit(n)).cast("int")
    cuts = F.sort_array(F.transform("spans", lambda s: F.struct(part(s, 2).alias("s"), part(s, 3).alias("e"))))
    whole = "aggregate(cuts, cast(array() as array<struct<s: int, e: int>>), (r, x) -> if(size(r) > 0 and x.s < element_at(r, -1).e, concat(slice(r, 1, size(r) - 1), array(struct(element_at(r, -1).s as s, greatest(element_at(r, -1).e, x.e) as e))), concat(r, array(struct(x.s as s, x.e as e)))))"
    hits = C.written(
        hits.dropDuplicates(["key"]).select("key", cuts.alias("cuts")).select("key", F.reverse(F.expr(whole)).alias("cuts")),
        "spans",
    )
    small = hits.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        _key(docs, id_col, text_col).alias("key"),
    ).join(F.broadcast(hits) if small else hits, "key", "left")
    text = F.aggregate("cuts", F.col(f"row.`{text_col}`"), lambda t, x: F.overlay(t, F.lit(mark), x["s"] + 1, x["e"] - x["s"]))
    text = F.when(F.col("cuts").isNull(), F.col(f"row.`{text_col}`")).otherwise(text)
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """doc_id, key (hash of id and text), base (array of kind:start:end), found (array of struct span, value, owners, repositories, live, is_base).

    The owner is owner_col, the repository the document, an owner's equal texts being copies of one. Every text is
    scanned whole. Base spans all stay in `found`; a further candidate is added where its value is live-looking: at most
    max_owners owners have it, in at most max_repositories repositories. live says the same of base spans. Null text is empty, a null owner is one owner, repeated rows are rows of their own, an empty
    table gives no rows; other columns are ignored.
    Plan: the texts are scanned once, to a table without them; values are counted by (value, owner, document), then
    joined back by value, which Spark splits where one value is hot, and gathered by row."""
    C.require(docs, id_col, text_col, owner_col)
    given = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        _key(docs, id_col, text_col).alias("key"),
        docs[id_col].cast("long").alias("doc_id"),
        docs[owner_col].cast("string").alias("owner"),
        F.xxhash64(C.texts(docs, text_col)).alias("repository"),
        C.texts(docs, text_col).alias("text"),
    )
    scan = C.written(given.mapInArrow(_scan, SCAN_TYPE), "scan")
    owned = ownership(scan.where(F.size("value") > 0))
    each = scan.where(F.size("value") > 0).select(
        "uid",
        F.posexplode(F.arrays_zip("value", "span", F.sequence(F.lit(1), F.size("value")).alias("at"))).alias("i", "c"),
        F.size("base").alias("n_base"),
    )
    each = each.select(
        "uid",
        F.col("c.value").alias("value"),
        F.col("c.span").alias("span"),
        (F.col("i") < F.col("n_base")).alias("is_base"),
        "i",
    )
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    each = each.join(owned, "value").where(F.col("is_base") | live)
    found = each.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("i", "span", "value", "owners", "repositories", live.alias("live"), "is_base"))).alias("found")
    )
    out = scan.select("uid", "key", "doc_id", "base").join(found, "uid", "left")
    none = F.array().cast(found.schema["found"].dataType)
    return out.select("doc_id", "key", "base", F.coalesce("found", none).alias("found"))


def in_order(spans: F.Column) -> F.Column:
    """The spans comma-joined by start, then by kind as listed."""
    rank = F.create_map(*[F.lit(x) for k, n in enumerate(KINDS) for x in (n, k)])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("s"),
            F.element_at(rank, F.split_part(s, F.lit(":"), F.lit(1))).alias("k"),
            s.alias("t"),
        ),
    )
    return F.concat_ws(",", F.transform(F.sort_array(keyed), lambda x: x["t"]))
