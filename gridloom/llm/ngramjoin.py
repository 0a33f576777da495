"""Jaccard self-join of documents on sets of word 5-grams, by T-occurrence search.

How all links are found without the pairs of every group:

1. Equal sets collapse to one representative.
2. All sets are ordered alike, shingles that many documents share last. A link needs T shared shingles, so it shares
   one among each set's first n - T + 1: the short lists of the search are those of these shingles.
3. Sets that share two of their least hashes are first joined to one of them each, so that groups of near copies
   become components at a cost linear in their size. A list whose members are all of one component can add nothing.
4. Short lists are merged: pairs of different components are counted over them, and those go that are met less often
   than T, less the long lists that both are in, asks for. What is left is verified by the search itself: a query's
   block of candidates is indexed by shingle, the short lists are merged, the T_0 - 1 longest ones probed (DivideSkip).
5. A long list never gives the pairs of its members. It names a hub S, the member that has the largest share of its
   prefix in long lists, and each other member A is compared with S alone. What links becomes one component. Any other
   pair is searched for in what sets A from S, of which m(A) shingles are missing from A and the others are beyond S.
   No more than |S| - max(m(A), m(B)) of what A and B share is in S, so a link needs of shingles beyond S

       |A and B beyond S| >= E = T - |S| + max(m(A), m(B)).

   E is 1 or more unless both A and B share T with S; then, but for one smaller than S and one that doesn't link with S,
   they are of one component already. So the same T-occurrence search, with E for T and the shingles beyond S for the sets,
   goes on over these alone: what near copies miss of S, the long lists, isn't listed. Their lists are short, or name hubs
   in turn. The few rows of E <= 0 (see _differences) are searched by their whole differences a = A xor S, too:

       |A and B| = |S| - m(A) - m(B) + |a and b|,   so a link needs   |a and b| >= D = T - |S| + m(A) + m(B),

   and if D is 0 or less, both A and B link with S, so they are of one component already.

The order is a heuristic, and so are the hubs: they decide how long lists are, never which links are found."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Words in a shingle; a link is NUM * intersection >= DEN * union.
N, NUM, DEN = 5, 100, 75
#: Shingles that stand last in the order: at most MAX_FREQUENT of those met at least MIN_COUNT times.
MAX_FREQUENT, MIN_COUNT = 2_000_000, 4
ANCHORS = 4
#: Candidates of one query in a block, and tables of ids that are broadcast at most.
BLOCK, MAX_BROADCAST = 256, 500_000
#: Rows of one text, and of two, that go to a Python worker at once.
TEXTS_AT_ONCE, PAIRS_AT_ONCE = 2_000, 500
#: Open lists' shingles, 8 bytes each, that are broadcast at most.
MAX_OPEN = 2_000_000
#: Lists of more members are long and give no pairs. Differences from hubs are taken so many times over at most; the
#: lists of the last ones are all merged, so that no link is lost.
LONG_LIST, LEVELS = 64, 5
#: Costs are counted in parts of 1 / UNIT of a shingle.
UNIT = NUM + DEN

#: Words whose hashes a worker remembers; a task's are forgotten at its end, so that later stages have the room.
MAX_WORDS = 300_000

_words: dict[bytes, int] = {}


def _forget() -> None:
    _words.clear()


def _forgetting(run):
    """run, over the batches of a task, whose words are forgotten at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _forget()

    return task


def shingle_set(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; with fewer than N words, of all of them as one."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > MAX_WORDS:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(N, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def needed(a: int, b: int) -> int:
    """T: the least intersection that links sets of a and b elements."""
    return -(-DEN * (a + b) // (NUM + DEN))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every = np.concatenate([np.zeros(0, np.uint64), *(shingle_set(x.as_py() or "") for x in b.column("text"))])
        every.sort()
        # A shingle met n times stands n - 1 times after itself.
        every, n = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
        keep = np.argsort(-n, kind="stable")[:MAX_FREQUENT]
        every, n = every[keep], n[keep] + 1
        yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(n)], ["s", "n"])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles, rarest first; at most MAX_FREQUENT numbers come to the driver."""
    seen = C.written(
        docs.select("text").mapInArrow(_forgetting(_common), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT),
        "frequent",
    )
    # The least count that leaves MAX_FREQUENT at most; counts from 10,000 on are alike here.
    least, room = 10_001, MAX_FREQUENT
    for r in seen.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect():
        room -= r["k"]
        if room < 0:
            break
        least = r["n"]
    rows = seen.where(F.col("n") >= least).toArrow()
    s, n = rows["s"].to_numpy(), rows["n"].to_numpy()
    return s[np.lexsort((s, n))].view(np.uint64)


SUMMARY_TYPE = "row long, doc_id long, n long, uid long, anchors array<long>, prefix array<long>"


def _summarize(last: np.ndarray):
    by_value = np.argsort(last).astype(np.int32)
    values = last[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                cols: list[list] = [[], [], [], []]
                for x in part.column("text"):
                    s = shingle_set(x.as_py() or "")
                    rank = np.zeros(len(s), np.int64)
                    if len(values) and len(s):
                        k = np.minimum(np.searchsorted(values, s), len(values) - 1)
                        rank = np.where(values[k] == s, by_value[k] + 1, 0)
                    order = np.lexsort((s, rank))
                    first = len(s) - -(-DEN * len(s) // NUM) + 1 if len(s) else 0
                    with np.errstate(over="ignore"):
                        mixed = s * np.uint64(0xC2B2AE3D27D4EB4F)
                    mixed = np.sort(mixed ^ (mixed >> np.uint64(31)))[:ANCHORS]
                    for c, v in zip(
                        cols,
                        (
                            len(s),
                            int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True),
                            mixed.view(np.int64),
                            s[order[:first]].view(np.int64),
                        ),
                    ):
                        c.append(v)
                lists = [pa.array(c, pa.list_(pa.int64())) for c in cols[2:]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:2]], *lists],
                    ["row", "doc_id", "n", "uid", "anchors", "prefix"],
                )

    return run


def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Which of the sets link with the query. Lists: the sets' numbers by shared shingle. The longest T_0 - 1 lists,
    T_0 being the least T of the block, are left out of the merge; a set met often enough in the others is looked up
    in them by binary search until it has its T."""
    own = [needed(len(query), len(s)) for s in sets]
    least = min(own)
    lists: list[list[int]] = [[] for _ in range(len(query))]
    for i, s in enumerate(sets):
        k = np.minimum(np.searchsorted(query, s), len(query) - 1)
        for j in k[query[k] == s].tolist():
            lists[j].append(i)
    lists.sort(key=len)
    cut = max(0, len(lists) - (least - 1))
    short, long_ = [x for x in lists[:cut] if x], lists[cut:]
    long_.reverse()
    linked = []
    for i, same in groupby(heapq.merge(*short)):
        count = sum(1 for _ in same)
        for k, x in enumerate(long_):
            if count >= own[i] or count + len(long_) - k < own[i]:
                break
            at = bisect_left(x, i)
            count += at < len(x) and x[at] == i
        if count >= own[i]:
            linked.append(i)
    return linked


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        found: list[int] = []
        for _, run in groupby(range(len(b)), key=b.__getitem__):
            run = list(run)
            query = shingle_set(batch.column("b_text")[run[0]].as_py())
            for k in range(0, len(run), BLOCK):
                part = run[k : k + BLOCK]
                found += [part[i] for i in divide_skip(query, [shingle_set(batch.column("a_text")[j].as_py()) for j in part])]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in found], pa.int64()) for x in (a, b)], ["a", "b"])


DIFFERENCE_TYPE = "hub long, uid long, n long, base long, missing long, tied boolean, beyond array<long>, lost array<long>"


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, a_text, b_text), b being the hub: what sets a from b, and whether the two link."""
    hub, s = None, np.zeros(0, np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            cols: list[list] = [[], [], [], [], [], []]
            for b, a_text, b_text in zip(part.column("b").to_pylist(), part.column("a_text"), part.column("b_text")):
                if b != hub:
                    hub, s = b, shingle_set(b_text.as_py())
                x = shingle_set(a_text.as_py())
                beyond, lost = np.setdiff1d(x, s, assume_unique=True), np.setdiff1d(s, x, assume_unique=True)
                tied = len(s) - len(lost) >= needed(len(x), len(s))
                for c, v in zip(cols, (len(x), len(s), len(lost), tied, beyond.view(np.int64), lost.view(np.int64))):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("b"), part.column("a"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                ["hub", "uid", "n", "base", "missing", "tied", "beyond", "lost"],
            )


def _few(df: DataFrame, most: int = 0) -> DataFrame:
    """df, to be broadcast if it has few rows. df is a written table of ids."""
    most = most or MAX_BROADCAST
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _with_texts(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) of sets (uid, row) beside their texts, which are in texts (row, text). pairs is a written table."""
    ids = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    ids = C.written(sets.select("uid", "row").join(ids, "uid", "left_semi"), "ids")
    there = C.written(texts.join(_few(ids), "row").dropDuplicates(["uid"]).select("uid", "text"), "texts")
    rows = pairs.join(there.select(F.col("uid").alias("a"), F.col("text").alias("a_text")), "a")
    return rows.join(there.select(F.col("uid").alias("b"), F.col("text").alias("b_text")), "b").select("a", "b", "a_text", "b_text")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of pairs (a, b); see _with_texts."""
    return C.written_by(_with_texts(pairs, sets, texts).mapInArrow(_forgetting(_verify), "a long, b long"), "links", PAIRS_AT_ONCE)


def _relabelled(df: DataFrame, name: str, labels: DataFrame) -> DataFrame:
    """df with the label of the node in column `name`, where it has one. labels is a written table."""
    node = labels.select(F.col("node").alias(name), F.col("label").alias("to"))
    return df.join(_few(node), name, "left").withColumn(name, F.coalesce("to", name)).drop("to")


def _edges(links: DataFrame) -> DataFrame:
    """The links between different nodes, each once, a being less than b; a written table."""
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return C.written(ends.where("a != b").distinct(), "edges")


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """node, label (the least node of its component) for all ends of the links and all nodes of `before`, the labels of
    earlier links, which aren't looked at again.

    In a round each node takes the least of its lesser neighbours, and so on to the end of that chain by labels of labels;
    the links then lie between what is left of the nodes, each once, and those within one node are gone. So a
    link is read in as many rounds as it takes to have its ends meet, and a group's links go with the first rounds."""
    if before is not None:
        links = _relabelled(_relabelled(links.select("a", "b"), "a", before), "b", before)
    edges = _edges(links)
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    if before is not None:
        ends = ends.join(before, "node", "left_anti")
    new = ends.select("node", F.col("node").alias("label"))
    labels = C.written(new if before is None else before.select("node", "label").union(new), "labels")
    while edges.limit(1).count():
        near = C.written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "nearer")
        while True:
            jump = C.written(_relabelled(near.withColumn("was", F.col("label")), "label", near), "jumped")
            near = jump.select("node", "label")
            if not jump.where("was != label").limit(1).count():
                break
        labels = C.written(_relabelled(labels, "label", near).select("node", "label"), "labels")
        edges = _edges(_relabelled(_relabelled(edges, "a", near), "b", near))
    return labels


def _stars(entries: DataFrame, key: str, least: int) -> DataFrame:
    """Pairs of each entry with two entries of its key's list, those of the least and the largest id, where components
    differ and sizes allow a link. Only pairs that `least` lists give."""
    ends = entries.groupBy(key).agg(
        F.min(F.struct("uid", "n", "comp")).alias("lo"),
        F.max(F.struct("uid", "n", "comp")).alias("hi"),
        F.min("comp").alias("c0"),
        F.max("comp").alias("c1"),
    )
    ends = ends.where("c0 != c1").select(key, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("end"))
    pairs = entries.join(ends, key).where(
        (F.col("comp") != F.col("end.comp")) & (F.least("n", "end.n") >= _needed(F.col("n"), F.col("end.n")))
    )
    pairs = pairs.groupBy(
        F.least("uid", "end.uid").alias("a"),
        F.greatest("uid", "end.uid").alias("b"),
    ).agg(F.count_distinct(key).alias("k"))
    return pairs.where(F.col("k") >= least).select("a", "b")


def _needed(a: F.Column, b: F.Column) -> F.Column:
    """T as a column; whole numbers throughout."""
    return F.floor((DEN * (a + b) + (NUM + DEN - 1)) / (NUM + DEN))


#: Whose lists these are: a hub's, of the shingles beyond it or of the whole differences.
SPACE = ("hub", "whole")


def _overlap(n: F.Column, m: F.Column, n_b: F.Column, m_b: F.Column) -> F.Column:
    """What a link of sets of n and n_b elements, of which the hub's m and m_b are missing, needs of their space: E, or D."""
    return _needed(n, n_b) - F.col("base") + F.greatest(m, m_b) + F.when(F.col("whole"), F.least(m, m_b)).otherwise(0)


def _prefixed(rows: DataFrame) -> DataFrame:
    """rows with own, the least overlap that any link of theirs needs, of which the prefix is d - own + 1 elements long.

    hub names the set S that the rows' differences are from (none at first: S is empty, what is beyond it are the sets),
    base is |S|, d the size in the space, cost DEN * n + UNIT * m, least_n the least n that the hub has. Beyond S, the
    partner is of least_n elements at least, and of the least size that may link. In whole differences D is
    (cost + cost) / UNIT - base, rounded up. Whoever the partner is, its cost is at least DEN * base, and DEN times the least
    size that may link. The partner of one that is tied to S isn't tied, or the two are of one component; its cost is over
    NUM * base."""
    size = F.ceil(DEN * F.col("n") / NUM)
    cost = F.greatest(DEN * size, F.when(F.col("tied"), NUM * F.col("base") + 1).otherwise(DEN * F.col("base")))
    beyond = _needed(F.col("n"), F.greatest(size, "least_n")) - F.col("base") + F.col("missing")
    own = F.when(F.col("whole"), _over(F.col("cost") + cost) - F.col("base")).otherwise(beyond)
    return rows.withColumn("own", F.greatest(F.lit(1), own))


def _over(cost: F.Column) -> F.Column:
    """cost / UNIT, rounded up; whole numbers throughout."""
    return F.floor((cost + (UNIT - 1)) / UNIT)


#: Kinds of lists: merged in full; few index entries, each of which meets all members; many, so that a hub is named.
SHORT, WIDE, LONG = 0, 1, 2


def _marked(entries: DataFrame, long_list: float) -> DataFrame:
    """entries of lists with members of several components, with index, kind and others, the set's number of lists that
    aren't short.

    index: the first element that two sets share stands early in the one of less cost, among its first d - x + 1 for
    the overlap x that one needs with its like: D and E are no less for any partner that costs as much or more."""
    alike = F.greatest("own", _overlap(*[F.col(c) for c in ("n", "missing")] * 2))
    entries = entries.withColumn("index", F.col("at") <= F.col("d") - alike)
    lists = entries.groupBy(*SPACE, "s").agg(
        F.count(F.lit(1)).alias("k"),
        F.count_if("index").alias("i"),
        F.min("comp").alias("c0"),
        F.max("comp").alias("c1"),
    ).where("c0 != c1")
    kind = F.when(F.col("k") <= F.lit(long_list), SHORT).when(F.col("i") <= F.lit(long_list), WIDE).otherwise(LONG)
    lists = C.written(lists.select(*SPACE, "s", kind.alias("kind")), "lists")
    own = W.partitionBy(*SPACE, "uid")
    return C.written(entries.join(lists, [*SPACE, "s"]).withColumn("others", F.count_if(F.col("kind") != SHORT).over(own)), "marked")


def _merged(marked: DataFrame) -> DataFrame:
    """Pairs of different components that enough lists have in common. Two sets meet where the first element that they
    share can stand, in the index of the one of less cost and with D elements to go in both; where that one's list is
    long, its hub has them. What the prefixes share is then counted once a pair: one of the two lies wholly before the
    other's end, so what is shared beyond the lists is less than the larger `own`; the rest must be in the lists."""
    names = ("uid", "n", "missing", "cost", "d", "own", "at", "comp")
    merged = marked.where(F.col("kind") != LONG)
    other = merged.select(*SPACE, "s", *[F.col(c).alias(f"{c}_b") for c in names])
    need = _overlap(*[F.col(c) for c in ("n", "missing", "n_b", "missing_b")])
    fits = (F.col("comp") != F.col("comp_b")) & (F.least("n", "n_b") >= _needed(F.col("n"), F.col("n_b")))
    first = (F.struct("cost", "uid") < F.struct("cost_b", "uid_b")) & (F.least(F.col("d") - F.col("at"), F.col("d_b") - F.col("at_b")) >= need)
    met = merged.where("index").join(other, [*SPACE, "s"]).where(fits & first).select(
        *SPACE,
        F.col("uid").alias("a"),
        F.col("uid_b").alias("b"),
        (need - F.greatest("own", "own_b") + 1).alias("least"),
    )
    met = C.written(met.distinct(), "met")
    ids = C.written(met.select(*SPACE, F.col("a").alias("uid")).union(met.select(*SPACE, "b")).distinct(), "ids")
    prefix = marked.join(_few(ids), [*SPACE, "uid"], "left_semi").groupBy(*SPACE, "uid").agg(F.collect_list("s").alias("p"))
    prefix = C.written(prefix, "prefixes")
    for end in ("a", "b"):
        met = met.join(prefix.select(*SPACE, F.col("uid").alias(end), F.col("p").alias(f"p_{end}")), [*SPACE, end])
    met = met.where(F.size(F.array_intersect("p_a", "p_b")) >= F.col("least"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hubs(marked: DataFrame) -> DataFrame:
    """Each member of a long list as `a` beside the list's hub as `b`."""
    long_ = marked.where(F.col("kind") == LONG)
    share = F.struct(F.col("others") / (F.col("d") - F.col("own") + 1), "uid")
    hubs = C.written(long_.groupBy(*SPACE, "s").agg(F.max_by("uid", share).alias("b")), "hubs")
    return long_.join(hubs, [*SPACE, "s"]).where("uid != b").select(F.col("uid").alias("a"), "b").distinct()


def _differences(rows: DataFrame, label) -> DataFrame:
    """Entries of the prefixes of what is beyond the hubs, and of some whole differences; rows are _differ's. Elements that
    only one component has come first, as no pair that is looked for shares them, then the others, the rarer ones first.

    A pair of E <= 0 has T in common with S on either side, so either's partner is no larger than its reach, the largest
    size whose T it has in common with S. One of the two isn't tied; the other is no larger than what such rows of
    the hub reach, which is less than S. Only rows that can be of such a pair are there with their whole differences."""
    reach = F.floor(UNIT * (F.col("base") - F.col("missing")) / DEN) - F.col("n")
    rows = label(rows).withColumn("reach", reach)
    hubs = rows.groupBy("hub").agg(
        F.min("n").alias("least_n"),
        F.max(F.when(~F.col("tied"), F.col("reach"))).alias("most_n"),
        F.min("comp").alias("c0"),
        F.max("comp").alias("c1"),
    ).where("c0 != c1")
    rows = rows.join(_few(C.written(hubs.drop("c0", "c1"), "hub_sizes")), "hub")
    columns = ("hub", "uid", "n", "base", "missing", "tied", "least_n", "comp")
    beyond = rows.select(*columns, F.lit(False).alias("whole"), F.col("beyond").alias("others"))
    whole = rows.where("reach >= least_n and (not tied or n <= most_n)").select(
        *columns,
        F.lit(True).alias("whole"),
        F.concat("beyond", "lost").alias("others"),
    )
    each = beyond.union(whole).select(
        *columns,
        "whole",
        (DEN * F.col("n") + UNIT * F.col("missing")).alias("cost"),
        F.size("others").cast("long").alias("d"),
        F.explode("others").alias("s"),
    )
    lists = each.groupBy(*SPACE, "s").agg(
        F.count(F.lit(1)).alias("k"),
        F.min("comp").alias("c0"),
        F.max("comp").alias("c1"),
    ).where("c0 != c1")
    each = _prefixed(each).drop("least_n").join(C.written(lists.select(*SPACE, "s", "k"), "lists"), [*SPACE, "s"])
    own = W.partitionBy(*SPACE, "uid")
    at = F.col("d") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("k", "s")) - 1
    return each.withColumn("at", at).where("at <= d - own").drop("k")


def row_key(id_: F.Column, text: F.Column) -> F.Column:
    """What link_rows calls row: rows with the same one are the same document."""
    return F.xxhash64(id_, text)


def link_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see link_rows."""
    return link_rows(docs, **options).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that with the least id; all rows without shingles stay."""
    rows = C.written(link_rows(docs, id_col=id_col, text_col=text_col).select("row", "doc_id", "root"), "linked").where("root is not null")
    # One of each root combines before its shuffle; rows meet it by their own key, so that no task gets a whole group.
    keep = C.written(
        rows.groupBy("root").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k")
        ).select("k.row").distinct(),
        "kept",
    )
    gone = C.written(rows.select("row").distinct().join(keep, "row", "left_anti"), "gone")
    again = C.written(
        rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row").join(gone, "row", "left_anti"),
        "again",
    )
    key = row_key(docs[id_col], C.texts(docs, text_col))
    name = "uid_" + "_".join(docs.columns)  # no column of docs has it
    left = docs.withColumn(name, key).join(_few(gone.withColumnRenamed("row", name)), name, "left_anti")
    if again.limit(1).count():
        twice = _few(again.withColumnRenamed("row", name))
        left = left.join(twice, name, "left_anti").unionByName(left.join(twice, name, "left_semi").dropDuplicates([name]))
    return left.select(*docs.columns)


def link_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (see row_key), doc_id, n_shingles, root (null without shingles), component_id of every row.

    Documents without words, null or empty, have no shingles, link with nothing and are their own component. Rows
    with equal texts link; a null id counts as an id only where a component has no other; repeated rows are rows of
    their own; an empty table gives no rows; other columns are ignored."""
    C.require(docs, id_col, text_col)
    text = C.texts(docs, text_col)
    given = docs.select(row_key(docs[id_col], text).alias("row"), docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    summary = C.written_by(given.mapInArrow(_forgetting(_summarize(frequent_shingles(given))), SUMMARY_TYPE), "summary", TEXTS_AT_ONCE)
    full = summary.where("n > 0")
    sets = C.written(full.groupBy("uid").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id")), "sets")
    texts = given.select("row", "text")

    near = full.select("uid", "n", F.col("uid").alias("comp"), F.explode("anchors").alias("anchor")).distinct()
    links = verified(C.written(_stars(near, "anchor", 2), "pairs"), sets, texts)
    labels = components(links)
    label = lambda df: df.join(
        _few(labels),
        F.col("uid") == F.col("node"),
        "left",
    ).withColumn("comp", F.coalesce("label", "uid")).drop("node", "label")
    first = full.select(
        F.lit(0).cast("long").alias("hub"),
        "uid",
        "n",
        F.lit(0).cast("long").alias("base"),
        F.lit(0).cast("long").alias("missing"),
        F.lit(False).alias("tied"),
        F.lit(False).alias("whole"),
        (DEN * F.col("n")).alias("cost"),
        F.col("n").alias("d"),
        F.ceil(DEN * F.col("n") / NUM).alias("own"),
        F.posexplode("prefix").alias("at", "s"),
    )
    open_ = label(first.select("uid", "s")).groupBy("s").agg(
        F.min("comp").alias("c0"),
        F.max("comp").alias("c1"),
    ).where("c0 != c1").select("s")
    entries = C.written(label(first).join(_few(C.written(open_, "open"), MAX_OPEN), "s", "left_semi").distinct(), "entries")
    for level in range(LEVELS):
        marked = _marked(entries, LONG_LIST if level < LEVELS - 1 else float("inf"))
        links = verified(C.written(_merged(marked), "pairs"), sets, texts)
        if not marked.where(F.col("kind") == LONG).limit(1).count():
            break
        members = _with_texts(C.written(_hubs(marked), "members"), sets, texts)
        rows = C.written_by(members.mapInArrow(_forgetting(_differ), DIFFERENCE_TYPE), "differences", PAIRS_AT_ONCE)
        links = C.written(links.union(rows.where("tied").select(F.col("uid").alias("a"), F.col("hub").alias("b"))), "links")
        labels = components(links, labels)
        entries = C.written(_differences(rows, label), "entries")
    labels = components(links, labels)
    roots = sets.join(labels, F.col("uid") == F.col("node"), "left").select("uid", "least_id", F.coalesce("label", "uid").alias("root"))
    roots = C.written(roots, "roots")
    ids = C.written(roots.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    found = roots.join(ids, "root").select("uid", "root", "component_id")
    out = summary.select("row", "doc_id", "n", F.when(F.col("n") > 0, F.col("uid")).alias("uid")).join(found, "uid", "left")
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), "root", F.coalesce("component_id", "doc_id").alias("component_id"))
