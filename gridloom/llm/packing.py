"""Best-fit packing of documents into sequences by bin completion."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from .encode import Encoder, WordEnd, each_text, encoder

#: Steps of the search for fewer sequences than the incumbent has: fillings looked at, used or not.
MAX_NODES = 20_000
#: The deepest steps of the search that keep their place among their fillings; others find it again.
KEPT_STEPS = 32
#: Pieces of one size are numbered within groups of about this many pieces, chosen by hash.
GROUP_ROWS, MIN_GROUPS = 20_000, 64

Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over the numbers of pieces by size: (sizes in a sequence, how many such sequences)."""
    open_: dict[int, list[list]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            room = next((r for r in range(size, capacity) if open_.get(r)), None)
            if room is None:
                per = min(left, capacity // size)
                many = left // per
                open_.setdefault(capacity - per * size, []).append([(size,) * per, many])
                left -= per * many
                continue
            sizes, many = group = open_[room][-1]
            used = min(many, left)
            group[1] -= used
            if not group[1]:
                open_[room].pop()
            open_.setdefault(room - size, []).append([(*sizes, size), used])
            left -= used
    return [(tuple(p), n) for groups in open_.values() for p, n in groups]


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: pieces over capacity - k have their sequences to themselves but for pieces of k and more that
    fit beside those over half (Martello and Toth)."""
    n = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # pieces of at least that size
    mass = np.concatenate([np.cumsum((counts * np.arange(capacity + 1))[::-1])[::-1], [0]])
    half = capacity // 2 + 1
    k = np.arange(1, capacity // 2 + 1)
    over = capacity - k + 1
    mid = n[half] - n[over]
    spare = mid * capacity - (mass[half] - mass[over])
    more = -((spare - (mass[k] - mass[half])) // capacity)
    return max(-(-int(mass[0]) // capacity), int((n[over] + mid + np.maximum(0, more)).max(initial=0)))


def _widened(sums: int, by: int) -> int:
    """Sums as the bits of a number, each with the `by` numbers above it."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        sums |= sums << step
        done += step
    return sums


def _dominated(filling: Counter, left: dict[int, int], slack: int) -> bool:
    """Whether a piece that is left could stand in the place of some of the filling's, or beside them: then the filling
    with it is at least as good, as what it gives back fits wherever that piece would have gone (Martello and Toth).
    Two pieces or more may make way for one as long as they together, one or none only for a longer one."""
    single = sum(1 << y for y in filling)
    several, any_ = 0, 1  # sums of at least two, and of any number, as the bits of a number
    for y, k in filling.items():
        for _ in range(k):
            several |= (any_ & ~1) << y | several << y
            any_ |= any_ << y
    free = sum(1 << x for x, k in left.items() if k > filling.get(x, 0))
    longer = _widened((single | 1) << 1, slack - 1) if slack else 0
    return bool(free & (longer | _widened(several, slack)))


def fillings(counts: np.ndarray, largest: int, capacity: int) -> Iterator[Counter]:
    """All undominated fillings of a sequence around a piece of size `largest`, the fullest first, of equal ones those
    with longer pieces first. Dominated ones come as None, so that the caller can count them.

    For each sum from the room downwards, pieces are added from the longest on; whether the rest of a sum can be made
    of pieces up to some size is one bit of a number, so no branch is entered in vain."""
    room = capacity - largest
    left = {x: int(counts[x]) - (x == largest) for x in np.flatnonzero(counts[: room + 1]).tolist()}
    sizes = sorted(x for x, k in left.items() if k)
    reach = [1]  # by number of the shortest sizes: sums that they can make
    for x in sizes:
        sums, k, part = reach[-1], min(left[x], room // x), 1
        while k:
            part = min(part, k)
            sums |= sums << part * x
            k -= part
            part *= 2
        reach.append(sums & ((2 << room) - 1))

    def made(upto: int, target: int, chosen: Counter) -> Iterator[Counter]:
        """The ways to make the target of the first `upto` sizes, by a stack of its own: (sizes to look at, target, number to use of the last)."""
        stack = [(upto, target, 0, 0)]
        while stack:
            at, want, size, used = stack.pop()
            for x in [x for x in chosen if x < size]:
                del chosen[x]
            if size:
                chosen[size] = used
                if not used:
                    del chosen[size]
            if not want:
                yield Counter({largest: 1}) + chosen
                continue
            at = min(at, bisect_right(sizes, want))
            x = sizes[at - 1]
            for k in range(min(left[x], want // x) + 1):  # the most on top of the stack
                if reach[at - 1] >> (want - k * x) & 1:
                    stack.append((at - 1, want - k * x, x, k))

    for target in range(room, -1, -1):
        if reach[-1] >> target & 1:
            for chosen in made(len(sizes), target, Counter()):
                inner = chosen - Counter({largest: 1})
                yield None if _dominated(inner, left, room - target) else chosen


def plan_packing(counts: np.ndarray, capacity: int, max_nodes: int = MAX_NODES) -> Plan:
    """Bin completion, branch and bound, over the numbers of pieces by size.

    A step takes the largest piece left and tries its undominated fillings, the fullest first, each as often as the
    pieces allow, and then once, so that any number of times is looked at. The waste so far may not pass what the
    incumbent, at first best-fit decreasing, would have with one sequence less, nor may the bound for what is left
    reach the incumbent; what was left once isn't searched again after as many sequences. It ends at the lower bound, when all is
    searched, which proves the incumbent, or after max_nodes steps."""
    counts = np.asarray(counts, np.int64).copy()
    best = best_fit(counts, capacity)
    n_best, least = sum(n for _, n in best), least_sequences(counts, capacity)
    total = int((counts * np.arange(capacity + 1)).sum())
    seen: dict[bytes, int] = {}
    chosen: list[tuple[tuple[int, ...], int]] = []

    def options() -> Iterator[tuple[Counter, int] | None]:
        for need in fillings(counts, int(np.flatnonzero(counts)[-1]), capacity):
            if need is None:
                yield None
                continue
            n = min(int(counts[s]) // k for s, k in need.items())
            yield need, n
            if n > 1:
                yield need, 1

    def put(need: Counter, n: int) -> None:
        for s, k in need.items():
            counts[s] += k * n

    nodes = 0
    # Waste and sequences so far, the fillings to try and how many were: a list a step.
    stack: list[list] = [[0, 0, options(), 0]] if counts.any() else []
    while stack and n_best > least and nodes < max_nodes:
        waste, used, tries, tried = top = stack[-1]
        if tries is None:
            top[2] = tries = islice(options(), tried, None)
        option = next(tries, ())
        top[3] += 1
        nodes += 1
        if option is None:
            continue
        if not option:
            stack.pop()
            if chosen:
                sizes, n = chosen.pop()
                put(Counter(sizes), n)
            continue
        need, n = option
        waste, used = waste + n * (capacity - sum(s * k for s, k in need.items())), used + n
        if waste > (n_best - 1) * capacity - total:
            continue
        put(need, -n)
        state = hashlib.blake2b(counts.tobytes(), digest_size=16).digest()
        if not counts.any():
            n_best, best = used, [*chosen, (tuple(need.elements()), n)]
        elif seen.get(state, n_best) > used and used + least_sequences(counts, capacity) < n_best:
            seen[state] = used
            chosen.append((tuple(need.elements()), n))
            stack.append([waste, used, options(), 0])
            if len(stack) > KEPT_STEPS:
                stack[-KEPT_STEPS - 1][2] = None
            continue
        put(need, n)
    return best


def segments(plan: Plan) -> dict[int, np.ndarray]:
    """By size: rows (first rank, sequence base, how many sequences, offset) of the slots that pieces of that size fill
    in order of their rank."""
    out: dict[int, list] = {}
    rank: Counter = Counter()
    base = 0
    for sizes, n in plan:
        at = 0
        for size, k in sorted(Counter(sizes).items(), reverse=True):
            for _ in range(k):
                out.setdefault(size, []).append((rank[size], base, n, at))
                rank[size] += n
                at += size
        base += n
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pack_pieces(
    pieces: DataFrame,
    capacity: int,
    *,
    size_col: str = "length",
    key_cols: tuple[str, ...] = ("doc_id", "piece"),
) -> DataFrame:
    """pieces with sequence_id and offset. Sizes are from 1 to capacity. pieces is read twice: give a written table.

    Pieces of one size are alike, so the plan is made of the numbers of pieces by size, at most `capacity` rows,
    whatever the input; a piece's rank among those of its size says which slot it takes. Ranks come from counts by
    (hash group, size) and ranks within these, so a size that most pieces have is spread over the groups."""
    n = pieces.count()
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy(size_col).agg(F.count(F.lit(1)).alias("n")).collect():
        hist[r[size_col]] = r["n"]
    table = segments(plan_packing(hist, capacity))
    groups = max(MIN_GROUPS, n // GROUP_ROWS)
    rows = pieces.withColumn("g", F.pmod(F.xxhash64(*key_cols), F.lit(groups)))
    counts = rows.groupBy(size_col, "g").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn(
        "before",
        F.coalesce(F.sum("n").over(W.partitionBy(size_col).orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("n")
    inside = W.partitionBy(size_col, "g").orderBy(*[F.col(c) for c in pieces.columns])
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1).join(counts, [size_col, "g"]).withColumn("rank", F.col("rank") + F.col("before"))
    rows = rows.select(*pieces.columns, F.col("rank").cast("long").alias("rank"))
    name = size_col

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, rank = b.column(name).to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            seq, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            order = np.argsort(sizes, kind="stable")
            cuts = np.flatnonzero(np.diff(sizes[order])) + 1
            for own in np.split(order, cuts) if len(order) else ():
                t = table[int(sizes[own[0]])]
                k = np.searchsorted(t[:, 0], rank[own], "right") - 1
                seq[own], at[own] = t[k, 1] + rank[own] - t[k, 0], t[k, 3]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(seq), pa.array(at)],
                [*b.schema.names[:-1], "sequence_id", "offset"],
            )

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(place, schema)


PIECE_TYPE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutting(kind: type[Encoder], path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(kind, path)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column("doc_id"), each_text(b.column("text"))):
                ids = enc.ids(text) + end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    for col, v in zip(out, (i.as_py(), k, s // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 2048,
    end_id: int = 0,
    kind: type[Encoder] = WordEnd,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A document is its ids, then end_id; one of more than capacity ids is cut into pieces of capacity. Null text has
    end_id alone; repeated rows are pieces of their own; an empty table gives no rows; other columns are ignored.
    Plan: the texts are encoded once, to a small table of pieces; no text or id is shuffled."""
    C.require(docs, id_col, text_col)
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), C.texts(docs, text_col).alias("text"))
    pieces = C.written(given.mapInArrow(_cutting(kind, tokenizer_path, end_id, capacity), PIECE_TYPE), "pieces")
    return pack_pieces(pieces, capacity)
