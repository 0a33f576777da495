"""JN3, JN4, JN5, SRC12. Rectangles that meet, by a quadtree that follows where they lie.

The tree is grown on the driver from a bounded sample of both sides: a node is split while it holds more than its share of
the sample. A rectangle is held by the nodes that cover it, at the leaves, or at inner nodes as soon as these are small beside
it, so that it has some rows however large it is. Two rectangles meet where the node of one lies at or below a node of the
other; the corner where their intersection begins lies in one such pair of nodes, and there the pair counts. A node that
still holds more than its share, as where all lie at one place, is dealt to several tasks by salts."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written

#: Rectangles of each side that the tree is grown from, those of them that a node holds unsplit, and how deep it grows.
SAMPLE, NODE_ROWS, DEPTH = 20_000, 100, 14
#: Places of the ground a side.
GRID = 1 << DEPTH
#: A rectangle stays at nodes of less than its greater side divided by this.
FINE = 4
#: Rows of one rectangle that meet another's together, on average.
BLOCK_ROWS = 500
#: Pairs of rows that a task unfolds, on average, and tasks at most.
TASK_PAIRS, TASKS = 2_000_000, 10_000
BOX = ("x0", "y0", "x1", "y1")


class Tree(NamedTuple):
    """The ground (x, y, side), the nodes that are split, and the salts of crowded ones. A node's number has a one, then two
    bits a step from the root: 1 is the root, 4 to 7 its quarters.

    The ground has GRID places a side, and what lies beyond it is at its outermost ones. A coordinate's place never falls as it
    grows, so what meets has places in common, wherever it lies, and each place is in one cell of a level."""

    x: float
    y: float
    side: float
    split: frozenset[int]
    salts: dict[int, int]

    def places(self, boxes: np.ndarray) -> np.ndarray:
        """The places of (n, 4) rectangles; what is no number is the greatest there is, as in comparisons of columns."""
        low = np.array([self.x, self.y, self.x, self.y])
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.clip(np.floor((boxes - low) / self.side * GRID), 0, GRID - 1)
        return np.where(np.isnan(boxes), GRID - 1, at).astype(np.int64)

    def square(self, node: int) -> tuple[int, int, int]:
        """A node's first places and how many it has a side."""
        x, y, size = 0, 0, GRID
        for k in range(node.bit_length() - 3, -1, -2):
            step, size = (node >> k) & 3, size >> 1
            x, y = x + (step & 1) * size, y + (step >> 1) * size
        return x, y, size

    def cell(self, node: int) -> tuple[float, float, float]:
        """A node's ground."""
        x, y, size = self.square(node)
        return self.x + x * self.side / GRID, self.y + y * self.side / GRID, size * self.side / GRID

    def cover(self, x0: float, y0: float, x1: float, y1: float) -> list[int]:
        """Nodes apart that together hold the rectangle."""
        return self.covered(*self.places(np.array([[x0, y0, x1, y1]]))[0].tolist())

    def covered(self, x0: int, y0: int, x1: int, y1: int) -> list[int]:
        """cover for places."""
        large, out, todo = max(x1 - x0, y1 - y0), [], [(1, 0, 0, GRID)]
        while todo:
            node, x, y, size = todo.pop()
            inside = x0 <= x and y0 <= y and x + size <= x1 + 1 and y + size <= y1 + 1
            if node not in self.split or inside or size * FINE < large:
                out.append(node)
                continue
            half = size >> 1
            for k in range(4):
                cx, cy = x + (k & 1) * half, y + (k >> 1) * half
                if x1 >= cx and y1 >= cy and x0 < cx + half and y0 < cy + half:
                    todo.append((4 * node + k, cx, cy, half))
        return out


def _grown(boxes: np.ndarray) -> Tree:
    """boxes: a sample (n, 4); a salt stands for NODE_ROWS that the sample has at a crowded node."""
    (x, far_x), (y, far_y) = (_ends(boxes[:, k::2]) for k in (0, 1))
    side = min(max(far_x - x, far_y - y, 1e-9), sys.float_info.max)
    split: set[int] = set()
    salts: dict[int, int] = {}
    todo = [(1, 0, 0, GRID, Tree(x, y, side, frozenset(), {}).places(boxes), 0)]
    while todo:
        node, cx, cy, size, held, depth = todo.pop()
        large = np.maximum(held[:, 2] - held[:, 0], held[:, 3] - held[:, 1])
        inside = (held[:, 0] <= cx) & (held[:, 1] <= cy) & (held[:, 2] + 1 >= cx + size) & (held[:, 3] + 1 >= cy + size)
        stays = inside | (size * FINE < large)
        crowd, held = len(held), held[~stays]
        if len(held) > NODE_ROWS and depth < DEPTH:
            split.add(node)
            crowd, half = int(stays.sum()), size >> 1
            for k in range(4):
                ax, ay = cx + (k & 1) * half, cy + (k >> 1) * half
                there = (held[:, 2] >= ax) & (held[:, 3] >= ay) & (held[:, 0] < ax + half) & (held[:, 1] < ay + half)
                todo.append((4 * node + k, ax, ay, half, held[there], depth + 1))
        if crowd > NODE_ROWS:
            salts[node] = -(-crowd // NODE_ROWS)
    return Tree(x, y, side, frozenset(split), salts)


def _ends(v: np.ndarray) -> tuple[float, float]:
    v = v[np.isfinite(v)]
    return (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)


def grown(*sides: DataFrame) -> Tree:
    """A tree for tables with the columns BOX, written ones, from at most SAMPLE rows of each."""
    parts = []
    for df in sides:
        n = df.count()
        some = df.select(*_doubles())
        some = some if n <= SAMPLE else some.sample(SAMPLE / n, 17).limit(SAMPLE)
        parts.append(np.array(some.collect(), float).reshape(-1, 4))
    every = np.concatenate(parts)
    return _grown(every) if len(every) else Tree(0.0, 0.0, 1.0, frozenset(), {})


def _doubles() -> list[Column]:
    return [F.col(c).cast("double").alias(f"{c}_as") for c in BOX]


_NODES = "at_x int, at_y int, home long, cell_x int, cell_y int, cell_size int, salts int"


def _homes(each: DataFrame, tree: Tree) -> DataFrame:
    """rectangle and BOX of classes' first table, a row for each node that holds the rectangle: its first places, the node, the
    node's places and salts."""
    kept = ["rectangle", *BOX]
    names = [c.split()[0] for c in _NODES.split(", ")]
    types = [pa.int64() if c == "home" else pa.int32() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, rows = [], []
            boxes = np.stack([b.column(f"{c}_as").to_numpy(zero_copy_only=False) for c in BOX], axis=1)
            for i, at in enumerate(tree.places(boxes).tolist()):
                for node in tree.covered(*at):
                    index.append(i)
                    rows.append((*at[:2], node, *tree.square(node), tree.salts.get(node, 1)))
            if rows:
                same = [b.column(c).take(pa.array(index)) for c in kept]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], [*kept, *names])

    schema = ", ".join(f"{c} {t}" for c, t in each.select(*kept).dtypes) + ", " + _NODES
    return each.select(*kept, *_doubles()).mapInArrow(run, schema)


def _above(tree: Tree) -> Column:
    """The split nodes above a node, from its parent to the root."""
    steps = F.sequence(F.lit(1), F.lit(DEPTH + 1))
    return F.filter(F.transform(steps, lambda k: F.call_function("shiftright", F.col("home"), (2 * k).cast("int"))), lambda n: n > 0)


def _known(df: DataFrame) -> DataFrame:
    return df.where(" and ".join(f"{c} is not null" for c in BOX) + " and x0 <= x1 and y0 <= y1")


def classes(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The different rectangles of df (BOX, rectangle: their number, copies: rows that have it), a written table, and df's rows
    (row: all their columns or those to keep) beside the number of theirs and `block`: a rectangle's rows are dealt to blocks of
    some BLOCK_ROWS."""
    row = F.struct(*[F.col(c) for c in keep or df.columns]).alias("row")
    rows = written(_known(df).select(*BOX, row, F.monotonically_increasing_id().alias("place")), "rows")
    each = rows.groupBy(*BOX).agg(F.count(F.lit(1)).alias("copies"))
    each = written(each.select(*BOX, "copies", F.monotonically_increasing_id().alias("rectangle")), "rectangles")
    dealt = F.pmod(F.xxhash64("place"), _blocks(F.col("copies"))).alias("block")
    return each, rows.join(each, list(BOX)).select("rectangle", dealt, "row")


def _blocks(copies: Column) -> Column:
    return F.ceil(copies / BLOCK_ROWS)


def rectangles_meeting(one: DataFrame, two: DataFrame, *, touching: bool = False) -> DataFrame:
    """rectangle, BOX and copies, with suffixes _1 and _2, of each two different rectangles (see classes) that meet: a written
    table, which doesn't grow with their copies."""
    tree = grown(one, two)
    homes = [written(_homes(df, tree), "homes") for df in (one, two)]
    pairs = _met(*homes, tree, False, touching).unionByName(_met(homes[1], homes[0], tree, True, touching))
    for k, df in ((1, one), (2, two)):
        pairs = pairs.join(df.select(*[F.col(c).alias(f"{c}_{k}") for c in ("rectangle", *BOX, "copies")]), f"rectangle_{k}")
    return written(pairs, "pairs")


def meeting(one: DataFrame, two: DataFrame, *, touching: bool = False, keep: tuple[list[str], list[str]] | None = None, facts: dict[str, Column] | None = None) -> DataFrame:
    """JN3, JN4: one's and two's columns, with suffixes _1 and _2, of each two rectangles (BOX) that have ground in common, or,
    if touching counts, a point of their edges; a row a pair.

    Rectangles without an extent in one direction have no ground but may touch; nulls in BOX meet nothing; repeated rows
    are rectangles of their own. keep: the columns of either side that are wanted. facts: columns of the two rectangles (BOX
    with the suffixes), which are computed once for all their copies.

    Different rectangles meet in the tree. Their rows come to the pairs at the end as arrays, block by block, and are unfolded
    after the last shuffle: what is moved has an entry for each block that a row's block meets, not one a pair of rows, and
    no task has all pairs of a rectangle."""
    facts = facts or {}
    sides = [classes(df, keep[k] if keep else None) for k, df in enumerate((one, two))]
    out = rectangles_meeting(sides[0][0], sides[1][0], touching=touching)
    total = out.agg(F.sum(F.col("copies_1").cast("double") * F.col("copies_2"))).first()[0] or 0.0
    ids = [f"{c}_{k}" for k in (1, 2) for c in ("rectangle", "block")]
    for k in (1, 2):
        out = out.withColumn(f"block_{k}", F.explode(F.sequence(F.lit(0).cast("long"), _blocks(F.col(f"copies_{k}")) - 1)))
    out = out.select(*ids, *[c.alias(f"fact_{n}") for n, c in facts.items()])
    for k, (_, rows) in enumerate(sides, 1):
        blocks = rows.groupBy(F.col("rectangle").alias(f"rectangle_{k}"), F.col("block").alias(f"block_{k}")).agg(F.collect_list("row").alias(f"rows_{k}"))
        out = out.join(blocks, [f"rectangle_{k}", f"block_{k}"])
    out = out.repartition(min(1 + int(total / TASK_PAIRS), TASKS), *ids)
    for k in (1, 2):
        out = out.withColumn(f"rows_{k}", F.explode(f"rows_{k}"))
    fields = [F.col(f"rows_{k}")[c].alias(f"{c}_{k}") for k, (_, rows) in enumerate(sides, 1) for c in rows.schema["row"].dataType.names]
    return out.select(*fields, *[F.col(f"fact_{n}").alias(n) for n in facts])


def counted(one: DataFrame, two: DataFrame, *, touching: bool = False) -> DataFrame:
    """SRC12: two's rows that meet any, beside `hits`, the number of one's rows that they meet (see meeting). Copies are counted,
    not paired."""
    (each_1, _), (each_2, rows_2) = classes(one), classes(two)
    hits = rectangles_meeting(each_1, each_2, touching=touching).groupBy(F.col("rectangle_2").alias("rectangle")).agg(F.sum("copies_1").alias("hits"))
    return rows_2.join(hits, "rectangle").select("row.*", "hits")


def _met(high: DataFrame, low: DataFrame, tree: Tree, turned: bool, touching: bool) -> DataFrame:
    """Pairs whose intersection begins in a node of low's at or, the other way round, below one of high's."""
    above = _above(tree)
    # At the same node once; strictly above both ways.
    nodes = above if turned else F.concat(F.array("home"), above)
    held = written(high.select("home").distinct(), "held")
    down = low.select("*", F.explode(nodes).alias("node"))
    few = held.limit(50_001).count() <= 50_000
    down = down.join((F.broadcast(held) if few else held).withColumnRenamed("home", "node"), "node", "left_semi")
    down = down.select("node", "cell_x", "cell_y", "cell_size", F.col("rectangle").alias("r"), *[F.col(c).alias(f"{c}_r") for c in (*BOX, "at_x", "at_y")])
    up = high.select(F.col("home").alias("node"), "rectangle", *BOX, "at_x", "at_y", "salts", F.lit(0).alias("part"))
    if tree.salts:
        # A crowded node's rows of one side are dealt to parts, which each meet all of the other's.
        salts = F.create_map(*[F.lit(v) for kv in tree.salts.items() for v in kv])
        up = up.withColumn("part", F.pmod(F.xxhash64("rectangle"), F.col("salts")).cast("int"))
        parts = F.coalesce(F.try_element_at(salts, F.col("node").cast("int")), F.lit(1))
        down = down.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        down = down.withColumn("part", F.lit(0))
    j = up.join(down, ["node", "part"])
    left, bottom = F.greatest("x0", "x0_r"), F.greatest("y0", "y0_r")
    right, top = F.least("x1", "x1_r"), F.least("y1", "y1_r")
    meet = (left <= right) & (bottom <= top) if touching else (left < right) & (bottom < top)
    # The cell that has the place where the intersection's lower corner lies, by whole numbers: exactly one on each side.
    in_cell = lambda v, c: (v >= F.col(c)) & (v < F.col(c) + F.col("cell_size"))
    here = in_cell(F.greatest("at_x", "at_x_r"), "cell_x") & in_cell(F.greatest("at_y", "at_y_r"), "cell_y")
    j = j.where(meet & here)
    a, b = ("r", "rectangle") if turned else ("rectangle", "r")
    return j.select(F.col(a).alias("rectangle_1"), F.col(b).alias("rectangle_2"))
