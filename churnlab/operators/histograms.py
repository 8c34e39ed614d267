"""Boosting rounds on binned rows (survey L7, L12, L16-L19, L21-L24, L29).

Spark's tree regressor samples thresholds, bins all rows and counts them anew in
every fit. Rounds that follow each other on the same rows share all of that: here
the features are binned once, into blocks of some 100,000 rows that stay cached
with the margins of their rows, and a round is a few passes over the blocks. A
pass sends every block down the tree grown so far and adds up, for the nodes that
are asked for, the statistics of each bin of each column; the driver sees these
sums (bins times nodes, whatever the number of rows), picks splits and names the
next nodes. Of two siblings only the one with fewer rows is counted, the other
is what is left of their parent. Up to ``TASK`` rows are held by one task for all
rounds, so that no pass is a job.

Columns of few bins are counted together: a cell stands for a bin of each, and the
counts of one column are sums over the cells.

The statistics are those of a weighted regression: rows have a weight b and a
target a / b, a node's value is A / B and a split removes
A_l^2 / B_l + A_r^2 / B_r - A^2 / B.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.session import ensure_checkpoint_dir

#: Rows of a block, rows that are worth a task of their own while they are binned, rows up to which one task holds them for all
#: rounds, and values that the summary of a column keeps.
BLOCK, PIECE, TASK, SUMMARY = 1 << 17, 20_000, 1 << 22, 1 << 12
#: Most cells of columns that are counted together.
CELLS = 512
#: Partitions whose sums the driver adds itself; more are added in the tasks of a further stage first.
DIRECT = 32


@dataclass
class Block:
    """Rows in a task: ``bins`` has a line for every column."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    key: np.ndarray
    held: np.ndarray        # validation rows: they move, and their loss is counted
    margin: np.ndarray
    cells: list[np.ndarray] | None = None   # of every ``together`` of the columns


def together(sizes: list[int]) -> list[tuple[int, ...]]:
    """Columns that are counted together: those of few bins, the fewest first, up to ``CELLS`` cells."""
    out, cells = [], CELLS + 1
    for j in sorted(range(len(sizes)), key=lambda j: sizes[j]):
        cells *= sizes[j]
        if cells > CELLS:
            out.append([])
            cells = sizes[j]
        out[-1].append(j)
    return [tuple(some) for some in out if len(some) > 1]


def _cells(bins: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out = []
    for some in together(sizes):
        code = np.zeros(bins.shape[1], np.uint16)
        for j in some:
            code *= np.uint16(sizes[j])
            code += bins[j]
        out.append(code)
    return out


@lru_cache(64)
def _shares(shape: tuple[int, ...], asked: tuple[int, ...]) -> np.ndarray:
    """[cell x bins of the asked ones of its columns]: 1 where the cell counts for the bin."""
    at = np.unravel_index(np.arange(np.prod(shape)), shape)
    return np.concatenate([at[i][:, None] == np.arange(shape[i]) for i in asked], axis=1).astype(np.float64)


def _pack(batches, width: int):
    """Arrow batches of rows -> one row of raw arrays per ``BLOCK`` rows."""
    names = ["x", "label", "weight", "key", "held"]

    def emit(kept):
        whole = pa.Table.from_batches(kept).combine_chunks()
        x = whole["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        rest = [whole[c].to_numpy().astype(t) for c, t in (("label", np.float64), ("weight", np.float64), ("key", np.int64), ("held", np.int8))]
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, *rest)], names)

    kept, n = [], 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            n += batch.num_rows
        if n >= BLOCK:
            yield emit(kept)
            kept, n = [], 0
    if kept:
        yield emit(kept)


def _summary(row, width: int):
    x = np.frombuffer(row["x"]).reshape(-1, width)[np.frombuffer(row["held"], np.int8) == 0]
    return [_shorter(*np.unique(c[~np.isnan(c)], return_counts=True)) for c in x.T]


def _shorter(values: np.ndarray, counts: np.ndarray):
    """At most ``SUMMARY`` values; a value that goes counts with the next that stays."""
    if len(values) <= SUMMARY:
        return values, counts
    upto = np.cumsum(counts)
    at = np.unique(np.append(np.searchsorted(upto, np.linspace(0, upto[-1], SUMMARY + 1)[1:-1]), len(values) - 1))
    return values[at], np.diff(upto[at], prepend=0)


def _merged(a, b):
    out = []
    for (va, ca), (vb, cb) in zip(a, b):
        values, at = np.unique(np.concatenate([va, vb]), return_inverse=True)
        out.append(_shorter(values, np.bincount(at, np.concatenate([ca, cb]), len(values)).astype(np.int64)))
    return out


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between neighbouring values; of more than ``bins`` values, at equal shares of the rows."""
    mid = values[:-1] / 2.0 + values[1:] / 2.0
    if len(values) > bins:
        upto = np.cumsum(counts)
        mid = mid[np.unique(np.minimum(np.searchsorted(upto, np.arange(1, bins) * (upto[-1] / bins)), len(mid) - 1))]
    return np.unique(mid)


def _binned(row, edges: list[np.ndarray], start: float, joint: bool = False) -> Block:
    label, weight = np.frombuffer(row["label"]), np.frombuffer(row["weight"])
    x = np.frombuffer(row["x"]).reshape(len(label), len(edges))
    kind = np.uint8 if all(len(e) < 256 for e in edges) else np.uint16
    bins = np.array([np.searchsorted(e, c) for e, c in zip(edges, x.T)], kind).reshape(len(edges), len(label))
    return Block(bins, label, weight, np.frombuffer(row["key"], np.int64), np.frombuffer(row["held"], np.int8) == 1, np.full(len(label), start),
                 _cells(bins, [len(e) + 1 for e in edges]) if joint else None)


@dataclass
class Grown:
    """A tree in arrays: nodes with ``left`` < 0 are leaves."""

    feature: np.ndarray
    cut: np.ndarray         # rows whose bin is at most this go left
    left: np.ndarray
    right: np.ndarray

    def node(self, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Node at which each row ends; ``start`` holds nodes on their ways."""
        at = np.zeros(bins.shape[1], np.int32) if start is None else start.copy()
        flat, first = bins.ravel(), self.feature.astype(np.int64) * bins.shape[1]
        children, splits = np.stack([self.right, self.left], axis=1).astype(np.int32).ravel(), self.left >= 0
        todo = np.flatnonzero(splits[at])
        while len(todo):
            here = at[todo]
            at[todo] = here = children[2 * here + (flat[first[here] + todo] <= self.cut[here])]
            todo = todo[splits[here]]
        return at


@dataclass(frozen=True)
class Round:
    """What a task needs to know of a round: the targets (``newton`` or else Spark's first-order ones), and which rows and columns."""

    number: int
    newton: bool
    seed: int
    rows: float
    columns: tuple[int, ...]
    squares: bool           # squares of the targets per bin, too

    def statistics(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        y = 2.0 * b.label - 1.0
        if self.newton:
            p = 1.0 / (1.0 + np.exp(-b.margin))
            return b.weight * (b.label - p), b.weight * np.maximum(p * (1.0 - p), LEAST_CURVATURE)
        return b.weight * (4.0 * y / (1.0 + np.exp(2.0 * y * b.margin)) if self.number else y), b.weight

    def drawn(self, b: Block) -> np.ndarray:
        if self.rows >= 1:
            return ~b.held
        z = b.key.astype(np.uint64) + np.uint64((self.seed * 1_000_003 + self.number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ~b.held & ((z ^ (z >> np.uint64(31))) < np.uint64(int(self.rows * (1 << 64))))


#: Least second derivative of a row: a row that the model is sure of still has a finite target.
LEAST_CURVATURE = 1e-6


@dataclass
class Known:
    """Of the rows of a block in a round: statistics, squares, which are drawn (None: all), and the weights of the two classes if
    each has one."""

    a: np.ndarray
    w: np.ndarray
    square: np.ndarray
    drawn: np.ndarray | None
    fixed: tuple[float, float] | None

    @classmethod
    def of(cls, b: Block, about: Round) -> "Known":
        with np.errstate(over="ignore"):
            a, w = about.statistics(b)
        square = np.divide(a * a, w, out=np.zeros_like(a), where=w > 0)
        drawn, fixed = about.drawn(b), None
        if not about.newton and len(w):
            of_class = [w[np.argmax(b.label == c)] for c in (0.0, 1.0)]
            if (w == np.where(b.label == 1.0, of_class[1], of_class[0])).all():
                fixed = (float(of_class[0]), float(of_class[1]))
        return cls(a, w, square, None if drawn.all() else drawn, fixed)


def _tables(code: np.ndarray, cells: int, slot: np.ndarray | None, nodes: int, by: list[np.ndarray], y: np.ndarray | None,
            fixed: tuple[float, float] | None) -> np.ndarray:
    """[count, sums of ``by`` x node x cell]; with ``fixed`` the weights, second of the sums, follow from the counts per class."""
    code = code.astype(np.intp) if slot is None else slot * cells + code
    out = np.empty((len(by) + 1 + (fixed is not None), nodes, cells))
    if fixed is None:
        out[0] = np.bincount(code, None, nodes * cells).reshape(nodes, cells)
    else:
        one = np.bincount(code[y], None, nodes * cells).reshape(nodes, cells)
        out[0] = np.bincount(code, None, nodes * cells).reshape(nodes, cells)
        out[2] = (out[0] - one) * fixed[0] + one * fixed[1]
    for k, v in zip((1, 3) if fixed is not None else range(1, len(by) + 1), by):
        out[k] = np.bincount(code, v, nodes * cells).reshape(nodes, cells)
    return out


def _count(b: Block, tree: Grown, asked: np.ndarray, sizes: list[int], about: Round, loss: bool, at: np.ndarray | None = None,
           known: Known | None = None) -> list[np.ndarray]:
    """[statistics x asked node x bin, squares per asked node, loss and number of validation rows] of a block; ``at``: the
    node of every row, if it is known."""
    known = known or Known.of(b, about)
    a, w, square, rows = known.a, known.w, known.square, None
    if len(tree.left) == 1:
        slot = None
        if known.drawn is not None:
            rows = np.flatnonzero(known.drawn)
    else:
        slot_of = np.full(len(tree.left), -1, np.intp)
        slot_of[asked] = np.arange(len(asked))
        slot = slot_of[tree.node(b.bins) if at is None else at]
        rows = np.flatnonzero(slot >= 0 if known.drawn is None else (slot >= 0) & known.drawn)
        slot = slot[rows]
    if rows is not None:
        a, w, square = a[rows], w[rows], square[rows]
    n, nodes = len(a), len(asked)
    by = [a, *([w] if known.fixed is None else []), *([square] if about.squares else [])]
    y = np.flatnonzero(b.label[rows] == 1.0 if rows is not None else b.label == 1.0) if known.fixed is not None else None
    spans = np.cumsum([0, *(sizes[j] for j in about.columns)])
    first = dict(zip(about.columns, spans.tolist()))
    out = np.zeros((4 if about.squares else 3, nodes, int(spans[-1])))
    alone = set(about.columns)
    for some, code in zip(together(sizes) if b.cells is not None else (), b.cells or ()):
        wanted, cells = [j for j in some if j in first], int(np.prod([sizes[j] for j in some]))
        if n * (len(wanted) - 1) > nodes * cells:  # else there are more cells than rows to save
            shares = _shares(tuple(sizes[j] for j in some), tuple(some.index(j) for j in wanted))
            table = _tables(code if rows is None else code[rows], cells, slot, nodes, by, y, known.fixed) @ shares
            upto = 0
            for j in wanted:
                out[:, :, first[j]:first[j] + sizes[j]] = table[:, :, upto:upto + sizes[j]]
                upto += sizes[j]
            alone -= set(wanted)
    for j in sorted(alone):
        code = b.bins[j] if rows is None else b.bins[j][rows]
        out[:, :, first[j]:first[j] + sizes[j]] = _tables(code, sizes[j], slot, nodes, by, y, known.fixed)
    held = np.zeros(2)
    if loss and b.held.any():
        z = (1.0 if about.newton else 2.0) * b.margin[b.held] * (2.0 * b.label[b.held] - 1.0)
        held = np.array([2.0 * np.logaddexp(0.0, -z).sum(), b.held.sum()])
    return [out, np.array([square.sum()]) if slot is None else np.bincount(slot, square, nodes), held]


def _sum(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


def _moved(b: Block, tree: Grown, by: np.ndarray) -> Block:
    return replace(b, margin=b.margin + by[tree.node(b.bins)])


@dataclass
class Node:
    depth: int
    bins: np.ndarray | None = None      # statistics x bin, until its children are known
    rows: int = 0
    a: float = 0.0
    b: float = 0.0
    square: float = 0.0
    gain: float = 0.0
    feature: int = -1                   # of the best split, if any
    cut: int = 0
    children: tuple[int, int] | None = None
    known: bool = False


@dataclass
class Rounds:
    """Blocks of rows on which trees are grown one after the other."""

    state: RDD
    edges: list[np.ndarray]
    growth: object
    newton: bool
    seed: int
    write_every: int
    done: int = 0
    _old: list = field(default_factory=list)
    _written: list = field(default_factory=list)
    _columns: tuple = ()

    @classmethod
    def over(cls, rows: DataFrame, n: int, width: int, growth, start: float, newton: bool, seed: int, write_every: int,
             joint: bool = True) -> "Rounds":
        """``rows``: features, label, weight, key (long), held (boolean). ``joint``: columns of few bins will be counted together."""
        context = rows.sparkSession.sparkContext
        ensure_checkpoint_dir(rows.sparkSession)
        parts = max(1, min(-(-n // PIECE), context.defaultParallelism), -(-n // (8 * BLOCK)))
        plain = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"),
                            "key", F.col("held").cast("int").alias("held"))
        packed = plain.repartition(parts).mapInArrow(partial(_pack, width=width), "x binary, label binary, weight binary, key binary, held binary").persist()
        summary = packed.rdd.map(partial(_summary, width=width)).treeReduce(_merged, 1 if parts <= DIRECT else 2)
        edges = [thresholds(*s, growth.bins) for s in summary]
        state = packed.rdd.map(partial(_binned, edges=edges, start=start, joint=joint)).persist(StorageLevel.MEMORY_AND_DISK)
        state.count()
        packed.unpersist()
        return cls(state, edges, growth, newton, seed, write_every)

    def close(self) -> None:
        for rdd in (*self._old, self.state):
            rdd.unpersist()
        self._old = []

    def count(self, tree: Grown, asked: list[int], about: Round, loss: bool = False) -> list[np.ndarray]:
        counted = partial(_count, tree=tree, asked=np.array(asked), sizes=[len(e) + 1 for e in self.edges], about=about, loss=loss)
        got = self.state.map(counted).treeReduce(_sum, 1 if self.state.getNumPartitions() <= DIRECT else 2)
        while self._old:
            self._old.pop().unpersist()
        while len(self._written) > 1:  # the margins of an earlier round, which nothing reads any more
            path = self.state.ctx._jvm.org.apache.hadoop.fs.Path(self._written.pop(0).getCheckpointFile())
            path.getFileSystem(self.state.ctx._jsc.hadoopConfiguration()).delete(path, True)
        return got

    def root(self, columns: tuple[int, ...]) -> tuple[Round, list[np.ndarray]]:
        """The round that comes next, and the counts of all its rows; with them comes the loss after the round before."""
        about = Round(self.done, self.newton, self.seed, self.growth.rows, columns, self.growth.depth is not None)
        empty = Grown(*(np.array([v]) for v in (-1, 0, -1, -1)))
        return about, self.count(empty, [0], about, loss=True)

    def move(self, tree: Grown, by: np.ndarray) -> None:
        self._old.append(self.state)
        self.done += 1
        self.state = self.state.map(partial(_moved, tree=tree, by=by)).persist(StorageLevel.MEMORY_AND_DISK)
        if self.done % self.write_every == 0:
            self.state.checkpoint()
            self._written.append(self.state)

    def grow(self, about: Round, counted: list[np.ndarray], first_depth: int, deeper: int, deepest: int) -> tuple[list[Node], list[int]]:
        """(nodes, places of the kept ones that split). Nodes are counted when best-first growth on what is known picks
        their parent; growth ends when it picks no node whose children are unknown."""
        growth = self.growth
        limit = deepest if growth.depth is None else growth.depth
        nodes = [Node(0)]
        self._learn(nodes[0], counted[0][:, 0], counted[1][0], about, limit)
        most = first_depth
        while True:
            picked = _best_first(nodes, growth.leaves)
            new = []
            for place in picked:
                node = nodes[place]
                if node.children is None:
                    node.children = (len(nodes), len(nodes) + 1)
                    nodes += [Node(node.depth + 1), Node(node.depth + 1)]
                    self._totals(node, *nodes[-2:], about)
                if not nodes[node.children[0]].known:
                    new.append(place)
            near = [p for p in new if nodes[p].depth < most]
            if new and not near:
                most += deeper
                continue
            last = [p for p in near if nodes[p].depth + 1 >= limit and growth.depth is not None]
            for place in last:  # leaves, of which the counts of their parent say all
                for child in nodes[place].children:
                    nodes[child].known = True
            near = [p for p in near if p not in last]
            if not near:
                if last:
                    continue
                return nodes, picked
            fewer = [min(nodes[p].children, key=lambda c: nodes[c].rows) for p in near]
            got, squares, _ = self.count(_arrays(nodes), fewer, about)
            for k, (place, child) in enumerate(zip(near, fewer)):
                node, other = nodes[place], sum(nodes[place].children) - child
                self._learn(nodes[child], got[:, k], squares[k], about, limit)
                self._learn(nodes[other], node.bins - got[:, k], node.square - squares[k], about, limit)
                node.bins = None

    def _spans(self, about: Round) -> tuple[np.ndarray, np.ndarray]:
        """First bin of every column of the round, and its number of bins."""
        if not self._columns or self._columns[0] != about.columns:
            sizes = np.array([len(self.edges[j]) + 1 for j in about.columns])
            self._columns = (about.columns, np.cumsum(sizes) - sizes, sizes)
        return self._columns[1:]

    def _learn(self, node: Node, bins: np.ndarray, square: float, about: Round, limit: int) -> None:
        """Totals and best split of a node from its counts."""
        firsts, sizes = self._spans(about)
        node.known, node.square = True, max(float(square), 0.0)
        node.rows, node.a, node.b = (bins[k, :sizes[0]].sum() for k in range(3))
        node.rows = int(node.rows)
        if node.depth >= limit or node.rows < 2 * self.growth.least_rows:
            return
        upto = np.cumsum(bins[:3], axis=1)
        before = np.where(firsts > 0, upto[:, firsts - 1], 0.0)
        n, a, b = upto - np.repeat(before, sizes, axis=1)
        fits = (n >= self.growth.least_rows) & (node.rows - n >= self.growth.least_rows) & (b > 0) & (node.b - b > 0)
        if not fits.any():
            return
        gain = np.full(len(n), -np.inf)
        gain[fits] = (a * a)[fits] / b[fits] + ((node.a - a) ** 2)[fits] / (node.b - b)[fits] - node.a ** 2 / node.b
        best = int(np.argmax(gain))
        if gain[best] > 1e-12 * node.square:
            j = int(np.searchsorted(firsts, best, "right")) - 1
            node.gain, node.feature, node.cut, node.bins = float(gain[best]), about.columns[j], best - int(firsts[j]), bins

    def _totals(self, node: Node, left: Node, right: Node, about: Round) -> None:
        firsts, _ = self._spans(about)
        at = firsts[about.columns.index(node.feature)]
        sums = node.bins[:, at:at + node.cut + 1].sum(axis=1)
        left.rows, left.a, left.b, left.square = int(sums[0]), *sums[1:3], sums[3] if about.squares else 0.0
        right.rows, right.a, right.b, right.square = node.rows - left.rows, node.a - left.a, node.b - left.b, max(node.square - left.square, 0.0)


@dataclass
class InTask(Rounds):
    """The same inside the one task that holds all blocks (``state``): no pass is a job of the driver's. Rows go on from the
    nodes that they reached in the pass before, and what a round knows of them is worked out once."""

    state: list[Block]
    _at: list[np.ndarray] | None = None
    _known: list[Known] | None = None
    _tree: Grown | None = None

    def close(self) -> None:
        self.state = []

    def root(self, columns: tuple[int, ...]) -> tuple[Round, list[np.ndarray]]:
        about = Round(self.done, self.newton, self.seed, self.growth.rows, columns, False)
        self._known = [Known.of(b, about) for b in self.state]
        empty = Grown(*(np.array([v]) for v in (-1, 0, -1, -1)))
        return about, self.count(empty, [0], about, loss=True)

    def count(self, tree: Grown, asked: list[int], about: Round, loss: bool = False) -> list[np.ndarray]:
        sizes = [len(e) + 1 for e in self.edges]
        self._walk(tree)
        return reduce(_sum, (_count(b, tree, np.array(asked), sizes, about, loss, at, known) for b, at, known in zip(self.state, self._at, self._known)))

    def _walk(self, tree: Grown) -> None:
        before = self._at if self._at and len(tree.left) > 1 else [None] * len(self.state)
        self._at, self._tree = [tree.node(b.bins, at) for b, at in zip(self.state, before)], tree

    def grow(self, about: Round, counted: list[np.ndarray], first_depth: int, deeper: int, deepest: int) -> tuple[list[Node], list[int]]:
        """Squares are not counted by bin: those of the last level are added up at its rows."""
        nodes, picked = super().grow(about, counted, first_depth, deeper, deepest)
        self._walk(_arrays(nodes))
        if self.growth.depth is not None:
            squares = np.zeros(len(nodes))
            for at, known in zip(self._at, self._known):
                squares += np.bincount(at, known.square if known.drawn is None else known.square * known.drawn, len(nodes))
            for place in picked:
                for child in nodes[place].children:
                    if nodes[child].depth >= self.growth.depth:
                        nodes[child].square = float(squares[child])
        return nodes, picked

    def move(self, tree: Grown, by: np.ndarray) -> None:
        """``tree``: the picked part of what was grown."""
        ends = np.arange(len(tree.left))
        for place in np.flatnonzero(self._tree.left >= 0):  # a child comes after its parent
            if tree.left[place] < 0:
                ends[self._tree.left[place]] = ends[self._tree.right[place]] = ends[place]
        moved = by[ends]
        self.done += 1
        self.state = [replace(b, margin=b.margin + moved[at]) for b, at in zip(self.state, self._at)]
        self._at = self._tree = None


def _best_first(nodes: list[Node], leaves: int | None) -> list[int]:
    """Places that split, the largest gain first among those that can be reached; unknown nodes can't split yet."""
    front, picked = [(-nodes[0].gain, 0)] if nodes[0].feature >= 0 else [], []
    while front and (leaves is None or len(picked) + 1 < leaves):
        _, place = heapq.heappop(front)
        picked.append(place)
        for child in nodes[place].children or ():
            if nodes[child].known and nodes[child].feature >= 0:
                heapq.heappush(front, (-nodes[child].gain, child))
    return picked


def _arrays(nodes: list[Node], picked: set[int] | None = None) -> Grown:
    split = [n.children is not None and (picked is None or i in picked) for i, n in enumerate(nodes)]
    return Grown(np.array([n.feature if s else -1 for n, s in zip(nodes, split)]), np.array([n.cut for n in nodes]),
                 np.array([n.children[0] if s else -1 for n, s in zip(nodes, split)]), np.array([n.children[1] if s else -1 for n, s in zip(nodes, split)]))


def finished(nodes: list[Node], picked: list[int], edges: list[np.ndarray], l2: float) -> tuple[Grown, np.ndarray, list[tuple]]:
    """(tree, value of every place, node rows in preorder as in a saved model)."""
    chosen = set(picked)
    value = np.array([n.a / (n.b + l2) if n.rows and n.b + l2 > 0 else 0.0 for n in nodes])
    order, todo, rows = {}, [0], []
    while todo:
        place = todo.pop()
        order[place] = len(order)
        if place in chosen:
            todo += reversed(nodes[place].children)
    for place, number in order.items():
        n = nodes[place]
        impurity = max(n.square / n.b - (n.a / n.b) ** 2, 0.0) if n.b > 0 else 0.0
        row = (number, float(value[place]), float(impurity), [float(n.b), float(n.a), float(n.square)], n.rows)
        if place in chosen:
            rows.append((*row, float(n.gain / n.b), order[n.children[0]], order[n.children[1]], (n.feature, [float(edges[n.feature][n.cut])], -1)))
        else:
            rows.append((*row, -1.0, -1, -1, (-1, [], -1)))
    return _arrays(nodes, chosen), value, rows
