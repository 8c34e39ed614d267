"""Random forests on binned rows (survey L10, L11, L13-L15, L19, L20, L23, L24, L26, L28, EV17).

Spark's forest grows all trees level by level from the driver, which holds every node of every tree, and a loaded
model is sent whole to every task. Here rows are binned once (``histograms``) and

* nodes of more than ``WHOLE`` drawn rows are split by passes over the blocks, which add up class counts per bin of the
  columns drawn for each node, in batches of at most ``SUMS`` bytes;
* smaller nodes are finished in tasks: their rows are shuffled there and all levels below grow without the driver. If no
  node is larger, a task gets all rows once for its share of the trees;
* finished parts go to a table below the shared folder, a row each. The driver holds only the tops above them, some
  rows / ``WHOLE`` nodes a tree. Scoring tasks read the table part by part.

The trees are Spark's: Poisson draws of rows, columns drawn per node, Gini gain of weighted class counts, at most 32
bins, and sibling leaves of one prediction become one leaf (when scored). Parts keep the counts of all nodes, so limits
(``limited``) are set on the fitted forest without writing it anew.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.operators import histograms
from churnlab.operators.newton import Growth
from churnlab.session import scratch_folder

#: Drawn rows up to which a node is finished in one task (at most 2**22), bytes of the sums of a pass, rows that are scored
#: at once, rows that are worth a reading of all trees, and rows from which a node is counted by bins instead of sorted.
WHOLE, SUMS, SCORED, FEWEST, LARGE = 1 << 22, 1 << 26, 1 << 17, 1 << 16, 64
BINS = 32
#: Votes are added as whole numbers of this unit: the order of the parts doesn't matter.
UNIT = 1 << 44
LEAF, BELOW = -1, -2        # features of a leaf, and of a top's node that goes on in a part
_POISSON = np.searchsorted(np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)

_FIELDS = {"feature": np.int16, "threshold": np.float64, "left": np.int32, "level": np.uint8, "rows": np.int64, "weight": np.float64, "p": np.float64}
_TABLE = "tree int, node int, " + ", ".join(f"{f} binary" for f in _FIELDS)


@dataclass(frozen=True)
class Forest:
    """How trees grow; the parameters of Spark's forests, and the least drawn rows of a node that splits."""

    trees: int = 20
    depth: int = 5
    least_rows: int = 1
    min_split: int = 2
    columns: str = "auto"
    seed: int = 42

    def drawn_columns(self, width: int) -> int:
        kind = ("sqrt" if self.trees > 1 else "all") if self.columns == "auto" else self.columns
        if kind in ("all", "sqrt", "log2"):
            return {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width)))}[kind]
        raise ValueError(f"unknown way to draw columns: {kind}")


def forest_of(params: dict, seed: int = 42) -> Forest:
    """A forest from the parameters of a recipe, which are named as Spark's where Spark has them."""
    names = {"numTrees": "trees", "maxDepth": "depth", "minInstancesPerNode": "least_rows", "minRowsToSplit": "min_split",
             "featureSubsetStrategy": "columns"}
    return Forest(**{names[k]: v for k, v in params.items()}, seed=seed)


@dataclass
class Part:
    """Nodes of a tree level by level; the right child follows the left one."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    level: np.ndarray
    rows: np.ndarray        # drawn rows, repeats counted
    weight: np.ndarray
    p: np.ndarray           # weighted share of class 1

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f), t).tobytes() for f, t in _FIELDS.items()]

    @classmethod
    def of(cls, row) -> "Part":
        return cls(*[np.frombuffer(row[f], t) for f, t in _FIELDS.items()])

    def cut(self, max_depth: int | None, min_split: int, merge: bool = True) -> np.ndarray:
        """Features of the nodes after pruning, and after merging leaves of one prediction."""
        feature = self.feature.copy()
        feature[self.rows < min_split] = LEAF
        if max_depth is not None:
            feature[self.level >= max_depth] = LEAF
        return self.merged(feature) if merge else feature

    def merged(self, feature: np.ndarray) -> np.ndarray:
        one = self.p > 0.5
        at = np.searchsorted(self.level, np.arange(int(self.level[0]), int(self.level[-1]) + 2))
        for a, b in zip(at[:-1][::-1], at[1:][::-1]):
            inner = a + np.flatnonzero(feature[a:b] >= 0)
            x = self.left[inner]
            feature[inner[(feature[x] == LEAF) & (feature[x + 1] == LEAF) & (one[x] == one[x + 1])]] = LEAF
        return feature

    def find(self, feature: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Node at which each row of ``x`` ends."""
        at, todo, flat, width = np.zeros(len(x), np.int64), np.arange(len(x)), x.ravel(), x.shape[1]
        while True:
            here = at.take(todo)
            split = feature.take(here)
            goes = np.flatnonzero(split >= 0)
            if not len(goes):
                return at
            if len(goes) < len(todo):
                todo, here, split = todo.take(goes), here.take(goes), split.take(goes)
            at[todo] = self.left.take(here) + ~(flat.take(todo * width + split) <= self.threshold.take(here))

    def stops(self, cuts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(features of the nodes that split after any of the cuts; for each cut, where a row stops that ends at a node of these)."""
        loosest, out = np.where(np.max(cuts, axis=0) >= 0, self.feature, LEAF), []
        at = np.searchsorted(self.level, np.arange(int(self.level[0]), int(self.level[-1]) + 2))
        inner = [a + np.flatnonzero(loosest[a:b] >= 0) for a, b in zip(at[:-1], at[1:])]
        for cut in cuts:
            stop = np.arange(len(cut))
            for i in inner:
                goes, left = (cut[i] >= 0) & (stop[i] == i), self.left[i]
                stop[left], stop[left + 1] = np.where(goes, left, stop[i]), np.where(goes, left + 1, stop[i])
            out.append(stop)
        return loosest, out


@dataclass
class Best:
    """Best splits of some nodes: what they remove, column, last bin on the left, and counts and weights per class there."""

    gain: np.ndarray
    column: np.ndarray
    cut: np.ndarray
    count: np.ndarray
    weight: np.ndarray

    @classmethod
    def none(cls, n: int) -> "Best":
        return cls(np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros((n, 2)), np.zeros((n, 2)))

    def take(self, ids, gain, column, cut, count, weight) -> None:
        better = gain > self.gain[ids]
        at = ids[better]
        for mine, new in ((self.gain, gain), (self.column, column), (self.cut, cut), (self.count, count), (self.weight, weight)):
            mine[at] = new[better]


def _removed(total: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Weighted Gini impurity (half of it) that a split removes."""
    right = total - left
    with np.errstate(invalid="ignore", divide="ignore"):
        half = [v[..., 0] * v[..., 1] / (v[..., 0] + v[..., 1]) for v in (total, left, right)]
    return half[0] - half[1] - half[2]


def best_counted(best: Best, ids: np.ndarray, columns: np.ndarray, counts: np.ndarray, weights: np.ndarray, least: int) -> None:
    """``counts``, ``weights``: node x bin x class of one drawn column of each node."""
    upto, w = np.cumsum(counts, axis=1), np.cumsum(weights, axis=1)
    n, whole = upto[:, -1:], w[:, -1:]
    upto, w = upto[:, :-1], w[:, :-1]
    left, gain = upto.sum(2), _removed(whole, w)
    ok = (left >= least) & (n.sum(2) - left >= least) & (gain > 1e-12 * whole.sum(2))
    gain = np.where(ok, gain, 0.0)
    cut, at = np.argmax(gain, axis=1), np.arange(len(ids))
    best.take(ids, gain[at, cut], columns, cut, upto[at, cut], w[at, cut])


def class_codes(at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cell of bin 0 for every row; bin ``b`` lies 2b cells further on."""
    return at * (BINS * 2) + y


def class_counts(bins: np.ndarray, codes: np.ndarray, by: list[np.ndarray], nodes: int) -> list[np.ndarray]:
    """node x bin x class of one column, for each of the weights ``by``."""
    cell = codes + (bins << 1)
    return [np.bincount(cell, v, nodes * BINS * 2).reshape(nodes, BINS, 2) for v in by]


def _best_sorted(best: Best, ids: np.ndarray, columns: np.ndarray, bins: np.ndarray, at: np.ndarray, y: np.ndarray, c: np.ndarray, v: np.ndarray,
                 least: int) -> None:
    """The same from the rows of small nodes, sorted by node and bin; every node has a row."""
    key = np.sort(((at * BINS + bins) << 22) | np.arange(len(at)))
    order, key = key & ((1 << 22) - 1), key >> 22
    node, y, c, v = key // BINS, y[order], c[order], v[order]
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    ends = np.append(starts[1:], len(node)) - 1
    edge = np.flatnonzero(np.diff(key)[: len(key) - 1] != 0) if len(key) > 1 else np.zeros(0, np.int64)
    edge = edge[node[edge] == node[edge + 1]]
    if not len(edge):
        return
    side = y[:, None] == np.arange(2)
    upto = [np.cumsum(side * s[:, None], axis=0) for s in (c, v)]
    before = [u[starts] - side[starts] * s[starts, None] for u, s in zip(upto, (c, v))]
    at_edge = node[edge]
    count, weight = (u[edge] - b[at_edge] for u, b in zip(upto, before))
    n, whole = (u[ends] - b for u, b in zip(upto, before))
    left, gain = count.sum(1), _removed(whole[at_edge], weight)
    ok = (left >= least) & (n.sum(1)[at_edge] - left >= least) & (gain > 1e-12 * whole.sum(1)[at_edge])
    if not ok.any():
        return
    edge, at_edge, gain, count, weight = (z[ok] for z in (edge, at_edge, gain, count, weight))
    firsts = np.flatnonzero(np.diff(at_edge, prepend=-1))
    top = np.maximum.reduceat(gain, firsts)
    hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(firsts, len(gain)))))
    hit = hit[np.unique(at_edge[hit], return_index=True)[1]]
    here = at_edge[hit]
    best.take(ids[here], gain[hit], columns[here], key[edge[hit]] % BINS, count[hit], weight[hit])


def _best_packed(best: Best, ids: np.ndarray, columns: np.ndarray, key: np.ndarray, totals: np.ndarray, fixed: np.ndarray, least: int) -> None:
    """The same where a class has one weight. ``key``: node, bin (5 bits), class (1 bit) and draws (7 bits) of every row, of
    which the class and the draws need no look-up after the sort; both classes are added up at once, in the halves of a
    whole number."""
    key.sort()
    place = key >> 8
    ends = np.flatnonzero(place[1:] != place[:-1])
    node = place[ends] >> 5
    inside = node == place[ends + 1] >> 5
    ends, node = ends[inside], node[inside]
    if not len(ends):
        return
    upto = np.cumsum((key & 127).astype(np.int64) << ((key >> 2) & 32))[ends]
    whole = totals[:, 0].astype(np.int64) + (totals[:, 1].astype(np.int64) << 32)
    upto -= (np.cumsum(whole) - whole)[node]
    count = [(upto & 0xFFFFFFFF).astype(np.float64), (upto >> 32).astype(np.float64)]
    weighted = totals * fixed
    half = lambda x, y: x * y / (x + y)
    left, every = [c * f for c, f in zip(count, fixed)], [weighted[:, i][node] for i in (0, 1)]
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = half(*weighted.T)[node] - half(*left) - half(every[0] - left[0], every[1] - left[1])
    ok = gain > 1e-12 * weighted.sum(1)[node]
    if least > 1:
        n = count[0] + count[1]
        ok &= (n >= least) & (totals.sum(1)[node] - n >= least)
    at = np.flatnonzero(ok)
    if not len(at):
        return
    node, gain = node[at], gain[at]
    firsts = np.flatnonzero(np.diff(node, prepend=-1))
    top = np.maximum.reduceat(gain, firsts)
    hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(firsts, len(gain)))))
    hit = hit[np.flatnonzero(np.diff(node[hit], prepend=-1))]
    here, at = node[hit], at[hit]
    sides = np.stack([count[0][at], count[1][at]], 1)
    best.take(ids[here], gain[hit], columns[here], place[ends[at]] & (BINS - 1), sides, sides * fixed)


def draw_columns(rng: np.random.Generator, nodes: int, width: int, k: int) -> np.ndarray:
    if k >= width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.argpartition(rng.random((nodes, width), np.float32), k, axis=1)[:, :k]


def _one_weight(label: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
    """Weights of the classes, if each has one."""
    found = [weight[label == j] for j in (0, 1)]
    return np.array([w[0] if len(w) else 0.0 for w in found]) if all(len(w) == 0 or w.min() == w.max() for w in found) else None


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, drawn: np.ndarray, how: Forest, edges: list[np.ndarray], rng: np.random.Generator,
         level: int = 0) -> Part:
    """A tree, or the part of one from a node on ``level`` down; ``bins`` has a line for every row."""
    width, flat = bins.shape[1], bins.ravel()
    k, fixed = how.drawn_columns(width), _one_weight(label, weight)
    rows = np.flatnonzero(drawn)
    # Number, class (1 bit) and draws (7 bits) of a row in one number; its weight only where a class has several.
    tag = rows << 8 | label[rows].astype(np.int64) << 7 | drawn[rows]
    v = None if fixed is not None else drawn[rows] * weight[rows]
    y, c = label[rows], drawn[rows]
    count = np.bincount(y, c, 2)[None, :]
    whole = count * fixed if fixed is not None else np.bincount(y, v, 2)[None, :]
    at = np.zeros(len(rows), np.int32)
    del rows, y, c
    steps = np.zeros((width, BINS))
    for j, e in enumerate(edges):
        steps[j, :len(e)] = e
    out, done = [], 0
    while True:
        n = count.sum(1)
        can = (n >= max(2 * how.least_rows, how.min_split)) & (count > 0).all(1) & (level < how.depth)
        ids = np.flatnonzero(can)
        slot = np.full(len(n), -1, np.int32)
        slot[ids] = np.arange(len(ids))
        at = slot.take(at)
        tag, at, v = _staying(at >= 0, tag, at, v)
        best, columns = Best.none(len(ids)), draw_columns(rng, len(ids), width, k)
        large = np.bincount(at, minlength=len(ids)) >= LARGE
        for some, counted in ((large, True), (~large, False)):
            mine = np.flatnonzero(some)
            if not len(mine):
                continue
            a, g, vv = at, tag, v
            if len(mine) < len(ids):
                new = np.full(len(ids), -1, np.int32)
                new[mine] = np.arange(len(mine))
                a = new.take(at)
                g, a, vv = _staying(a >= 0, tag, a, v)
            r = (g >> 8) * width
            if counted:
                codes, by = class_codes(a.astype(np.int64), (g >> 7) & 1), [(g & 127).astype(np.float64), *([] if vv is None else [vv])]
            elif fixed is not None:
                kind, totals = np.int32 if len(mine) < 1 << 18 else np.int64, count[ids[mine]]
                low = a.astype(kind) << 13 | (g & 255).astype(kind)
            for j in range(k):
                column = columns[mine, j]
                b = flat.take(r + (column.take(a) if len(mine) > 1 else column[0]))
                if counted:
                    h, *w = class_counts(b, codes, by, len(mine))
                    best_counted(best, mine, column, h, w[0] if w else h * fixed, how.least_rows)
                elif fixed is not None:
                    _best_packed(best, mine, column, b.astype(kind) << 8 | low, totals, fixed, how.least_rows)
                else:
                    _best_sorted(best, mine, column, b.astype(np.int64), a.astype(np.int64), (g >> 7) & 1, (g & 127).astype(np.float64), vv, how.least_rows)
        split = np.flatnonzero(best.column >= 0)
        feature, threshold, left = np.full(len(n), LEAF), np.zeros(len(n)), np.full(len(n), -1)
        feature[ids[split]] = best.column[split]
        threshold[ids[split]] = steps[best.column[split], best.cut[split]]
        left[ids[split]] = done + len(n) + 2 * np.arange(len(split))
        total = whole.sum(1)
        share = np.divide(whole[:, 1], total, out=np.zeros(len(n)), where=total > 0)
        out.append([z.astype(t) for z, t in zip((feature, threshold, left, np.full(len(n), level), n, total, share), _FIELDS.values())])
        if not len(split):
            return Part(*[np.concatenate(z) for z in zip(*out)])
        rank = np.full(len(ids), -1, np.int32)
        rank[split] = np.arange(len(split))
        tag, at, v = _staying(rank.take(at) >= 0, tag, at, v)
        goes = flat.take((tag >> 8) * width + best.column.take(at)) > best.cut.take(at)
        at = 2 * rank.take(at) + goes
        sides = np.stack((best.count[split], count[ids[split]] - best.count[split]), 1).reshape(-1, 2)
        if fixed is None:
            whole = np.stack((best.weight[split], whole[ids[split]] - best.weight[split]), 1).reshape(-1, 2)
        else:
            whole = sides * fixed
        count, done, level = sides, done + len(n), level + 1


def _staying(stays: np.ndarray, tag: np.ndarray, at: np.ndarray, v: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    if stays.all():
        return tag, at, v
    here = np.flatnonzero(stays)
    return tag.take(here), at.take(here), None if v is None else v.take(here)


# ------------------------------------------------------------------ tasks
def _numbered(part: int, blocks) -> Iterator[tuple]:
    """((partition, block), bins by row, label, weight) of every block."""
    for i, b in enumerate(blocks):
        yield (part, i), np.ascontiguousarray(b.bins.T), (b.label > 0).astype(np.uint8), b.weight


def _drawn(how: Forest, tree: int, place: tuple[int, int], n: int) -> np.ndarray:
    """How often a tree draws each row of a block: reruns agree."""
    return _POISSON[np.random.default_rng([how.seed, tree, *place]).integers(0, 1 << 16, n, np.uint16)]


def _rng(how: Forest, tree: int, node: int, level: int) -> np.random.Generator:
    return np.random.default_rng([how.seed, tree, node, level, 1])


def _whole_trees(chunks, how: Forest, edges: list[np.ndarray], groups: int) -> Iterator[tuple]:
    """Trees of one group from all rows."""
    got = sorted(chunks, key=lambda c: c[1][0])
    if not got:
        return
    group, places = got[0][0], [c[1][0] for c in got]
    sizes = [len(c[1][2]) for c in got]
    bins, label, weight = (np.empty((sum(sizes), *z.shape[1:]), z.dtype) for z in got[0][1][1:])
    upto = sum(sizes)
    while got:  # a chunk goes as soon as it is copied
        (_, (_, *held)), a = got.pop(), upto - sizes[len(got)]
        for whole, z in zip((bins, label, weight), held):
            whole[a:upto] = z
        upto = a
    for tree in range(group, how.trees, groups):
        drawn = np.concatenate([_drawn(how, tree, p, n) for p, n in zip(places, sizes)])
        yield (tree, 0, *grow(bins, label, weight, drawn, how, edges, _rng(how, tree, 0, 0)).packed())


def _in_bins(top: Part, edges: list[np.ndarray]) -> Part:
    cut = np.array([np.searchsorted(edges[f], t) if f >= 0 else 0 for f, t in zip(top.feature, top.threshold)], np.float64)
    return Part(top.feature, cut, top.left, top.level, top.rows, top.weight, top.p)


def _top_sums(chunk, how: Forest, tops: dict[int, Part], asked: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """[drawn column x (count, weight) x node x bin x class] of the asked nodes: (tree, nodes, columns of each)."""
    place, bins, label, weight = chunk
    out = []
    for tree, nodes, columns in asked:
        c = _drawn(how, tree, place, len(label)).astype(np.float64)
        slot = np.full(len(tops[tree].feature), -1)
        slot[nodes] = np.arange(len(nodes))
        at = slot[tops[tree].find(tops[tree].feature, bins)]
        rows = np.flatnonzero((at >= 0) & (c > 0))
        at, y, c = at[rows], label[rows].astype(np.int64), c[rows]
        v, r, flat = c * weight[rows], rows * bins.shape[1], bins.ravel()
        codes = class_codes(at, y)
        out.append(np.array([class_counts(flat[r + columns[at, j]], codes, [c, v], len(nodes)) for j in range(columns.shape[1])]))
    return np.concatenate(out, axis=2)


def _send(chunk, how: Forest, tops: dict[int, Part]) -> Iterator[tuple]:
    """The drawn rows of a block, to the parts that they belong to."""
    place, bins, label, weight = chunk
    for tree, top in tops.items():
        drawn = _drawn(how, tree, place, len(label))
        rows = np.flatnonzero(drawn)
        node = top.find(top.feature, bins[rows])
        order = rows[np.argsort(node, kind="stable")]
        nodes, first = np.unique(np.sort(node), return_index=True)
        for n, a, b in zip(nodes.tolist(), first, np.append(first[1:], len(order))):
            if top.feature[n] == BELOW:
                some = order[a:b]
                yield (tree, n), (place, bins[some], label[some], weight[some], drawn[some])


def _finish(group, how: Forest, edges: list[np.ndarray], levels: dict[tuple[int, int], int]) -> tuple:
    (tree, node), chunks = group
    got = sorted(chunks, key=lambda c: c[0])
    bins, label, weight, drawn = (np.concatenate([c[i] for c in got]) for i in (1, 2, 3, 4))
    level = levels[tree, node]
    return (tree, node, *grow(bins, label, weight, drawn, how, edges, _rng(how, tree, node, level), level).packed())


# ------------------------------------------------------------------ driver
def _tops(blocks, how: Forest, edges: list[np.ndarray], width: int, levels: int) -> dict[int, Part]:
    """Tops of all trees: nodes of more than ``WHOLE`` drawn rows split, the others go on below."""
    k = how.drawn_columns(width)
    grown = {t: {f: [x] for f, x in zip(_FIELDS, (BELOW, 0.0, -1, 0, 0, 0.0, 0.0))} for t in range(how.trees)}
    parts = lambda: {t: Part(*[np.array(g[f], d) for f, d in _FIELDS.items()]) for t, g in grown.items()}
    front = [(t, 0, True) for t in grown]
    while front:
        now, tops, following = {}, {t: _in_bins(p, edges) for t, p in parts().items()}, []
        batch = max(1, SUMS // (k * 2 * BINS * 2 * 8))
        for a in range(0, len(front), batch):
            asked = {}
            for tree, node, _ in front[a:a + batch]:
                asked.setdefault(tree, []).append(node)
            jobs = []
            for tree, nodes in asked.items():
                drawn = np.concatenate([draw_columns(_rng(how, tree, n, 0), 1, width, k) for n in nodes])
                jobs.append((tree, np.array(nodes), drawn))
            sums = blocks.map(partial(_top_sums, how=how, tops={t: tops[t] for t in asked}, asked=jobs)).treeReduce(lambda x, y: x + y, levels)
            places = [(t, n) for t, nodes, _ in jobs for n in nodes.tolist()]
            columns, best, ids = np.concatenate([c for _, _, c in jobs]), Best.none(len(places)), np.arange(len(places))
            for j in range(k):
                best_counted(best, ids, columns[:, j], sums[j, 0], sums[j, 1], how.least_rows)
            count, whole = sums[0, 0].sum(1), sums[0, 1].sum(1)
            for i, place in enumerate(places):
                now[place] = (best, i, count[i], whole[i])
        for tree, node, is_root in front:
            best, i, count, whole = now[tree, node]
            g = grown[tree]
            if is_root:
                g["rows"][node], g["weight"][node] = int(count.sum()), float(whole.sum())
                g["p"][node] = float(whole[1] / whole.sum()) if whole.sum() > 0 else 0.0
                if count.sum() <= WHOLE:
                    continue
            level = g["level"][node]
            if level >= how.depth or count.sum() < max(2 * how.least_rows, how.min_split) or best.column[i] < 0:
                g["feature"][node] = LEAF
                continue
            column, cut = int(best.column[i]), int(best.cut[i])
            g["feature"][node], g["threshold"][node], g["left"][node] = column, float(edges[column][cut]), len(g["feature"])
            for n, w in ((best.count[i], best.weight[i]), (count - best.count[i], whole - best.weight[i])):
                child = len(g["feature"])
                share = float(w[1] / w.sum()) if w.sum() > 0 else 0.0
                ends = level + 1 >= how.depth or (n == 0).any()
                for f, x in zip(_FIELDS, (LEAF if ends else BELOW, 0.0, -1, level + 1, int(n.sum()), float(w.sum()), share)):
                    g[f].append(x)
                if not ends and n.sum() > WHOLE:
                    following.append((tree, child, False))
        front = following
    return parts()


def fit_forest(train: DataFrame, how: Forest) -> "ForestModel":
    """A forest on (features, label 0 or 1, optional weight)."""
    spark, context = train.sparkSession, train.sparkSession.sparkContext
    first = train.select("features").first()
    if first is None:
        raise ValueError("a forest needs rows")
    n, width = train.count(), first[0].size
    weight = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    rows = train.select("features", "label", weight.alias("weight"), F.lit(0).cast("long").alias("key"), F.lit(False).alias("held"))
    work = histograms.Rounds.over(rows, n, width, Growth(bins=BINS), 0.0, False, how.seed, 1, joint=False)
    path, edges = scratch_folder(spark, "forest"), work.edges
    try:
        blocks = work.state.mapPartitionsWithIndex(_numbered)
        # The draws of a tree add up to about n rows; a margin of six standard deviations.
        if n + 6 * math.sqrt(n) <= WHOLE:
            tops, groups = {}, min(how.trees, 2 * context.defaultParallelism)
            sent = blocks.flatMap(lambda chunk: ((g, chunk) for g in range(groups))).partitionBy(groups, int)
            made = sent.mapPartitions(partial(_whole_trees, how=how, edges=edges, groups=groups))
        else:
            tops = _tops(blocks, how, edges, width, 1 if work.state.getNumPartitions() <= histograms.DIRECT else 2)
            levels = {(t, i): int(p.level[i]) for t, p in tops.items() for i in np.flatnonzero(p.feature == BELOW).tolist()}
            binned = {t: _in_bins(p, edges) for t, p in tops.items()}
            sent = blocks.flatMap(partial(_send, how=how, tops=binned)).groupByKey(max(context.defaultParallelism, min(len(levels), 4096)))
            made = sent.map(partial(_finish, how=how, edges=edges, levels=levels))
            spark.createDataFrame([(t, -1, *p.packed()) for t, p in tops.items()], _TABLE).write.parquet(path)
        spark.createDataFrame(made.map(lambda r: (*r[:2], *map(bytearray, r[2:]))), _TABLE, verifySchema=False).write.mode("append").parquet(path)
    finally:
        work.close()
    return ForestModel(path, how.trees, width, tops)


def _parts(path: str, trees: int) -> Iterator[tuple[int, int, Part]]:
    """Parts of the first trees, read one by one. A path without a scheme is local; ``s3a`` and ``s3n`` are S3."""
    scheme, _, rest = path.partition("://")
    uri = f"s3://{rest}" if scheme in ("s3a", "s3n") else path
    fs, root = pafs.FileSystem.from_uri(uri) if rest or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
    for file in files:
        with fs.open_input_file(file) as f:
            for batch in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(1):
                row = batch.slice(0, 1).to_pylist()[0]
                if row["node"] >= 0 and row["tree"] < trees:
                    yield row["tree"], row["node"], Part.of(row)


class ForestModel(Model, MLWritable, MLReadable):
    """A fitted forest as a table of parts. Adds rawPrediction, probability and prediction to (features)."""

    def __init__(self, path: str, trees: int, width: int, tops: dict[int, Part], max_depth: int | None = None, min_split: int = 0):
        super().__init__()
        self.path, self.trees, self.width, self.tops, self.max_depth, self.min_split = path, trees, width, tops, max_depth, min_split

    @property
    def getNumTrees(self) -> int:
        return self.trees

    def limited(self, trees: int | None = None, max_depth: int | None = None, min_split: int = 0) -> "ForestModel":
        """The forest with its first ``trees`` trees, each pruned to a depth and to a least number of drawn rows that split."""
        other = copy.copy(self)
        other.trees = min(trees or self.trees, self.trees)
        other.max_depth = min((d for d in (max_depth, self.max_depth) if d is not None), default=None)
        other.min_split = max(min_split, self.min_split)
        return other

    def _cut_tops(self, spark: SparkSession) -> dict[int, np.ndarray]:
        """Features of the tops: siblings of one prediction become one leaf there too if their parts are leaves."""
        limits = (self.max_depth, self.min_split)
        cut = {t: p.cut(*limits, merge=False) for t, p in self.tops.items() if t < self.trees}
        if cut:
            def leaves(rows):
                return ((r["tree"], r["node"]) for r in rows if Part.of(r).cut(*limits)[0] == LEAF)

            for t, node in spark.read.parquet(self.path).where((F.col("node") >= 0) & (F.col("tree") < self.trees)).rdd.mapPartitions(leaves).collect():
                cut[t][node] = LEAF
        return {t: self.tops[t].merged(f) for t, f in cut.items()}

    def shares(self, spark: SparkSession, limits: list[dict]):
        """Column: the probability of class 1 by each limited forest, as an array. The parts are read once for all of them, and a
        row goes down a tree once: a limit ends its way at a node that it passes."""
        path, width, wanted = self.path, self.width, [self.limited(**some) for some in limits]
        cuts = list(dict.fromkeys((m.max_depth, m.min_split) for m in wanted))
        most, users = max(m.trees for m in wanted), [[(i, m.trees) for i, m in enumerate(wanted) if (m.max_depth, m.min_split) == cut] for cut in cuts]
        units = np.array([[UNIT * m.trees] for m in wanted])
        vote = lambda p: np.rint(p * UNIT).astype(np.int64)
        features, tops = [self.limited(most, *cut)._cut_tops(spark) for cut in cuts], {}
        for t in features[0]:
            mine = [f[t] for f in features]
            loosest, stops = self.tops[t].stops(mine)
            ends = [np.where(f[stop] == LEAF, vote(self.tops[t].p)[stop], 0) for f, stop in zip(mine, stops)]
            below = np.array([(f == BELOW) & (stop == np.arange(len(f))) for f, stop in zip(mine, stops)])
            tops[t] = (self.tops[t], loosest, ends, below)

        def score(x: np.ndarray) -> np.ndarray:
            total = np.zeros((len(wanted), len(x)), np.int64)

            def give(t: int, rows, at: np.ndarray, votes: list[np.ndarray], goes_on) -> None:
                for q in goes_on:
                    got = votes[q].take(at)
                    for i, trees in users[q]:
                        if t < trees:
                            total[i, rows] += got

            for t, (top, loosest, ends, _) in tops.items():
                give(t, slice(None), top.find(loosest, x), ends, range(len(cuts)))
            known = at = None
            for t, node, part in _parts(path, most):
                rows, some, goes_on = slice(None), x, range(len(cuts))
                if t in tops:
                    top, loosest, _, below = tops[t]
                    if t != known:
                        known, at = t, top.find(loosest, x)
                    rows, goes_on = np.flatnonzero(at == node), np.flatnonzero(below[:, node])
                    if not len(rows) or not len(goes_on):
                        continue
                    some = x[rows]
                loosest, stops = part.stops([part.cut(*cut) for cut in cuts])
                votes = vote(part.p)
                give(t, rows, part.find(loosest, some), [votes[stop] for stop in stops], goes_on)
            return (total / units).T

        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= SCORED:
                    yield from answer(held)
                    held, n = [], 0
            yield from answer(held)

        def answer(held: list[pd.Series]) -> Iterator[pd.Series]:
            x = [np.stack(b.to_numpy()) if len(b) else np.zeros((0, width)) for b in held]
            if x:
                p, at = score(np.concatenate(x).astype(np.float64)), np.cumsum([len(b) for b in x])
                yield from (pd.Series(list(some)) for some in np.split(p, at[:-1]))

        return F.pandas_udf(scored, "array<double>")(vector_to_array("features"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = self.trees
        one = self.shares(dataset.sparkSession, [{}])[0]
        mark = "_".join(["p", *dataset.columns])  # no column of the table has this name
        p = F.col(mark)
        return dataset.withColumn(mark, one).withColumns({
            "rawPrediction": array_to_vector(F.array((1.0 - p) * trees, p * trees)), "probability": array_to_vector(F.array(1.0 - p, p)),
            "prediction": (p > 0.5).cast("double")}).drop(mark)

    @property
    def featureImportances(self):
        """Impurity that the splits on a column remove, as a share of the tree's, over all trees."""
        spark = SparkSession.getActiveSession()
        cut = self._cut_tops(spark)
        limits, known = (self.max_depth, self.min_split), {t: (self.tops[t], f) for t, f in cut.items()}

        def removed(part: Part, feature: np.ndarray) -> Iterator[tuple[int, float]]:
            reached = np.zeros(len(feature), bool)
            reached[0] = True
            for i in np.flatnonzero(feature >= 0):
                if reached[i]:
                    reached[part.left[i]] = reached[part.left[i] + 1] = True
            inner = np.flatnonzero(reached & (feature >= 0))
            gini = part.weight * part.p * (1.0 - part.p)
            left = part.left[inner]
            by = np.bincount(feature[inner], gini[inner] - gini[left] - gini[left + 1])
            return ((j, float(v)) for j, v in enumerate(by) if v)

        def of(rows):
            for r in rows:
                if r["tree"] not in known or known[r["tree"]][1][r["node"]] == BELOW:
                    part = Part.of(r)
                    yield from ((r["tree"], j, v) for j, v in removed(part, part.cut(*limits)))

        kind = "tree int, slot int, v double"
        table = spark.read.parquet(self.path).where((F.col("node") >= 0) & (F.col("tree") < self.trees))
        found = spark.createDataFrame(table.rdd.mapPartitions(of), kind)
        found = found.unionByName(spark.createDataFrame([(t, j, v) for t, (p, f) in known.items() for j, v in removed(p, f)], kind))
        whole = found.groupBy("tree").agg(F.sum("v").alias("all"))
        by = {r.slot: r.v for r in found.join(whole, "tree").groupBy("slot").agg(F.sum(F.col("v") / F.col("all")).alias("v")).collect()}
        total = sum(by.values())
        return Vectors.sparse(self.width, {j: v / total for j, v in by.items()})

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


_NODES = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
          "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def _node_rows(row, limits: tuple) -> Iterator[tuple]:
    """The nodes of a whole tree as in a model that Spark saved, numbered level by level."""
    part = Part.of(row)
    feature, half, reached = part.cut(*limits), part.weight * part.p * (1.0 - part.p), {0}
    for i in range(len(feature)):
        if i in reached:
            inner, w, p, left = bool(feature[i] >= 0), float(part.weight[i]), float(part.p[i]), int(part.left[i])
            gain = 2.0 * float(half[i] - half[left] - half[left + 1]) / w if inner else -1.0
            split = (int(feature[i]), [float(part.threshold[i])], -1) if inner else (-1, [], -1)
            reached |= {left, left + 1} if inner else set()
            yield row["tree"], (i, float(p > 0.5), 2.0 * p * (1.0 - p), [w * (1.0 - p), w * p], int(part.rows[i]), gain,
                                left if inner else -1, left + 1 if inner else -1, split)


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        about = {"trees": m.trees, "width": m.width, "maxDepth": m.max_depth, "minSplit": m.min_split}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"forest": about})
        parts = self.sparkSession.read.parquet(m.path)
        parts.write.parquet(f"{path}/parts")
        if not m.tops:  # trees that are one part each: their nodes in Spark's form, too
            limits = (m.max_depth, m.min_split)
            nodes = parts.where(F.col("tree") < m.trees).rdd.flatMap(lambda r: _node_rows(r, limits))
            self.sparkSession.createDataFrame(nodes, _NODES, verifySchema=False).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        saved, parts = about["forest"], self.sparkSession.read.parquet(f"{path}/parts")
        tops = {r["tree"]: Part.of(r) for r in parts.where("node < 0").collect()}
        model = ForestModel(f"{path}/parts", saved["trees"], saved["width"], tops, saved["maxDepth"], saved["minSplit"])
        return model._resetUid(about["uid"])
