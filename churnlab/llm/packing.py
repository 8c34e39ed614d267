"""Best-fit packing by non-negative least squares over length patterns.

1. Tasks encode the texts and cut them into pieces of at most ``capacity`` ids.
2. Only the length histogram (``capacity`` rows at most, whatever the corpus)
   reaches the driver. Patterns of one to three lengths that fill a sequence
   are enumerated over it, a projected-gradient non-negative least squares fit
   gives repeat counts, and these are rounded down to whole sequences that the
   histogram can supply. What the rounding leaves over is packed best-fit
   decreasing, still on counts.
3. The plan is a list of (pattern, repeats). Each length owns ranges of places
   in it, so the r-th piece of a length finds its sequence and offset by binary
   search. Pieces are numbered within (task, length) when they are written and
   shifted by the counts of earlier tasks: no piece is shuffled by its length,
   and a length that a third of all pieces share is no hot key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from churnlab.llm.common import map_arrow, materialize, slices, texts
from churnlab.llm.tokens import TEXT_BYTES, encoder, tokenizer_path

#: Columns of the fit: patterns that leave at most this many places empty.
SLACK = 0
FIT_ROUNDS = 400


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole, or ``capacity`` each with a shorter first piece."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(a, capacity) for a in range(first, n, capacity)]


def length_patterns(lengths: np.ndarray, capacity: int, slack: int = SLACK) -> np.ndarray:
    """Rows of up to three lengths (0: none), descending, that fill ``capacity`` but for ``slack`` places."""
    lengths = np.sort(np.asarray(lengths, np.int64))
    rows = [np.array([[capacity, 0, 0]])] if capacity in lengths else []
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    for room in range(slack + 1):
        full = capacity - room
        if room and have[full]:
            rows.append(np.array([[full, 0, 0]]))
        a = lengths[(lengths >= full - lengths) & (lengths < full)]
        a = a[have[full - a]]
        rows.append(np.stack([a, full - a, np.zeros_like(a)], 1))
        for c in lengths[lengths * 3 <= full]:
            b = lengths[(lengths >= c) & (lengths * 2 <= full - c)]
            rest = full - c - b
            keep = have[rest]
            rows.append(np.stack([rest[keep], b[keep], np.full(keep.sum(), c)], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative least squares: how often each pattern should be used so that the lengths used match the histogram.

    Accelerated projected gradient on ``min |A x - h|, x >= 0``. Longer lengths weigh more, since a short piece
    left over is placed more easily. Patterns have at most three entries, so a product with A is three gathers.
    """
    if not len(patterns):
        return np.zeros(0)
    size = len(histogram)
    weight = 0.1 + np.arange(size) / size
    weight[0] = 0.0
    target, cols = weight * histogram, patterns.T
    apply = lambda x: weight * sum(np.bincount(c, x, size) for c in cols)
    back = lambda r: sum((weight * r)[c] for c in cols)
    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue by power iteration: the step length
        v = back(apply(v))
        v /= max(np.linalg.norm(v), 1e-300)
    step = 1.0 / max(np.linalg.norm(back(apply(v))) * 1.02, 1e-12)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(apply(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(histogram: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (pattern, repeats). Sequences with the same content stay one entry."""
    open_by_room: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []  # sorted rooms that are open

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        if not open_by_room[room]:
            insort(rooms, room)
        open_by_room[room][pattern] += n

    def take(room: int, most: int) -> tuple[tuple[int, ...], int]:
        pattern, n = next(iter(open_by_room[room].items()))
        used = min(n, most)
        open_by_room[room][pattern] -= used
        if not open_by_room[room][pattern]:
            del open_by_room[room][pattern]
        if not open_by_room[room]:
            rooms.remove(room)
        return pattern, used

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, left)
                n = left // each
                put((length,) * each, capacity - each * length, n)
                left -= n * each
                continue
            room = rooms[at]
            pattern, n = take(room, left)
            put(pattern + (length,), room - length, n)
            left -= n
    return [(pattern, n) for by in open_by_room.values() for pattern, n in by.items() if n]


def pack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every counted length exactly; the fit first, best fit for the rest."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    patterns = length_patterns(np.flatnonzero(counts), capacity)
    wanted = fit_repeats(patterns, counts)
    left, plan = counts.copy(), []
    for j in np.argsort(-wanted, kind="stable"):
        pattern = tuple(int(v) for v in patterns[j] if v)
        need = Counter(pattern)
        n = min([int(wanted[j] + 1e-9), *(int(left[v]) // k for v, k in need.items())])
        if wanted[j] < 1:
            break
        if n > 0:
            plan.append((pattern, n))
            for v, k in need.items():
                left[v] -= k * n
    rest = Counter({int(v): int(left[v]) for v in np.flatnonzero(left)})
    return plan + best_fit(rest, capacity)


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used: Counter = Counter()
        sequence = 0
        for pattern, n in plan:
            offset = 0
            for length in pattern:
                ranges[length].append((used[length], sequence, offset))
                used[length] += n
                offset += length
            sequence += n
        self.sequences = sequence
        self.ranges = {k: np.array(v, np.int64) for k, v in ranges.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for v in np.unique(length):
            at, table = np.flatnonzero(length == v), self.ranges[int(v)]
            row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
            sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
        return sequence, offset


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, task int, nth long"


def document_pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per piece; ``task`` and ``nth`` number the pieces of a length within the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                ids, counts = enc.encode(texts(part.column("text")))
                ends, rows, row_of = np.cumsum(counts), [], []
                for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    for k, (start, length) in enumerate(cut_pieces(len(own), capacity)):
                        rows.append((k, start, length, zlib.crc32(own[start: start + length].tobytes()), task, seen[length]))
                        row_of.append(i)
                        seen[length] += 1
                made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row_of)), *made],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(given, run, PIECES.format(id=given.schema["doc_id"].dataType.simpleString()), cache="tokens")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id (from 0) and offset; the pieces of a sequence lie gapless from
    offset 0. Null and empty texts are pieces of ``end_id`` alone; null and
    repeated ids are packed like others (each row is a document); an empty
    table gives no rows; other columns are ignored.
    """
    pieces = materialize(document_pieces(docs, capacity, end_id, tokenizer or tokenizer_path(), id_col, text_col))
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(per_task.select("task", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    histogram = {r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = Places(pack_plan(histogram, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("before").to_numpy() + batch.column("nth").to_numpy()
            sequence, offset = places.find(batch.column("length").to_numpy(), rank)
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return map_arrow(pieces.join(base.drop("n"), ["task", "length"]), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
