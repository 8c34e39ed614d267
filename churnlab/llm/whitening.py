"""Embedding whitening by Chebyshev-filtered subspace iteration.

1. One scan gives the number of vectors and their exact sums per dimension, so
   every later scan centres a row before it multiplies it.
2. The covariance is never formed: a pass over the table multiplies it with a
   block of ``components + guards`` columns (each task folds its rows into one
   partial product, Spark adds the partials by dimension).
3. A round applies the scaled Chebyshev recurrence to the block. It damps the
   unwanted part of the spectrum, from a lower bound (a Lanczos run whose vector
   rides in the passes of the first round) to the smallest Ritz value of the
   block, and lets the wanted part grow.
4. QR and Rayleigh-Ritz on the driver (matrices of dimension x block) turn the
   block into Ritz vectors, whose residuals cost no pass of their own.
5. Certificate: the residuals of the wanted components must reach rounding
   error, and stay there, with the same values, in a further round whose guards
   are new random vectors; a direction that the first block missed would show.

Vectors of each length are a fit of their own; all lengths share the passes.
The driver and a task hold one block per length, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass
from math import acosh

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from churnlab.llm.common import map_arrow, materialize

#: Columns beside the wanted ones, passes of a round at most, and how far a round may let the first component grow
#: over the damped part (beyond that the other columns would lose their digits).
GUARDS, DEGREE, GROWTH = 24, 16, 1e10
#: Residuals, relative to the first eigenvalue, that count as rounding error and as certified where they fall no further.
EXACT, CERTIFIED = 1e-14, 1e-11
#: Eigenvalues below this share of the first are zero: such a direction has no variance to whiten.
ZERO = 1e-12
#: How much a direction as large as the last component grows in the round that looks for missed ones.
PROBE = 1e5
ROUNDS = 200
#: Entries beyond this are not counted as integers that sums of whole tables hold.
LARGEST = float(1 << 44)


@dataclass
class Whitening:
    """The fit of all vectors of one length."""

    n: int
    sums: list[int]         # per dimension
    values: np.ndarray      # eigenvalues of the covariance, falling
    vectors: np.ndarray     # unit eigenvectors in columns
    trace: float
    residual: float         # largest residual of a component, relative to the first eigenvalue
    passes: int             # products of the covariance with a block
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else np.zeros(0)


def integer_vectors(vectors: DataFrame, vec_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``vectors`` with ``vec_col`` as longs ``floor(scale * c) + shift``; rows whose vector is null, holds a null or
    non-finite entry, or one beyond 2**44 after scaling, go."""
    c = F.col(vec_col).cast("array<double>")
    held = F.forall(c, lambda v: v.isNotNull() & (F.abs(v) * scale < LARGEST))  # NaN is larger than any number
    return vectors.where(F.col(vec_col).isNotNull() & held).withColumn(
        vec_col, F.transform(c, lambda v: F.floor(v * scale) + F.lit(shift).cast("long")))


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, rows x length matrix of longs) for each length in a list column."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)  # of the whole buffer, as the offsets
    lengths = np.diff(ends)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[ends[at][:, None] + np.arange(d)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n with one rounding: the whole part of the mean goes off as an integer."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def _sums(table: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """length -> (vectors, exact sums per dimension)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _rows(batch.column("x")):
                d = x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)),
                     pa.array(np.full(d, len(at), np.int64)), pa.array(x.sum(axis=0))], ["d", "i", "n", "s"])

    parts = map_arrow(table.select("x"), run, "d int, i int, n long, s long")
    total = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in total.orderBy("d", "i").collect():  # one row per dimension
        found.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return found


def _products(table: DataFrame, stats: dict, blocks: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (covariance times block, variances of the dimensions) by one pass over the table."""
    width = max(b.shape[1] for b in blocks.values())
    names = [f"y{j}" for j in range(width + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((d, width + 1)) for d in blocks}
        for batch in batches:
            for _, x in _rows(batch.column("x")):
                if (block := blocks.get(x.shape[1])) is not None:
                    c, held = _centred(x, *stats[x.shape[1]]), sums[x.shape[1]]
                    held[:, : block.shape[1]] += c.T @ (c @ block)
                    held[:, width] += np.einsum("ij,ij->j", c, c)
        for d, held in sums.items():
            if held.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), *[pa.array(held[:, j].copy()) for j in range(width + 1)]],
                    ["d", "i", *names])

    parts = map_arrow(table.select("x"), run, "d int, i int, " + ", ".join(f"{y} double" for y in names))
    out = {d: (np.zeros(b.shape), np.zeros(d)) for d, b in blocks.items()}
    for r in parts.groupBy("d", "i").agg(*[F.sum(y).alias(y) for y in names]).collect():  # dimensions x block
        product, squares = out[r.d]
        n = stats[r.d][0]
        product[r.i] = np.array(r[2: 2 + product.shape[1]]) / n
        squares[r.i] = r[-1] / n
    return out


def _lowest(diagonal: list[float], beside: list[float]) -> float:
    """A lower bound of the spectrum from a Lanczos run: the smallest Ritz value less the last coupling."""
    t = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beside[-1])


def _degree(first: float, wanted: float, growth: float) -> int:
    """Passes of a round, where the damped part is [-1, 1]: enough for the last wanted column (at ``wanted``) to grow by
    ``growth``, but the first column may grow by ``GROWTH`` at most."""
    most = int(acosh(GROWTH) / acosh(max(first, 1 + 1e-9)))
    enough = 1 + int(acosh(max(growth, 1.0)) / acosh(max(wanted, 1 + 1e-9)))
    return max(2, min(DEGREE, most, enough))


class _LowerBound:
    """A Lanczos run whose vector rides in the passes of the filter; ``low`` is a lower bound of the spectrum."""

    def __init__(self, d: int, rng: np.random.Generator):
        self.vector, self.previous = rng.standard_normal(d), np.zeros(d)
        self.vector /= np.linalg.norm(self.vector)
        self.diagonal, self.beside, self.low, self.steps = [], [], 0.0, min(d, 12)

    @property
    def runs(self) -> bool:
        return len(self.diagonal) < self.steps

    def learn(self, z: np.ndarray, top: float) -> None:
        self.diagonal.append(float(self.vector @ z))
        z = z - self.diagonal[-1] * self.vector - (self.beside[-1] if self.beside else 0.0) * self.previous
        self.beside.append(float(np.linalg.norm(z)))
        self.previous, self.vector = self.vector, z / max(self.beside[-1], np.finfo(float).tiny)
        if self.beside[-1] <= 1e-9 * top:
            self.steps = len(self.diagonal)
        if not self.runs:
            self.low = _lowest(self.diagonal, self.beside)


def _iterate(d: int, components: int, seed: int) -> Generator[np.ndarray, tuple[np.ndarray, np.ndarray], Whitening]:
    """The iteration for one length: yields blocks, is sent (covariance times block, variances).

    Columns whose residual has come down to rounding error are locked: the block is kept orthogonal to them, so the
    filter is scaled by the first column that is still at work.
    """
    rng = np.random.default_rng([seed, d])
    size, lanczos = min(d, components + GUARDS), _LowerBound(d, rng)
    locked, values, worst, passes, last = np.zeros((d, 0)), np.zeros(0), 0.0, 0, np.full(size, np.inf)
    off_locked = lambda y: y - locked @ (locked.T @ y)
    fresh = lambda width: np.linalg.qr(off_locked(off_locked(rng.standard_normal((d, width)))))[0]
    q, probing, top = fresh(size), False, 0.0

    for _ in range(ROUNDS):
        product, variances = yield q                                    # Rayleigh-Ritz
        passes, product = passes + 1, off_locked(product)
        theta, w = np.linalg.eigh(q.T @ product)
        theta, w = theta[::-1], w[:, ::-1]
        q, product = q @ w, product @ w
        top = max(top, float(theta[0]))
        off = np.linalg.norm(product - q * theta, axis=0) / (top or 1.0)
        whole = q.shape[1] + locked.shape[1] == d                       # no direction lies outside the block
        if len(values) and theta[0] > values[-1] + CERTIFIED * top:     # a direction that earlier blocks missed
            q, values, probing = np.hstack([locked, q])[:, :size], np.zeros(0), False
            locked, worst, last = np.zeros((d, 0)), 0.0, np.full(size, np.inf)
            continue
        if probing:
            break
        ready = (off <= EXACT) | (off <= CERTIFIED) & (off > last[: len(off)] / 2) | whole | (theta <= ZERO * top)
        more = min(components - len(values), len(ready) if ready.all() else int(np.argmin(ready)))
        locked, values = np.hstack([locked, q[:, :more]]), np.concatenate((values, theta[:more]))
        worst, last = max(worst, float(off[:more].max(initial=0.0))), off[more:]
        q, product, theta = q[:, more:], product[:, more:], theta[more:]
        if whole:
            break
        probing = len(values) == components
        if probing:                                                     # once more with new random vectors
            q = fresh(min(GUARDS, d - len(values)))
            product, _ = yield q
            passes, product = passes + 1, off_locked(product)
            high = float(values[-1])
        else:
            high = float(theta[-1])

        # Chebyshev filter: the spectrum from low to high is damped.
        first = float(values[-1] if probing else theta[0])
        low = lanczos.low
        high = max(min(high, first - 0.1 * (first - low)) if probing else high, low + 1e-6 * (first - low), np.finfo(float).tiny)
        centre, half = (high + low) / 2, (high - low) / 2
        scale = max((first - centre) / half, 1 + 1e-9)
        at_work = components - len(values)
        degree = _degree(scale, scale, PROBE) if probing else _degree(
            scale, (float(theta[:at_work][-1]) - centre) / half, 10 * float(last[:at_work].max()) / EXACT)
        rate = sigma = 1 / scale
        before, y = q, (product - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            if lanczos.runs:
                both, _ = yield np.column_stack([y, lanczos.vector])
                product = both[:, :-1]
                lanczos.learn(both[:, -1], top)
            else:
                product, _ = yield y
            passes += 1
            following = 1 / (2 / sigma - rate)
            before, y, rate = y, off_locked((product - centre * y) * (2 * following / half) - before * (rate * following)), following
        q, _ = np.linalg.qr(off_locked(np.linalg.qr(y)[0]))
    else:
        raise RuntimeError(f"no certified components after {ROUNDS} rounds (length {d}, residuals {last[:components]})")
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > ZERO * top]
    return Whitening(0, [], values[order], locked[:, order], float(variances.sum()), worst, passes)


def fit(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42) -> tuple[DataFrame, dict[int, Whitening]]:
    """(the vectors as a written table of ``id`` and ``x``, length -> fit) for integer vectors.

    ``vec_col`` holds arrays of longs without nulls (``integer_vectors``). Every
    length is fitted on its own vectors. A fit has as many components, at most
    ``components``, as directions with variance: none for a single vector, for
    equal vectors or for empty ones. Rows that repeat an id count as often as
    they are given; rows without an id count too.
    """
    table = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")))
    stats = _sums(table)
    running = {d: _iterate(d, components, seed) for d in stats if d}
    blocks = {d: next(g) for d, g in running.items()}
    found: dict[int, Whitening] = {}
    while blocks:
        products, blocks = _products(table, stats, blocks), {}
        for d, sent in products.items():
            try:
                blocks[d] = running[d].send(sent)
            except StopIteration as end:
                found[d] = end.value
                found[d].n, found[d].sums = stats[d]
    errors = _identity_errors(table, found)
    for d, fitted in found.items():
        fitted.identity_error = errors.get(d, 0.0)
    return table, found


def _project(x: np.ndarray, fitted: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(centred rows, whitened rows)."""
    c = _centred(x, fitted.n, fitted.sums)
    return c, (c @ fitted.vectors) / np.sqrt(fitted.values)


def _identity_errors(table: DataFrame, found: dict[int, Whitening]) -> dict[int, float]:
    """length -> largest absolute entry of (covariance of the whitened rows, less the identity), by one more pass."""
    names = [f"c{j}" for j in range(max([len(f.values) for f in found.values()], default=0))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((len(f.values) + 1, len(f.values))) for d, f in found.items() if len(f.values)}
        for batch in batches:
            for _, x in _rows(batch.column("x")):
                if x.shape[1] in sums:
                    z, held = _project(x, found[x.shape[1]])[1], sums[x.shape[1]]
                    held[:-1] += z.T @ z
                    held[-1] += z.sum(axis=0)
        for d, held in sums.items():
            wide = np.zeros((len(held), len(names)))
            wide[:, : held.shape[1]] = held
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), d, np.int32)), pa.array(np.arange(len(held), dtype=np.int32)), *[pa.array(wide[:, j].copy()) for j in range(len(names))]],
                ["d", "i", *names])

    if not names:
        return {}
    parts = map_arrow(table.select("x"), run, "d int, i int, " + ", ".join(f"{c} double" for c in names))
    held = {d: np.zeros((len(f.values) + 1, len(f.values))) for d, f in found.items()}
    for r in parts.groupBy("d", "i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # components x components
        held[r.d][r.i] = r[2: 2 + held[r.d].shape[1]]
    out = {}
    for d, m in held.items():
        mean = m[-1] / found[d].n
        out[d] = float(np.abs(m[:-1] / found[d].n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    return out


def transform(table: DataFrame, found: dict[int, Whitening], id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``table`` and ``found`` come from ``fit``. ``deviation`` is the exact sum of (n * x - sum)**2 over the dimensions,
    null where that is no long. Vectors of a length without components give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _rows(batch.column("x")):
                fitted = found.get(x.shape[1])
                if fitted is None or not (k := len(fitted.values)):
                    continue
                c, z = _project(x, fitted)
                with np.errstate(over="ignore"):  # longs wrap around: a sum that fits in one is exact
                    n, sums = np.array([fitted.n], np.int64), np.array([s % fitted.n for s in fitted.sums], np.int64)
                    whole = np.array([s // fitted.n for s in fitted.sums], np.int64)
                    exact = ((n * (x - whole) - sums) ** 2).sum(axis=1)
                size = float(fitted.n) ** 2 * np.einsum("ij,ij->i", c, c)
                rows = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at[rows])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(rows), fitted.n, np.int64)), pa.array(exact[rows], mask=(size >= 2.0 ** 63 * (1 - 1e-9))[rows]),
                     pa.array(z.ravel()), pa.array(np.tile(fitted.explained, len(at))), pa.array(np.full(len(rows), fitted.identity_error))],
                    schema.names)

    schema = StructType([StructField(id_col, LongType())]).add("component", "integer").add("n", "long").add("deviation", "long") \
        .add("whitened", "double").add("explained", "double").add("identity_error", "double")
    return map_arrow(table.select("id", "x"), run, schema)


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Whitened vectors (``transform``) of the integers ``floor(scale * c) + shift``.

    Rows whose vector is null or holds null, non-finite or too large entries give no rows and are not fitted. An empty
    table gives no rows; other columns are ignored.
    """
    table, found = fit(integer_vectors(vectors, vec_col, scale, shift), components, id_col, vec_col)
    return transform(table, found, id_col)
