"""Whitening against numpy's eigenvectors of the whole covariance, and rows that the contract names."""

from __future__ import annotations

import math

import numpy as np
import pytest

from churnlab.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(rows: list[list[float]], components: int = 8, scale: int = 1024, shift: int = 100_000):
    """(n, deviations, eigenvalues, eigenvectors, whitened, trace) by forming the covariance."""
    x = np.array([[math.floor(scale * float(c)) + shift for c in r] for r in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviations = [int(sum((n * v - s) ** 2 for v, s in zip(row, sums))) for row in x]
    c = np.array([[(n * v - s) / n for v, s in zip(row, sums)] for row in x], float)
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, deviations, values, vectors, c @ vectors / np.sqrt(values), np.trace(cov)


def by_component(rows):
    out: dict[int, dict] = {}
    for r in rows:
        out.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    return out


def test_whole_query_equals_the_full_eigendecomposition(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, values, _, white, trace = brute([r.embedding for r in given])
    got = by_component(queries.QUERIES["op11_embedding_whitening"](spark, SF).collect())
    assert sorted(got) == list(range(1, 9))
    for k, rows in got.items():
        mine = np.array([rows[r.vec_id][0].whitened for r in given])
        sign = np.sign(mine @ white[:, k - 1])
        assert np.abs(mine * sign - white[:, k - 1]).max() < 1e-9
        for r, d in zip(given, deviations):
            row = rows[r.vec_id][0]
            assert row.n == n and row.deviation == d
            assert abs(row.explained - values[k - 1] / trace) < 1e-12 and row.identity_error < 1e-9


def solve(v: np.ndarray, change_first=None):
    """The iteration with a covariance in memory instead of passes over a table."""
    state = whitening._iterate(len(v), 8, 42)
    block = next(state)
    if change_first is not None:
        change_first(block)
    while True:
        try:
            block = state.send((v @ block, np.diag(v).copy()))
        except StopIteration as end:
            return end.value


SPECTRA = {
    "falls fast": [2.0 ** -i for i in range(40)], "falls slowly": list(1 / np.arange(1, 400)), "spans forty decades": [10.0 ** -i for i in range(40)],
    "flat": list(1 + 0.01 * np.random.default_rng(1).standard_normal(64)), "nearly equal": [1 + 1e-6 * i for i in range(100)],
    "equal": [2.0] * 50, "more equal large values than components": [9.0] * 12 + [1.0] * 28, "step behind the components": [1.0] * 8 + [1 - 1e-4] * 60,
    "fewer directions than components": [5.0, 4.0, 3.0] + [0.0] * 37, "one direction": [1e6] + [1 + 1e-3 * i for i in range(39)],
    "no variance": [0.0] * 20, "small": [3.0, 2.0, 1.0], "one entry": [4.0]}


@pytest.mark.parametrize("name", SPECTRA)
def test_spectra(name):
    spectrum = np.array(SPECTRA[name])
    basis, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((len(spectrum), len(spectrum))))
    v = (basis * spectrum) @ basis.T
    v = (v + v.T) / 2
    found, want = solve(v), np.linalg.eigvalsh(v)[::-1]
    k = min(8, int((want > 1e-12 * want[0]).sum()) if want[0] > 0 else 0)
    assert len(found.values) == k and (np.diff(found.values) <= 0).all()
    if k:
        assert np.abs(found.values - want[:k]).max() <= 1e-14 * want[0]
        assert np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0).max() <= 3e-14 * want[0]
        assert np.abs(found.vectors.T @ found.vectors - np.eye(k)).max() < 1e-13


def test_rows_that_do_not_count_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "x"), (2, [3.0, -2.5], "x"), (2, [3.0, -2.5], "y"), (None, [0.0, 0.0], "x"), (4, None, "x"), (5, [1.0, None], "x"),
            (6, [nan, 1.0], "x"), (7, [1.0, -inf], "x"), (8, [1e300, 1.0], "x"), (9, [], "x"),
            (10, [1.0, 2.0, 3.0], "x"), (11, [2.0, 4.0, 7.5], "x"), (12, [5.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    got = whitening.whiten(table).collect()
    two = [r for r in got if r.n == 4]
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in two) == sorted(
        (i is None, i or 0, k) for i in (1, 2, 2, None) for k in (1, 2))
    n, deviations, _, _, white, _ = brute([[1.0, 2.0], [3.0, -2.5], [3.0, -2.5], [0.0, 0.0]])
    assert {(r.vec_id, r.deviation) for r in two} == set(zip([1, 2, 2, None], deviations))
    assert np.isclose(sorted(abs(r.whitened) for r in two), sorted(np.abs(white).ravel())).all()
    three = [r for r in got if r.n == 2]  # two vectors of three entries differ in one direction
    assert sorted((r.vec_id, r.component) for r in three) == [(10, 1), (11, 1)] and all(abs(abs(r.whitened) - 1) < 1e-12 for r in three)
    assert len(got) == len(two) + len(three)  # the vector that is alone in its length has no variance


def test_empty_table_equal_vectors_and_long_range(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, kind)).collect() == []
    big = [(1, [2.0 ** 33, 0.0]), (2, [-(2.0 ** 33), 1.0]), (3, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).where("component = 1").collect()
    assert {r.vec_id: r.deviation is None for r in got} == {1: True, 2: True, 3: False}  # (3 * 2**43)**2 is no long


def test_a_missed_direction_is_found_by_new_guards():
    """A first block without the largest direction isn't certified as long as that direction is missing."""
    v = np.diag(np.concatenate(([50.0], np.linspace(10, 1, 59))))

    def without_it(block):
        block[0] = 0.0
        block[:] = np.linalg.qr(block)[0]
        block[0] = 0.0

    found = solve(v, without_it)
    assert abs(found.values[0] - 50) < 1e-9 and np.allclose(found.values[1:], np.linspace(10, 1, 59)[:7])
