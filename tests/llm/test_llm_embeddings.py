"""Embedding near-duplicates against all pairs."""

from __future__ import annotations

import numpy as np

from churnlab.llm import embeddings
from churnlab.llm.queries import ORACLE, QUERIES
from scripts.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
COLUMNS = "vec_id long, embedding array<double>, digest int, n int"


def brute(rows, threshold=0.95):
    """{(id, links, component)} of (id, vector or None) rows, each a vector of its own."""
    ok = [i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for i, v in rows]
    unit = lambda v: (v / abs(v).max()) / np.linalg.norm(v / abs(v).max())
    x = [unit(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]
    top = list(range(len(rows)))
    links = [0] * len(rows)

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold:
                links[a] += 1
                links[b] += 1
                top[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = i if r not in least or (i is not None and (least[r] is None or i < least[r])) else least[r]
    return sorted(((i, n, least[root(k)]) for k, ((i, _), n) in enumerate(zip(rows, links))), key=str)


def clusters(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for size, spread in ((120, 0.02), (40, 0.05), (5, 0.01), (60, 0.2)):
        centre = rng.normal(size=dim)
        rows += [centre + spread * rng.normal(size=dim) for _ in range(size)]
    rows += [rng.normal(size=dim) for _ in range(150)]
    rows += [rows[0]] * 70 + [rows[0] * 3.0] * 4
    order = rng.permutation(len(rows))
    return [(int(i), rows[k].tolist()) for i, k in enumerate(order)]


def test_query_against_sql(spark):
    ok, why = compare("op2", QUERIES["op2_embedding_near_dedup"](spark, SF).toPandas(), duck(SF).execute(ORACLE["op2_embedding_near_dedup"]).df())
    assert ok, why


def test_clusters_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)  # hot lists go through block pairs
    rows = clusters()
    given = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], COLUMNS)
    result = embeddings.near_duplicates(given)
    got = result.collect()
    want = brute(rows)
    assert sum(r.n_links for r in got) >= 0.98 * sum(n for _, n, _ in want)
    exact = {(i, n) for i, n, _ in want}
    assert all(r.n_links <= n for r, (_, n, _) in zip(sorted(got, key=lambda r: str((r.vec_id,))), sorted(want, key=lambda w: str((w[0],)))))
    assert np.mean([(r.vec_id, r.n_links) in exact for r in got]) >= 0.95
    assert sorted(((r.vec_id, r.component_id) for r in got), key=str) == sorted(((i, c) for i, _, c in want), key=str)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert 0.9 <= embeddings.recall(given, result) <= 1.0


def test_edge_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e200, 1e198]), (11, [-1.0, 0.0]), (12, [-0.0, -1.0]), (13, [0.0, -1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], COLUMNS)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    empty = spark.createDataFrame([], COLUMNS)
    assert embeddings.near_duplicates(empty).collect() == []
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None, 0, 0)], COLUMNS)).select("vec_id", "n_links", "component_id").collect() == [(1, 0, 1)]


def test_recall_on_many_pairs_at_the_threshold():
    """Pairs of unit vectors at a cosine of 0.951 and more share enough of their nearest pivots."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pivots, v = embeddings.choose_pivots(base[:1000]), base[1000:]
    noise = rng.normal(size=v.shape)
    noise -= (noise * v).sum(1, keepdims=True) * v
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.999, (len(v), 1))
    other = cosine * v + np.sqrt(1 - cosine ** 2) * noise
    near = [np.argsort(-(x @ pivots.T), axis=1)[:, : embeddings.NEAREST] for x in (v, other)]
    shared = np.array([len(set(a) & set(b)) for a, b in zip(*near)])
    assert len(pivots) == embeddings.PIVOTS and (shared >= embeddings.SHARED).mean() >= 0.97


def test_every_vector_length_has_links_of_its_own(spark, monkeypatch):
    """Many lengths, one of them frequent, one with a single vector, some with fewer pivots than a pair must share."""
    monkeypatch.setattr(embeddings, "KEPT_LENGTHS", 2)
    rng, rows = np.random.default_rng(2), []
    for dim, groups in ((1, 3), (2, 4), (3, 9), (16, 30), (40, 5), (7, 1)):
        for _ in range(groups):
            centre = rng.normal(size=dim)
            rows += [centre + 0.01 * rng.normal(size=dim) for _ in range(int(rng.integers(2, 9)))]
    rows += [rows[-1], rows[0], rng.normal(size=11)]
    rows = [(int(i), rows[k].tolist()) for i, k in enumerate(rng.permutation(len(rows)))] + [(900, [1.0, 2.0, 3.0]), (901, [1.0, 2.0, 3.0])]
    result = embeddings.near_duplicates(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], COLUMNS).repartition(3))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in result.collect()), key=str)
    want = brute(rows)
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(n for _, n, _ in got) >= 0.98 * sum(n for _, n, _ in want)
    given = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], COLUMNS)
    assert 0.9 <= embeddings.recall(given, result) <= 1.0


def test_pivots_come_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PIVOT_SAMPLE", 40)
    rows = clusters()
    result = embeddings.near_duplicates(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], COLUMNS)).collect()
    want = {i: n for i, n, _ in brute(rows)}
    assert all(r.n_links <= want[r.vec_id] for r in result) and sum(r.n_links for r in result) >= 0.9 * sum(want.values())
