"""A passage counts only where one earlier document holds it whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from churnlab.llm import substring
from tests.llm.test_llm_substring import brute_passages, own_cuts, words


def test_frequent_lines_side_by_side_stay(spark):
    rng = np.random.default_rng(3)
    while True:  # two lines of 15 words with a cut on the break, as between any words
        one, two = words(rng, 15) + ".\n", words(rng, 15) + ".\n"
        if len(one) in own_cuts(one + two):
            break
    rows = [(i, f"{words(rng, 40)} {one}{words(rng, 40)}") for i in range(20)] + [(20 + i, f"{words(rng, 40)}\n{two}{words(rng, 40)}") for i in range(20)]
    rows += [(i, one + words(rng, 30)) for i in range(40, 60)] + [(i, two + words(rng, 30)) for i in range(60, 80)]
    # Every cut context of the lines occurs: the first line opens a text, the second one follows each of its neighbours.
    tail = one[-17:]
    rows += [(80 + i, words(rng, 5) + " " + tail + two + words(rng, 30)) for i in range(5)] + [(90 + i, one + two[:17] + words(rng, 30)) for i in range(5)]
    clean = one + two + words(rng, 40)
    assert 100 in brute_passages([*rows, (100, clean)], substring.MIN_WORDS)  # each chunk has some holder, the passage has none
    docs = spark.createDataFrame([*rows, (100, clean)], "doc_id long, text string")
    assert [r for r in substring.repeated_passages(docs).collect() if r.doc_id == 100] == []
    both = spark.createDataFrame([*rows, (100, clean), (101, clean)], "doc_id long, text string")
    assert [(r.start, r.length) for r in substring.repeated_passages(both).collect() if r.doc_id == 101] == [(0, len(clean))]


def test_windows_cover_every_run():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        count = rng.integers(0, 8, n)
        joined = rng.integers(0, 2, n) * (count < 7)
        joined[1:] &= (count[:-1] + joined[:-1]) > 0  # behind white space alone nothing goes on
        pairs = substring.window_places(count, joined, 12).tolist()
        assert all(a <= b and count[a: b + 1].sum() + joined[a] >= 12 for a, b in pairs)
        covered = {c for a, b in pairs for c in range(a, b + 1)}
        assert covered == (set(range(n)) if count.sum() + joined[0] >= 12 else set()) or count.sum() + joined[0] < 12


def test_windows_of_many_runs_at_once():
    rng = np.random.default_rng(11)
    for _ in range(200):
        sizes = rng.integers(1, 30, int(rng.integers(1, 9)))
        begin, n = np.cumsum(sizes) - sizes, int(sizes.sum())
        count = rng.integers(0, 7, n)
        joined = np.where(np.concatenate(([0], count[:-1])) > 0, rng.integers(0, 2, n), 0)
        each = [a + substring.window_places(count[a: a + m], joined[a: a + m], 12) for a, m in zip(begin.tolist(), sizes.tolist())]
        assert substring.window_places(count, joined, 12, begin).tolist() == np.concatenate(each).tolist()
        first, values = np.sort(rng.integers(0, n, 20)), rng.integers(-99, 99, n)
        last = np.minimum(n - 1, first + rng.integers(0, n, 20))
        assert substring.least_within(values, first, last).tolist() == [values[a: b + 1].min() for a, b in zip(first, last)]
    assert substring.window_places(np.zeros(0, int), np.zeros(0, int), 12).tolist() == []


def test_ranks_of_any_kind():
    for column in (pa.array([3, None, -5, 3], pa.int64()), pa.array(["b", None, "\U0001f600", "\uffee", "b"]), pa.array([None], pa.int32())):
        rank, values = substring.ranks(column)
        assert values.take(pa.array(rank)).equals(column)
        solid = [v.as_py() for v in values][:-1]
        assert solid == sorted(set(solid)) and values[-1].as_py() is None
