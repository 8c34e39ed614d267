"""Mixing against brute force: targets by resharing, words taken by walking the documents, positions by numeric integration."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from churnlab.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def brute_targets(sizes: dict, weights=(5, 2, 1), repeats=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    whole, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        share = {s: (whole - sum(fixed.values())) * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] >= repeats * sizes[s]]
        if not over:
            return {**share, **fixed}
        fixed |= {s: repeats * sizes[s] for s in over}
        if len(fixed) == len(names):
            return fixed


def brute(rows) -> list[tuple]:
    docs = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, s in rows]
    sizes: dict = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    target, out = brute_targets(sizes), []
    for source in sizes:
        own = sorted((d for d in docs if d[1] == source), key=lambda d: (d[0] is None, hashlib.md5(str(d[0]).encode()).hexdigest(), d[0] or 0, d[2]))
        budget, taken = int(target[source] + 0.5), [0] * len(own)
        for _ in range(3):
            for k, d in enumerate(own):
                step = min(d[2], budget)
                taken[k], budget = taken[k] + step, budget - step
        out += [(d[0], d[2], sizes[source], round(target[source], 6), n) for d, n in zip(own, taken)]
    return sorted(out, key=str)


def answer(frame) -> list[tuple]:
    return sorted([(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in frame.collect()], key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert answer(queries.QUERIES["op12_source_mixing"](spark, SF)) == brute(rows)


def test_edge_rows_and_a_hot_source_over_many_ranges(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot") for i in range(600)] + [(1000 + i, "a b\tc\nd\x0be\x0cf\rg h " * 40, f"s{i}") for i in range(5)]
    rows += [(2000, None, "s1"), (2001, "", "s2"), (2002, "  \t\n ", "s2"), (2003, "null source", None), (2004, "more of it", None),
             (None, "no id here", "s1"), (None, "no id here", "s1"), (7, "w w w", "hot"), (7, "w w w", "hot"), (2005, None, "only empty"), (2006, "é中 \U0001f600", "\U0001f600")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, `c.start` int").repartition(13)
    conf = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(c) for c in conf]
    try:
        spark.conf.set(conf[0], "false"), spark.conf.set(conf[1], "23")  # the hot source lies in many ranges
        got = mixing.assign(docs)
        assert answer(got) == brute(rows) == answer(mixing.assign(docs.repartition(3)))
    finally:
        for c, v in zip(conf, old):
            spark.conf.set(c, v)
    by_source: dict = {}
    for r in got.collect():
        assert r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies) and all(0 <= c.position < 1 for c in r.copies)
        by_source.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 0.5 for (_, t), v in by_source.items())


def test_empty_tables(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.assign(spark.createDataFrame([], kind)).collect() == []
    got = mixing.assign(spark.createDataFrame([(1, "", "a"), (2, None, None)], kind)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_word_counts_of_sliced_arrays():
    rows = [None, "", " a", "a ", "ab  cd", " ", "x\x1fy\x00 z", "tail"]
    want = [len(re.findall("[^\x20\x09-\x0d]+", r or "")) for r in rows]
    assert mixing.word_counts(pa.array(rows)).tolist() == want
    assert mixing.word_counts(pa.array(rows).slice(2, 4)).tolist() == want[2:6]
    assert mixing.word_counts(pa.array(rows, pa.large_string())).tolist() == want


@pytest.mark.parametrize("shape", [*mixing.SHAPES, ((0.0, 0.0), (0.25, 3.0), (0.5, 0.0), (1.0, 2.0)), ((0.0, 0.0), (0.5, 0.0), (1.0, 1.0))])
def test_positions_invert_the_integral_of_the_weight(spark, shape):
    def weight(t):
        for (t0, w0), (t1, w1) in zip(shape, shape[1:]):
            if t <= t1:
                return w0 + (w1 - w0) * (t - t0) / (t1 - t0)

    steps = 20000
    held, total = [0.0], 0.0
    for i in range(steps):
        total += weight((i + 0.5) / steps) / steps
        held.append(total)
    shares = [0.0001, 0.1, 0.25, 0.4, 0.5, 0.77, 0.9999]
    frame = spark.createDataFrame([(s,) for s in shares], "u double").select("u", mixing.due(F.col("u"), shape).alias("t"))
    for r in frame.collect():
        i = min(int(r.t * steps), steps - 1)
        at = held[i] + (r.t * steps - i) * (held[i + 1] - held[i])
        assert abs(at / total - r.u) < 1e-6


def test_the_mixture_follows_the_schedule_over_time(spark):
    """Heavy sources come early, light ones late, and each window of training time holds what the weights say."""
    docs = spark.createDataFrame([(i, "w " * 20, "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    mix = mixing.assign(docs).persist()
    words = {(r.source, r.w): r.n for r in mix.select("source", F.explode("copies").alias("c")).groupBy(
        "source", F.floor(F.col("c.position") * 4).alias("w")).agg(F.sum("c.words").alias("n")).collect()}
    totals = {r.source: r.target for r in mix.select("source", "target").distinct().collect()}
    want = {"a": [0.34375, 0.28125, 0.21875, 0.15625], "b": [0.25] * 4, "c": [0.15625, 0.21875, 0.28125, 0.34375]}
    for s, shares in want.items():
        for w, share in enumerate(shares):
            assert abs(words[s, w] / totals[s] - share) < 0.01


def test_order_and_texts_of_the_corpus(spark):
    rows = [(i, f"t{i} " * (i % 4 + 1), "ab"[i % 2]) for i in range(60)] + [(3, "again with another text", "a"), (None, "no id", "b"), (None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.assign(docs)
    listed, corpus = mixing.in_order(mix).collect(), mixing.mixed_corpus(docs, mix).collect()
    assert [r.position for r in listed] == sorted(r.position for r in listed) and [r.position for r in corpus] == sorted(r.position for r in corpus)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).add(t)
    assert all(r.text in texts[r.doc_id] and r.words <= len(r.text.split()) for r in corpus)
    assert {r.position for r in corpus} == {r.position for r in listed}


def test_a_wrong_schedule_raises(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    for shapes in ((((0.0, 1.0), (0.5, 1.0)),) * 3, (((0.0, -1.0), (1.0, 1.0)),) * 3, mixing.SHAPES[:2], (((0.0, 0.0), (1.0, 0.0)),) * 3):
        with pytest.raises(ValueError):
            mixing.assign(docs, shapes=shapes)
