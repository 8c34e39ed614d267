"""Rows that repeat an id with another text, and rows without an id, in the pipeline's dedup stages."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as pipeline
from churnlab.llm import substring
from tests.llm.test_llm_substring import words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], COLUMNS)


def test_spans_stay_with_their_text(spark):
    rng = np.random.default_rng(4)
    passage, other = words(rng, 70), "é" * 400 + " " + words(rng, 90)
    rows = [(1, passage), (5, f"{words(rng, 9)} {passage}"), (5, other), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in substring.without_repeats(docs).collect()]
    assert other in got and None in got and passage in got and len(got) == 4 and rows[1][1] not in got


def test_substring_stage_cuts_rows_without_id(spark):
    rng = np.random.default_rng(5)
    passage, own, mine = words(rng, 70), words(rng, 70), words(rng, 30)
    rows = [(9, passage), (None, f"{mine} {passage}"), (None, own), (None, own), (None, None)]
    got = pipeline.substring_dedup(spark, table(spark, rows), "").collect()
    texts = [r.text for r in got]
    assert len(got) == 4 and passage in texts and texts.count(own) == 1 and None in texts
    assert any(t and t.startswith(mine) and len(t) < len(mine) + 80 for t in texts)


def test_simhash_stage_tells_rows_apart(spark):
    rng = np.random.default_rng(6)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (3, d), (3, d)]
    got = pipeline.simhash_near_dedup(spark, table(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, a), (2, b), (None, c), (3, d), (3, d)], key=str)
