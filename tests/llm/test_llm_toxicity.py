"""Toxicity: the grammar's effect on clauses, held-out accuracy, edge rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from churnlab.llm import toxicity
from churnlab.llm.common import read_table
from churnlab.llm.queries import QUERIES

CLASSES = toxicity.seed_classes() | {"moron": (toxicity.INSULT, 4.0), "scumb-": (toxicity.INSULT, 2.0)}
TRIGGERS = frozenset(w for w, (k, _) in CLASSES.items() if k in (toxicity.INSULT, toxicity.THREAT))


def total(text):
    return sum(toxicity.clause_scores(text, CLASSES, TRIGGERS, *toxicity.machine())[0])


def test_clauses_not_words():
    plain = total("what a moron")
    assert plain == 4.0
    assert total("you are a moron") == plain * toxicity.AIMED
    assert total("he is not a moron") < plain  # aimed, but negated
    assert total("she said what a moron") < total("she is here. what a moron")  # a report governs its own clause
    assert total("never mind. moron") == plain
    assert total("moron and moron") == pytest.approx(plain * 1.7)
    assert total("a scumbaggery") == 2.0 and total("clean words only") == 0.0 and total("") == 0.0
    assert total("i will kill you") > 0


def test_product_machine_multiplies_factors():
    after, factor = toxicity.compose(toxicity.GRAMMAR)
    assert after.shape == factor.shape and after.max() < len(after)
    state = after[0][toxicity.NEGATION]
    assert factor[state][toxicity.INSULT] == toxicity.NEGATED
    state = after[state][toxicity.TARGET]
    assert factor[state][toxicity.INSULT] == pytest.approx(toxicity.NEGATED * toxicity.AIMED)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in read_table(spark, sf, "labels").collect()}
    got = QUERIES["op7_toxicity"](spark, sf).collect()
    assert len(got) == read_table(spark, sf, "documents").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(toxic[r.doc_id], r.score, r.predicted) for r in got if r.held_out and r.doc_id in toxic]
    positive, negative = [h for h in held if h[0]], [h for h in held if not h[0]]
    assert np.mean([p for *_, p in positive]) >= 0.85
    assert np.mean([p for *_, p in negative]) <= 0.05
    a, b = np.array([h[1] for h in positive]), np.array([h[1] for h in negative])
    assert ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) >= 0.95


def test_copies_teach_nothing_new(spark):
    """A word of one much-copied toxic document is no insult; a word of many toxic contexts is."""
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = [("mark grim copied lines of one text " * 3, 1)] * 200
    rows += [(f"{word()} zonk {word()} {word()}", 1) for _ in range(60)] + [(" ".join(word() for _ in range(12)), 0) for _ in range(400)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "zonk" in lexicon and "grim" not in lexicon and "copied" not in lexicon


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (3, "moron " * 100_000, 2.0), (None, "fine", 2.0), (2, "", 2.0)],
                                 "doc_id long, text string, score double")
    model = toxicity.Model({"moron": 4.0}, (-3.0, 1.0, 0.5))
    got = {(r.doc_id, r.predicted) for r in toxicity.score(docs, model).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (None, 0)}
    assert toxicity.score(docs, model).count() == 5
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    empty = toxicity.learn(docs, labels)
    assert empty.insults == {} and {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_learning_is_bounded_by_rows(spark, monkeypatch):
    """One labelled id with any number of rows: different texts are drawn, equal rows calibrate once."""
    seen = []
    real = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "LEARN_ROWS", 300)
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y: (seen.append(len(y)), real(x, y))[1])
    rows = [(i, f"you are a zonk {k} today") for i in (1, 2, 3, 4) for k in range(1500)] + [(5, "a quiet day"), (6, "a quiet day")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(1, 7)], "doc_id long, toxic int")
    toxicity.learn(docs, labels)
    assert sum(seen) <= 400


def test_null_ids_are_not_held_out(spark, tmp_path):
    docs = [(None, "you moron"), (None, None)] + [(i, f"plain text {i}") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op7_toxicity"](spark, str(tmp_path)).collect()
    assert [r.held_out for r in got if r.doc_id is None] == [False, False] and len(got) == 32
