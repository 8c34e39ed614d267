"""Fill-in-the-middle: the skip list against sums of prefixes, the query against SQL, edge texts against a regex."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from churnlab.llm import infill, queries
from scripts.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text):
    text = text or ""
    found = UNITS.findall(text)
    n = len(found)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=600), st.integers(2, 9), st.data())
def test_descent_reaches_every_rank(widths, fan, data):
    lanes = infill.SkipList(np.array(widths, np.int64), fan)
    before = np.concatenate(([0], np.cumsum(widths))).astype(int).tolist()
    for rank in {0, len(widths), *data.draw(st.lists(st.integers(0, len(widths)), max_size=8))}:
        assert lanes.code_point_of(rank) == before[rank]
    for rank in (-1, len(widths) + 1):
        with pytest.raises(IndexError):
            lanes.code_point_of(rank)


def test_descent_takes_few_steps():
    """A link passes over FAN links of the lane below, in units and in code points."""
    lanes = infill.SkipList(np.arange(1, 100_001))
    assert len(lanes.lanes) == 6 and [len(u) for u, _ in lanes.lanes] == [100_000, 12_500, 1563, 196, 25, 4]
    assert all(int(u.sum()) == 100_000 and int(w.sum()) == 100_000 * 100_001 // 2 for u, w in lanes.lanes)


def test_query_equals_sql(spark):
    name = "op13_fill_in_middle"
    con = duck(SF)
    ok, message = compare(name, queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df())
    con.close()
    assert ok, message


def test_edge_texts_nulls_and_repeats(spark):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "  a  b  ", "é中\U0001f600  x y", "has <P> in it", "<S>", "x<M>", "< P>", "a\x00b \x1fc", "é combining"]
    rows = [(i, t) for i, t in enumerate(texts * 6)] + [(None, "no id at all"), (None, "no id at all"), (7, "another text of seven"), (-5, "negative id here"), (2 ** 62, "long id")]
    rows.append((999, " ".join(f"wé{i}" for i in range(300_000))))
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n int, form string").repartition(5)
    out = infill.transform(docs)
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((brute(*r) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    assert sorted((r.back for r in got)) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
