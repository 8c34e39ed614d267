"""Null and repeated ids in archives and token files: every row keeps a record of its own."""

from __future__ import annotations

import hashlib

import numpy as np

from churnlab.llm import records
from churnlab.llm.queries import ORACLE, QUERIES
from scripts.check_oracle import duck, rows_of


def test_op8_null_and_repeated_pages(spark, tmp_path):
    long, other = "x" * 200, "y" * 200
    rows = [(None, "a", long), (None, "b", long), (None, None, None), (3, "c", long), (3, "c", long), (3, "d", other), (7, "e", other), (7, "e", other), (8, "f", "s"), (8, "f", "s")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op8_warc"](spark, str(tmp_path))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == sorted(
        ((i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i == 7 else "response", 3 if i == 7 else None) for i, _, h in rows), key=str)
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert rows_of(got.toPandas()) == rows_of(con.execute(ORACLE["op8_warc"]).df())


def test_op6_null_and_repeated_documents(spark, tmp_path):
    rows = [(None, "a b"), (None, "a b"), (None, None), (2, "c"), (2, "d e f"), (2, "c"), (-1, "g")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(QUERIES["op6_token_records"](spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, -1, 2, 2, 2]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_frames_hold_a_null_id():
    doc, ids = records.unpack_ids(records.unframe(records.frame(records.pack_ids(None, np.arange(3), 4))))
    assert doc is None and ids.tolist() == [0, 1, 2]
