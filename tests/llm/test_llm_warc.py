"""WARC archives against SQL and by round trip."""

from __future__ import annotations

import hashlib

import pytest

from churnlab.llm import files, warc
from churnlab.llm.common import read_table
from churnlab.llm.queries import ORACLE, QUERIES
from scripts.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"


def test_query_against_sql(spark):
    ok, why = compare("op8", QUERIES["op8_warc"](spark, SF).toPandas(), duck(SF).execute(ORACLE["op8_warc"]).df())
    assert ok, why


def test_payloads_come_back_and_copies_revisit(spark):
    html = {1: None, 2: "", 3: "é" * 50, 4: "x" * 99, 5: "x" * 99, 6: "<p>\r\n\r\n" * 40, 7: "é" * 50, 8: "é" * 50, 9: "y" * 3_000_000}
    rows = [(i, None if i == 4 else f"http://a/{i}\r\nWARC-Type: hoax", h, "noise", 3) for i, h in html.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, size int")
    folder, index = warc.write_archives(pages)
    got = {r.page_id: r for r in warc.read_archives(folder, index, payloads=True).collect()}
    assert set(got) == set(html)
    for i, r in got.items():
        raw = (html[i] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if i in (7, 8) else ("response", None))
        assert r.payload == (None if i in (7, 8) else raw)
    assert got[4].url == "" and got[3].url == "http://a/3%0D%0AWARC-Type: hoax"
    picked = index.where("page_id in (3, 8)")  # a selection reads only its own ranges
    assert sorted(r.page_id for r in warc.read_archives(folder, picked).collect()) == [3, 8]


def test_empty_and_bad_tables(spark):
    pages = read_table(spark, SF, "pages")
    folder, index = warc.write_archives(pages.limit(0))
    assert warc.read_archives(folder, index).collect() == []
    with pytest.raises(Exception, match="needs an id"):
        warc.write_archives(spark.createDataFrame([(None, "u", "h")], "page_id long, url string, html string"))
    with pytest.raises(ValueError, match="unique"):
        warc.write_archives(spark.createDataFrame([(1, "u", "h"), (1, "u", "h")], "page_id long, url string, html string"))


def test_records_notice_damage():
    record = warc.record_bytes(1, "u", b"abc", 3, "0", None)
    assert warc.parse_record(record)[1] == b"abc"
    for bad in (record[:-1], b"X" + record[1:], record.replace(b"Content-Length: 3", b"Content-Length: 2")):
        with pytest.raises(warc.CorruptRecord):
            warc.parse_record(bad)


def test_ranges_are_merged():
    assert files.coalesce([(0, 10), (10, 5), (20, 5), (1000, 10)], gap=10, most=100) == [(0, 25, 0, 3), (1000, 10, 3, 1)]
    assert files.coalesce([(0, 90), (90, 20)], gap=10, most=100) == [(0, 90, 0, 1), (90, 20, 1, 1)]
    assert files.coalesce([]) == []
