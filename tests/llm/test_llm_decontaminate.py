"""Benchmark decontamination against brute-force alignment."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from churnlab.llm import decontaminate as dc
from churnlab.llm.common import read_table
from churnlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(text):
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower()))


def least_edits(a, b):
    """Least edits that turn all of a into some part of b."""
    row = [0] * (len(b) + 1)
    for c in a:
        new = [row[0] + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_normalised_texts(spark):
    texts = ["", None, "  A  b! ", "--x--", "É é", "a", "!!", *[r.text for r in read_table(spark, SF, "documents").limit(50).collect()]]
    data, at = dc.normalize(pa.array(texts))
    assert [data[a: b - 1].tobytes().decode() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]


def test_gram_hashes_are_positional():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 2, np.uint8)
    h = dc.gram_hashes(data)
    assert len(h) == len(data) - dc.Q + 1 and h[0] == h[26] and len(set(h.tolist())) == 26
    assert len(dc.gram_hashes(data[: dc.Q - 1])) == 0


def test_banded_alignment_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = rng.integers(97, 100, 40).astype(np.uint8)
        b = a.copy()
        for _ in range(int(rng.integers(0, 6))):
            k = int(rng.integers(len(b)))
            b = [np.delete(b, k), np.insert(b, k, 120), np.where(np.arange(len(b)) == k, 121, b)][int(rng.integers(3))].astype(np.uint8)
        lead = rng.integers(97, 100, int(rng.integers(4, 11))).astype(np.uint8)  # as many diagonals before the match as edits
        b = np.concatenate((lead, b, rng.integers(97, 100, 8).astype(np.uint8)))
        assert dc.banded_edits(a, b, 16, 4) == min(least_edits(a.tobytes(), b.tobytes()), 5)


def test_query_finds_all_whole_items_and_nothing_else(spark):
    docs = {r.doc_id: plain(r.text) for r in read_table(spark, SF, "documents").collect()}
    items = {r.item_id: plain(r.text) for r in read_table(spark, SF, "benchmark").collect()}
    got = QUERIES["op4_decontamination"](spark, SF).collect()
    whole = {(d, i) for d, text in docs.items() for i, item in items.items() if item in text}
    assert whole and whole <= {(r.doc_id, r.item_id) for r in got}
    for r in got:  # each row is a passage within its budget
        passage = items[r.item_id].encode()[r.item_start: r.item_start + r.length]
        near = docs[r.doc_id].encode()[max(0, r.doc_start - 20): r.doc_start + r.length + 40]
        assert least_edits(passage, near) == r.edits <= dc.EDIT_RATE * r.length


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        k = int(rng.integers(len(text)))
        text[k: k + 1] = [[], ["q"], [text[k], "z"]][int(rng.integers(3))]
    return "".join(text)


def test_planted_leaks_with_edits(spark):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))
    items = [(k, prose(40)) for k in range(20)] + [(20, prose(8)[:40]), (21, "tiny item"), (22, ""), (23, None)]
    rows, leaks = [], set()
    for k in range(120):
        body = [prose(60), prose(60)]
        if k % 3 == 0:
            item = k // 3 % 20
            body.insert(1, edited(rng, items[item][1], k // 3 % 4).upper().replace(" ", "  "))
            leaks.add((k, item))
        elif k % 3 == 1:
            body.insert(1, items[k % 20][1][:60])  # well below a passage
        rows.append((k, ". ".join(body), "x"))
    rows += [(500, f"a, tiny; ITEM!", "x"), (501, "tiny items", "x"), (502, None, "x"), (503, "", "x"), (None, items[3][1], "x"),
             (504, items[20][1], "x"), (504, items[20][1], "x"), (505, prose(100_000) + items[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks | {(500, 21), (None, 3), (504, 20), (505, 5)}
    clean = dc.without_leaks(docs, bench)
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted(
        (i for i, _, _ in rows if i is not None and i not in {d for d, _ in leaks} | {500, 504, 505}), key=str)
    assert clean.columns == docs.columns
    assert dc.find_leaks(docs.limit(0), bench).collect() == [] and dc.find_leaks(docs, bench.limit(0)).collect() == []
    assert dc.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_flags_that_match_without_a_q_gram():
    index = dc.build_index([1], ["a passage of the benchmark that is long enough to be looked for"])
    index.flags[:] = True  # every q-gram passes the first stage, none the second
    assert dc.find_regions(index, *dc.normalize(pa.array(["some other words, none of them shared"]))) == []


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    pairs = lambda: {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()}
    whole = pairs()
    monkeypatch.setattr(dc.item_blocks, "__defaults__", (2000,))
    assert len(list(dc.item_blocks(items, "item_id", "text"))) > 3 and pairs() == whole
