"""Substring deduplication: cuts, passages, brute force over chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from churnlab.llm import substring
from churnlab.llm.common import read_table
from churnlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_cuts(text):
    """Cut places straight from the definition."""
    r, w = substring.REACH, substring.WINDOW
    raw = text.encode()
    data = b"\0" * r + raw + b"\0" * r
    space, rank = b"\t\n\v\f\r ", {}
    for i in range(r + 1, r + len(raw)):
        if data[i] & 0xC0 != 0x80:
            h = sum(int(substring.GEAR[data[i - 1 - k]]) << k for k in range(w) if i - 1 - k >= 0) & (2**64 - 1)
            rank[i] = (data[i - 1] not in space or data[i] in space, h >> 33)
    high = (2, 0)
    cuts = [i for i in rank if all(rank[i] < rank.get(j, high) for j in range(i - r, i)) and all(rank[i] <= rank.get(j, high) for j in range(i + 1, i + r + 1))]
    return ([0] if raw else []) + [i - r for i in cuts]


def own_cuts(text):
    data, start, length = substring.padded(pa.array([text]))
    return (substring.cut_places(data, start, length) - start[0]).tolist()


@pytest.mark.parametrize("text", ["", "a", "ab cd", "x" * 100, "é" * 40, "日本語 " * 30, " " * 50, "The quick brown fox. " * 9, "word\tand\nline\r\n" * 8])
def test_cuts_follow_the_definition(text):
    assert own_cuts(text) == brute_cuts(text)


def test_cuts_of_a_text_depend_on_it_alone(spark):
    texts = [r.text for r in read_table(spark, SF, "documents").select("text").limit(40).collect()] + ["", None]
    data, start, length = substring.padded(pa.array(texts))
    cuts = substring.cut_places(data, start, length)
    assert cuts.tolist() == [int(start[i]) + c for i, t in enumerate(texts) for c in own_cuts(t or "")]
    assert own_cuts(texts[0]) == brute_cuts(texts[0])


def test_an_insertion_moves_few_chunks(spark):
    text = " ".join(r.text for r in read_table(spark, SF, "documents").select("text").limit(5).collect())[:20_000]
    pieces = lambda t: {t.encode()[a:b] for a, b in zip(own_cuts(t), [*own_cuts(t)[1:], len(t.encode())])}
    before, after = pieces(text), pieces(text[:9000] + " inserted words " + text[9000:])
    assert len(before - after) <= 6


def brute_passages(docs, min_words):
    """{id: [(start, length, words, first)]} from dictionaries of chunks."""
    chunks, holders = {}, {}
    for i, text in docs:
        raw, cuts = (text or "").encode(), own_cuts(text or "")
        chunks[i] = [(a, raw[a:b]) for a, b in zip(cuts, [*cuts[1:], len(raw)])]
        for _, c in chunks[i]:
            holders.setdefault(c, set()).add(i)
    out = {}
    for i, own in chunks.items():
        run = []
        for a, c in [*own, (None, None)]:
            if a is not None and min(holders[c]) < i:
                run.append((a, c))
            else:
                if run:
                    raw = next(t for k, t in docs if k == i).encode()
                    start, end = run[0][0], run[-1][0] + len(run[-1][1])
                    opens = sum(1 for k in range(start, end) if not raw[k: k + 1].isspace() and (k == 0 or raw[k - 1: k].isspace()))
                    if opens >= min_words:
                        out.setdefault(i, []).append((start, end - start, opens, min(min(holders[c]) for _, c in run)))
                run = []
    return out


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {}
    for r in sorted(QUERIES["op1_substring_dedup"](spark, SF).collect()):
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.words, r.first_doc_id))
    assert got == brute_passages(docs, substring.MIN_WORDS) and got


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))


def test_planted_passages_and_clean_documents(spark):
    rng = np.random.default_rng(11)
    line = words(rng, 12) + "."
    shared = [words(rng, n) for n in (51, 55, 60, 80, 120)]
    rows, planted = [], set()
    for k in range(200):
        parts = [words(rng, int(rng.integers(30, 200))), line, words(rng, 20)]
        if k % 4 == 0:
            parts += [shared[k // 4 % 5], words(rng, 9)]
            planted.add(k)
        rows.append((k, " ".join(parts)))
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    firsts = {min(k for k in planted if k // 4 % 5 == j) for j in range(5)}
    assert {r.doc_id for r in found} == planted - firsts
    texts = dict(rows)
    for r in found:
        cut = texts[r.doc_id].encode()[r.start: r.start + r.length].decode()
        assert cut.strip() in texts[r.first_id] and r.first_id in firsts


def test_edge_rows_and_cut_texts(spark):
    rng = np.random.default_rng(2)
    passage, tail = words(rng, 70), words(rng, 30)
    rows = [(1, passage, 5), (2, passage, 5), (3, None, 5), (4, "", 5), (5, f"{tail} {passage}", 5), (5, f"{tail} {passage}", 5), (None, passage, 5),
            (6, f"{passage} {passage}", 5), (7, "lala " * 60_000, 5), (8, words(rng, 40), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    kept = sorted(((r.doc_id, r.text) for r in substring.without_repeats(docs).collect()), key=str)
    by_id = {}
    for i, t in kept:
        by_id.setdefault(i, []).append(t)
    assert by_id[1] == [passage] and 2 not in by_id  # a copy loses all its words and goes
    assert by_id[3] == [None] and by_id[4] == [""] and by_id[None] == [passage] and by_id[7] == [rows[8][1]] and by_id[8] == [rows[9][1]]
    assert len(by_id[5]) == 2 and all(t.startswith(tail) and len(t) < len(tail) + 80 for t in by_id[5])
    assert all(len(t) < 80 for t in by_id.get(6, []))
    assert substring.repeated_passages(docs.limit(0)).collect() == [] and substring.without_repeats(docs.limit(0)).collect() == []
    assert substring.without_repeats(docs).columns == docs.columns


def test_digests_are_long_only_where_a_chunk_may_be_half_a_window(spark):
    words = " ".join(f"word{i * 7919 % 1000}" for i in range(60))
    letters = "a" + " a" * 40  # one chunk of 41 words
    docs = [(1, 0, f"{words}. {letters}"), (2, 0, f"{letters} {words}"), (3, 0, letters), (4, 0, letters)]
    frame = spark.createDataFrame(docs, "id long, k long, text string")
    rows = substring.chunk_table(frame, 25).collect()
    few = [r for r in rows if r.words // 2 + r.words % 2 < 12.5]
    assert few and all(r.d1 == 0 for r in few)  # these make up the shuffle
    assert {r.d1 != 0 for r in rows if r not in few} == {True}
    assert sum(r not in few for r in rows) >= 4
    found = substring.repeated_passages(frame.select(frame.id.alias("doc_id"), "text"), min_words=25).collect()
    assert {(r.doc_id, r.first_id) for r in found} >= {(2, 1), (4, 2)}
