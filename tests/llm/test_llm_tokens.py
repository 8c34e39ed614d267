"""Token ids, record files and packing."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from churnlab.llm import packing, records, tokens
from churnlab.llm.common import read_table
from churnlab.llm.queries import QUERIES
from churnlab.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b", "a\n  b", "\n\n x", "x \n y", " lead", "trail ", "tab\tx", "a \t b", "é b c", "don't  we'll", "<|endoftext|>",
       "x <|endoftext|> y", "a   b    c", "日本 語  x", "a  b", "a   b", "\r\n \r\nq", "\x00a b", "a\n \nb c", "foo\n \nbar", "word " * 20_000]


@pytest.fixture(scope="module")
def direct():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_whole_texts(spark, direct):
    texts = ODD + [r.text for r in read_table(spark, SF, "documents").select("text").collect()]
    enc = Encoder(tokenizer_path())
    for part in (texts, texts[::-1], texts[:3]):
        ids, counts = enc.encode(part)
        cut = np.split(ids, np.cumsum(counts)[:-1])
        assert [c.tolist() for c in cut] == [direct(t) for t in part]
    assert enc.encode([])[1].tolist() == []


def test_a_full_cache_keeps_what_came_again(direct, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 40)
    enc, rare = Encoder(tokenizer_path()), iter(range(10_000))
    for _ in range(12):
        batch = [f"start the same words, the same again {next(rare)} x{next(rare)}  y {next(rare)}" for _ in range(9)] + ODD[:-1]
        ids, counts = enc.encode(batch)
        assert [c.tolist() for c in np.split(ids, np.cumsum(counts)[:-1])] == [direct(t) for t in batch]
        assert len(enc.start) == len(enc.length) == len(enc.uses) == len(enc.pieces)
    enc.encode([])  # the cache is over its bound here
    assert {"the", "same", "again", ("start",)} <= set(enc.pieces) and len(enc.pieces) <= 20
    monkeypatch.setattr(tokens, "MAX_IDS", 0)  # long texts count by their ids
    ids, _ = enc.encode(["the same again"])
    assert ids.tolist() == direct("the same again") and len(enc.pieces) == 3


def test_op6_reads_back_every_id(spark, direct):
    docs = sorted((r.doc_id, r.text) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect())
    want, start = [], 0
    for i, text in docs:
        ids = [*direct(text), 0]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = QUERIES["op6_token_records"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == want


def test_record_files_edge_rows(spark, direct):
    rows = [(5, None, "x"), (1, "", "x"), (3, "a <|endoftext|> b", "x"), (3, "a <|endoftext|> b", "x"), (-2, "word " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    folder, index = records.write_token_files(docs)
    index = records.with_global_start(index)
    got = sorted(tuple(r) for r in records.read_token_files(folder, index, ("start",)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want, start = [], 0
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*direct(text), 0]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    some = records.read_token_files(folder, index.where("doc_id = 3")).collect()  # any part of the index serves a shuffled read
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in some] == [[*direct(rows[2][1]), 0]] * 2
    _, empty = records.write_token_files(docs.limit(0))
    assert empty.count() == 0
    with pytest.raises(Exception, match="needs a document id"):
        records.write_token_files(spark.createDataFrame([(None, "a")], "doc_id long, text string"))


def test_frames_notice_damage():
    record = records.frame(records.pack_ids(7, np.arange(5), 2))
    doc, ids = records.unpack_ids(records.unframe(record))
    assert (doc, ids.tolist()) == (7, [0, 1, 2, 3, 4])
    for i in range(len(record)):
        broken = bytearray(record)
        broken[i] ^= 1
        with pytest.raises(records.CorruptRecord):
            records.unframe(bytes(broken))
    with pytest.raises(records.CorruptRecord):
        records.unframe(record[:-1])


def check_packing(rows, texts, direct, capacity, end_id):
    """The contract, row by row; returns the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids, at = [*direct(texts[i]), end_id], 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at: at + r.length]))
            assert len(own) == 1 or k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(own) == 1)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_op9_packs_everything(spark, direct):
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()}
    n = check_packing(QUERIES["op9_best_fit_packing"](spark, SF).collect(), texts, direct, 1024, 2)
    least = -(-sum(len(direct(t)) + 1 for t in texts.values()) // 1024)
    assert n <= least * 1.02 + 1


def test_packing_edge_rows(spark, direct):
    texts = {1: None, 2: "", 3: "word " * 3000, 4: "a b c", 5: "a b c"}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, length int")
    assert check_packing(packing.pack(docs, capacity=16).collect(), texts, direct, 16, 2) > 0
    assert packing.pack(docs.limit(0)).collect() == []
    twice = packing.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_plan_uses_every_piece_once(n):
    rng = np.random.default_rng(n)
    histogram = Counter(np.minimum(256, 1 + rng.lognormal(4, 1, n).astype(int)).tolist())
    plan, used = packing.pack_plan(dict(histogram), 256), Counter()
    for pattern, repeats in plan:
        assert sum(pattern) <= 256 and repeats > 0
        for length in pattern:
            used[length] += repeats
    assert used == histogram
    assert sum(r for _, r in plan) <= -(-sum(k * v for k, v in histogram.items()) // 256) * 1.03 + 2


def test_fit_reproduces_a_histogram_of_patterns():
    patterns = packing.length_patterns(np.array([100, 156, 64, 128]), 256)
    assert sorted(map(tuple, patterns.tolist())) == [(128, 64, 64), (128, 128, 0), (156, 100, 0)]
    counts = np.zeros(257, int)
    counts[[100, 156, 64, 128]] = 40, 40, 60, 50
    fitted = dict(zip(map(tuple, patterns.tolist()), packing.fit_repeats(patterns, counts)))
    assert abs(fitted[156, 100, 0] - 40) < 1 and abs(fitted[128, 64, 64] - 30) < 1 and abs(fitted[128, 128, 0] - 10) < 1
