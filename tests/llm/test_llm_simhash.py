"""SimHash near-duplicates and components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from churnlab.llm import simhash
from churnlab.llm.common import read_table
from churnlab.llm.components import component_roots
from churnlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_classes(ids, prints, bits):
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    return groups(ids, links)


def test_query_against_brute_force(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    ids, prints = [r.doc_id for r in docs], [brute_fingerprint(r.text) for r in docs]
    classes = brute_classes(ids, prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", classes[i]) for i, p in zip(ids, prints)}


def test_edge_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (4, "a b", 9), (5, "A B", 9), (6, "one two three four", 9), (6, "one two three four", 9),
            (None, "one two three four", 9), (7, "x", 9), (8, "lang " * 60_000, 9), (9, "ÀÉ ÀÉ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert len(got) == len(rows)
    by_id = {r[1]: r for r in got}
    assert by_id[1][2:] == by_id[2][2:] == by_id[3][2:] == (0, 1)
    assert by_id[4][2:] == by_id[5][2:] and by_id[5][3] == 4
    assert [r[3] for r in got if r[1] == 6 or not r[0]] == [6, 6, 6]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert all(by_id[i][2] == signed(brute_fingerprint(t)) for i, t, _ in rows if i)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("small", [2, 256])
def test_links_keep_all_components(spark, monkeypatch, small):
    """Dense clouds, chains and far points; ``small`` 2 sends nearly all keys through the finer blocks."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 30)}
    for centre in list(prints)[:3]:
        at = centre
        for _ in range(40):
            at ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            prints.add(at)
            prints.add(centre ^ (1 << int(rng.integers(64))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3).collect()
    got = groups(signed, [(r.a, r.b) for r in links])
    want = groups(signed, [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    assert got == want


def test_forest_by_flipping_equals_pairs():
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 14, 6000).astype(np.uint64))  # 14 free bits, more than 2048 values
    assert len(prints) > 2048
    got = groups(prints.tolist(), simhash.forest(prints, 1))
    links = [(int(p), int(p) ^ (1 << b)) for p in prints for b in range(14) if int(p) ^ (1 << b) in set(prints.tolist())]
    assert got == groups(prints.tolist(), links)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)]
    links += [(int(a), int(b)) for a, b in rng.integers(5000, 5200, (90, 2))] + [(7, 7), (1, 0), (None, 3)]
    want = groups({n for l in links if None not in l and l[0] != l[1] for n in l}, [l for l in links if None not in l and l[0] != l[1]])
    got = component_roots(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert got.count() == len(want)
    assert component_roots(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
