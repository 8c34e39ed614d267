"""License scans against a brute-force word search."""

from __future__ import annotations

import random
import re
import time

import pytest

from churnlab.llm import licenses
from churnlab.llm.common import read_table
from churnlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i: i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_query_against_brute_force(spark):
    docs = {r.doc_id: brute(r.text) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = QUERIES["op3_license_scan"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == docs
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


EDGE = ["", None, "cc by", "CC-BY", "cc by cc by", "acc by", "cc bye", "cc\n\tBY!", "ccby", "general public license general public license",
        "All rights, reserved. CC by; GENERAL public license", "é cc by é", "\x00cc\x7fby", "all rights reserved " * 20_000, "... !!"]


def test_edge_texts(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(EDGE)], "doc_id long, text string, labels string, n_words int")
    got = licenses.scan(docs).collect()
    want = sorted([brute(t) for t in EDGE], key=str)
    assert sorted([(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str) == want
    assert licenses.scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize("text, labels, score", [
    ("SPDX-License-Identifier: MIT", {"mit"}, 0.2),
    ("// SPDX-License-Identifier: (MIT OR GPL-3.0-only)", {"mit", "gpl"}, 0.2),
    ("SPDX-License-Identifier: Apache-2.0 AND GPL-2.0-or-later", {"apache", "gpl"}, 0.7),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, 0.5),
    ("SPDX-License-Identifier: MIT OR GPL-2.0 AND AGPL-3.0", {"mit", "gpl", "agpl"}, 0.2),
    ("SPDX-License-Identifier: (MIT OR GPL-2.0) AND AGPL-3.0", {"mit", "gpl", "agpl"}, 0.8),
    ("SPDX-License-Identifier: Unheard-1.0", {"license"}, 0.5),
    ("SPDX-License-Identifier: ) (", set(), 0.0),
    ("Licensed under the MIT or Apache-2.0 license, at your choice.", {"mit", "apache"}, 0.2),
    ("The GNU Lesser General Public License", {"gpl", "lgpl"}, 0.7),
    ("Released under the MIT License.", {"mit"}, 0.2),
    ("Released under the MIT license by us. Later parts are licensed under GPL-3.0 only.", {"gpl", "mit"}, 0.7),
    ("Released under nothing here. Later parts are licensed under GPL-3.0 only.", {"gpl"}, 0.7),
    ("SPDX-License-Identifier: ISC SPDX-License-Identifier: MPL-2.0", {"isc", "mpl"}, 0.4),
    ("SPDX-License-Identifier: MIT OR (GPL-2.0 AND", {"mit"}, 0.2),
    ("licensed under licensed under\n the zlib licence", {"zlib"}, 0.2),
    ("unlicensed under MIT; spdx license identifier: GPL", set(), 0.0),
    ("é released under\tMIT or é GPL", {"gpl", "mit"}, 0.2),  # tokens are ASCII
    ("released under", set(), 0.0),
])
def test_method_labels(text, labels, score):
    found = licenses.scan_text(text)
    assert set(filter(None, found[5].split(","))) == labels
    assert found[6] == score


def test_shunting_yard():
    assert licenses.parse("a or b and c".split()) == ["a", "b", "c", "and", "or"]
    assert licenses.parse(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    for bad in (["or"], ["a", "b"], ["(", "a"], ["a", ")"], [], ["(", ")"], ["a", "or"]):
        with pytest.raises(licenses.BadExpression):
            licenses.parse(bad)


def brute_method(text):
    """Labels and score by plain searches: every place of a phrase, expressions by dropping tokens until they parse."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    padded = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    labels = {label for phrase, label in {**licenses.NOTICES, **licenses.BASE}.items() if f" {phrase} " in padded}
    strict = max((licenses._STRICT[x] for x in labels), default=0.0)
    edge = r"(?<![0-9A-Za-z\x80-\U0010ffff])"
    places = [(m.start(), m.end(), False) for m in re.finditer(edge + r"SPDX-License-Identifier[ \t]*:[ \t]*", text or "", re.I | re.A)]
    places += [(m.start(), m.end(), True) for m in re.finditer(edge + r"(?:licensed|released|available|distributed)\s+under\s+", text or "", re.I | re.A)]
    places.sort()
    for i, (_, begin, notice) in enumerate(places):
        part = re.split(r"[\r\n]", text[begin: places[i + 1][0] if i + 1 < len(places) else None])[0]
        tokens = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*", part)
        if notice:
            tokens = [t for t in tokens if t.lower().rstrip(".") not in licenses._FILLER and not re.fullmatch(r"[0-9.]+", t)]
            wrong = [k for k, t in enumerate(tokens) if t not in "()" and t.lower() not in ("and", "or", "with") and not licenses.license_name(t)]
            tokens = tokens[: wrong[0]] if wrong else tokens
        while tokens:
            try:
                named, level = licenses.evaluate(licenses.parse(tokens))
            except licenses.BadExpression:
                tokens.pop()
                continue
            if named or not notice:
                labels |= named or {"license"}
                strict = max(strict, level)
            break
    return ",".join(sorted(labels)), round(strict, 6)


def test_labels_and_score_against_brute_force(spark):
    rows = read_table(spark, SF, "documents").select("text").where("text is not null and length(text) < 20000").collect()
    rng = random.Random(5)
    parts = ["SPDX-License-Identifier:", "Licensed under", "released\tunder", "available under the", "MIT", "GPL-3.0", "apache-2.0", "AND", "or", "with",
             "(", ")", "Classpath", "unheard", "\n", "3.0", "the", "either", ".", "é", "cc by sa", "mit license", "xlicensed under", "spdx license identifier"]
    made = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    some = 0
    for text in [r.text for r in rows] + made + EDGE:
        got = licenses.scan_text(text or "")[5:]
        assert got == brute_method(text), text
        some += bool(got[0])
    assert some > 2000


@pytest.mark.parametrize("behind", ["word " * 200_000, "the " * 250_000, "(" * 1_000_000, "MIT OR " * 150_000, "licensed under x " * 60_000, "( MIT " * 150_000])
def test_long_lines_take_linear_time(behind):
    for tag in ("SPDX-License-Identifier: ", "Licensed under "):
        began = time.perf_counter()
        licenses.scan_text(tag + behind)
        assert time.perf_counter() - began < 5  # a second and a half at most when measured alone; quadratic work takes minutes
