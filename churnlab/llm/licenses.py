"""License scans: Aho-Corasick over whole texts, licence expressions by a shunting-yard parser.

One automaton finds all notice phrases and the identifier tag in one pass over
the words of a text (each padded by spaces, so a phrase matches whole words
whatever stands between them). Where the tag or a notice opener occurs, the
expression behind it is read from the raw text up to the end of its line or the
next tag or opener, and evaluated: ``or`` lets the reader take the freer side,
``and`` binds to the stricter, ``with`` an exception loosens a copyleft licence.
An expression is the longest run of tokens that parses; one pass finds its end,
so the time is linear in the text however long a line is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnlab.llm.common import map_arrow, slices, texts

# The base phrases of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Phrases of the method (words as they are normalised) and their labels.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "apache license": "apache", "apache 2 0": "apache",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "cc0": "cc0", "public domain": "public-domain", "the unlicense": "public-domain",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "creative commons attribution": "creative-commons", "proprietary and confidential": "proprietary",
    "copyright c": "copyright", "all rights are reserved": "copyright",
}
TAG = "spdx license identifier"
OPENERS = ("licensed under", "released under", "available under", "distributed under")

#: Licence names of an expression -> (label, restrictiveness 0 to 1).
NAMES = {
    "mit": ("mit", 0.2), "isc": ("isc", 0.2), "bsd": ("bsd", 0.2), "bsd-2-clause": ("bsd", 0.2), "bsd-3-clause": ("bsd", 0.2),
    "apache": ("apache", 0.2), "apache-2.0": ("apache", 0.2), "zlib": ("zlib", 0.2), "cc0-1.0": ("cc0", 0.1), "cc0": ("cc0", 0.1),
    "unlicense": ("public-domain", 0.1), "mpl-2.0": ("mpl", 0.4), "epl-2.0": ("epl", 0.4),
    "lgpl": ("lgpl", 0.5), "gpl": ("gpl", 0.7), "agpl": ("agpl", 0.8),
    "cc-by": ("cc-by", 0.3), "cc-by-sa": ("cc-by-sa", 0.5), "cc-by-nc": ("cc-by-nc", 0.8), "cc-by-nd": ("cc-by-nd", 0.8),
}
_STRICT = {label: level for label, level in NAMES.values()} | {
    "reserved": 1.0, "proprietary": 1.0, "copyright": 0.9, "creative-commons": 0.3, "public-domain": 0.1, "license": 0.5}
_PRECEDENCE = {"with": 3, "and": 2, "or": 1}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
#: What the raw text must hold where the automaton finds a tag or an opener; the expression begins behind it.
_TAG_TEXT = re.compile(rb"SPDX-License-Identifier[ \t]*:[ \t]*", re.I)
_OPENER_TEXT = re.compile(rb"(?:licensed|released|available|distributed)\s+under\s+", re.I)
_LINE_END = re.compile(rb"[\r\n]")
_NUMBER = re.compile(r"[\d.]+")
_FILLER = {"the", "a", "an", "either", "terms", "of", "gnu", "license", "licence", "version", "v", "your", "choice"}


class BadExpression(ValueError):
    pass


def license_name(token: str) -> tuple[str, float] | None:
    """(label, restrictiveness) of a licence name; versions and ``-only``/``-or-later`` ends are ignored."""
    name = re.sub(r"(-only|-or-later|\+)$", "", token.lower().rstrip("."))
    return NAMES.get(name) or NAMES.get(re.sub(r"-?v?\d+(\.\d+)*$", "", name))


def parse(tokens: list[str]) -> list[str]:
    """Shunting yard: infix tokens of a licence expression to postfix; raises ``BadExpression``."""
    out, stack, want_operand = [], [], True
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not want_operand:
                raise BadExpression("operator expected")
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or want_operand:
                raise BadExpression("unexpected )")
            stack.pop()
        elif low in _PRECEDENCE:
            if want_operand:
                raise BadExpression("operand expected")
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            want_operand = True
        else:
            if not want_operand:
                raise BadExpression("operator expected")
            out.append(token)
            want_operand = False
    if want_operand or "(" in stack:
        raise BadExpression("expression ends early")
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """(labels named, restrictiveness of the whole expression)."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            (right, strict_r), (left, strict_l) = stack.pop(), stack.pop()
            if token == "with":  # the right side names an exception, not a licence
                stack.append((left, strict_l - 0.2 if 0.4 <= strict_l <= 0.8 else strict_l))
            else:
                stack.append((left | right, min(strict_l, strict_r) if token == "or" else max(strict_l, strict_r)))
        else:
            known = license_name(token)
            stack.append(({known[0]}, known[1]) if known else (set(), 0.5))
    return stack[0]


def complete_length(tokens: Iterable[str]) -> tuple[list[str], int]:
    """(tokens read, how many of them are the longest prefix that is a whole expression). Reading ends at the first token
    that no expression can go on with."""
    read, best, depth, want_operand = [], 0, 0, True
    for token in tokens:
        if token == "(":
            if not want_operand:
                break
            depth += 1
        elif token == ")":
            if want_operand or not depth:
                break
            depth -= 1
        elif token.lower() in _PRECEDENCE:
            if want_operand:
                break
            want_operand = True
        else:
            if not want_operand:
                break
            want_operand = False
        read.append(token)
        if not depth and not want_operand:
            best = len(read)
    return read, best


def expression_tokens(raw: str, notice: bool) -> Iterator[str]:
    """Tokens of a text. A notice skips filler words and ends at the first word that is neither a licence name nor an
    operator."""
    for match in _TOKEN.finditer(raw):
        token = match[0]
        if notice:
            if token.lower().rstrip(".") in _FILLER or _NUMBER.fullmatch(token):
                continue
            if token not in "()" and token.lower() not in _PRECEDENCE and not license_name(token):
                return
        yield token


def expression(raw: str, notice: bool = False) -> tuple[set[str], float] | None:
    """Evaluate the licence expression that a text begins with; None without one. What stands behind it is prose."""
    tokens, length = complete_length(expression_tokens(raw, notice))
    return evaluate(parse(tokens[:length])) if length else None


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    phrases: dict[str, list[tuple[str, str, int]]] = {}
    for kind, table in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""}), ("opener", dict.fromkeys(OPENERS, ""))):
        for phrase, label in table.items():
            phrases.setdefault(f" {phrase} ", []).append((kind, label, len(phrase) + 2))
    for phrase, values in phrases.items():
        found.add_word(phrase, tuple(values))
    found.make_automaton()
    return found


_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def expression_texts(raw: bytes, flat: bytes, openers: list[tuple[int, bool]]) -> Iterator[tuple[str, bool]]:
    """(text that an expression may begin, whether it is a notice's) behind each tag or opener, given by its first word:
    up to the end of the line or the next tag or opener. ``flat`` has the bytes of ``raw`` with blanks outside words."""
    if not openers:
        return
    blank = np.frombuffer(flat, np.uint8) == 32
    word_starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    found = []
    for word, notice in sorted(openers):
        match = (_OPENER_TEXT if notice else _TAG_TEXT).match(raw, int(word_starts[word]))
        if match:
            found.append((match.start(), match.end(), notice))
    ends = [start for start, _, _ in found[1:]] + [len(raw)]
    for (_, begin, notice), end in zip(found, ends):
        line = _LINE_END.search(raw, begin, max(begin, end))
        yield raw[begin: line.start() if line else max(begin, end)].decode("utf-8"), notice


def scan_text(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    raw = text.encode("utf-8")
    flat = raw.translate(_WORD_BYTES)
    words = [w for w in flat.split(b" ") if w]
    padded = " " + b" ".join(words).decode("utf-8") + " "
    starts, base, labels, openers = [], set(), set(), []
    seen, spaces = 0, 0
    for end, values in automaton().iter(padded):
        for kind, label, size in values:
            if kind == "notice":
                labels.add(label)
                continue
            at = end - size + 1
            # Matches come by their ends; the phrases are short, so stepping back is cheap.
            spaces += padded.count(" ", seen, at) if at >= seen else -padded.count(" ", at, seen)
            seen = at
            if kind == "base":
                starts.append(spaces)
                base.add(label)
            else:
                openers.append((spaces, kind == "opener"))
    labels |= base
    strict = max((_STRICT.get(x, 0.5) for x in labels), default=0.0)
    for part, notice in expression_texts(raw, flat, openers):
        result = expression(part, notice)
        if result and (result[0] or not notice):
            labels |= result[0] or {"license"}
            strict = max(strict, result[1])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), round(strict, 6))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the restrictiveness of the strictest licence found, 0 if none is.
    Null and empty texts have no words and no labels; null ids and repeated
    rows are returned as given; an empty table gives no rows; other columns are
    ignored. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double")
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [f.strip().split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [scan_text(t) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names)

    found = map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)
    return found.withColumnRenamed("doc_id", id_col)
