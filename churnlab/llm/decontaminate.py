"""Benchmark decontamination by the q-gram lemma.

A passage of ``n`` characters that survives with at most ``e`` edits keeps at
least ``n + 1 - q * (e + 1)`` of its q-grams, and they lie on at most ``e + 1``
neighbouring diagonals (place in the document less place in the item). So the
tasks that scan the documents

1. hash every q-gram of the normalised text and look it up in the index of the
   benchmark's q-grams,
2. put the hits into diagonal bands that overlap by ``e`` diagonals, and keep
   the regions where a window of the passage length holds that many hits, and
3. verify each region by banded alignment within the edit budget.

The benchmark is the query set: it is read in blocks of bounded size and every
block is searched in all documents. No document is shuffled, and a passage that
a third of them hold costs each document its own alignment only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from churnlab.llm.common import map_arrow, ragged, slices, utf8

#: Characters of a q-gram.
Q = 12
#: A leak is a passage of this many normalised bytes (or the whole item, if it is shorter) within the edit budget.
PASSAGE = 96
EDIT_RATE = 0.05
#: Normalised bytes of benchmark text that are searched at once.
BLOCK_BYTES = 4 << 20
#: First-stage table: 2**22 flags.
_FLAGS_LOG2 = 22
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_FACTOR = 0x9E3779B97F4A7C15
#: Keeps diagonals positive.
_FAR = 1 << 40


def normalize(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): lower case, every run of other characters than letters and digits one space, ends trimmed.

    Normalised texts lie one after the other with a zero byte before each and after the last, so that no q-gram
    of letters runs from one text into the next.
    """
    raw, at = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    data, rows = _FOLD[raw], len(at) - 1
    solid = data != 32
    text_of = np.repeat(np.arange(rows), np.diff(at))
    # A space stays if the byte before it is solid and of the same text, and a solid byte of that text follows.
    before = np.concatenate(([False], solid[:-1]))
    before[at[:-1][at[:-1] < len(data)]] = False
    last = np.full(rows, -1)
    last[text_of[solid]] = np.flatnonzero(solid)
    kept = np.flatnonzero(solid | (before & (np.arange(len(data)) < last[text_of])))
    counts = np.bincount(text_of[kept], minlength=rows)
    start = np.cumsum(counts) - counts + np.arange(rows) + 1
    out = np.zeros(int(counts.sum()) + rows + 1, np.uint8)
    out[ragged(start, counts)] = data[kept]
    return out, np.concatenate((start, [len(out)])).astype(np.int64)


def gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit polynomial hash of the q bytes from each position, by doubling."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size, block = 1, data.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if q & size:
            part = block[done: done + n]
            shift = np.uint64(pow(_FACTOR, size, 1 << 64))
            out = part.copy() if out is None else out * shift + part
            done += size
        if size * 2 > q:
            return out
        block = block[:-size] * np.uint64(pow(_FACTOR, size, 1 << 64)) + block[size:]
        size *= 2


def passage_terms(length: int) -> tuple[int, int, int]:
    """(passage length, edit budget, q-grams that must be shared) for an item of ``length`` bytes."""
    n = min(length, PASSAGE)
    edits = int(EDIT_RATE * n)
    while edits and n + 1 - Q * (edits + 1) < 1:
        edits -= 1
    return n, edits, max(1, n + 1 - Q * (edits + 1))


@dataclass
class Index:
    """Q-grams of a block of items, sorted by hash: place of each in the joined item bytes, and what items ask for."""

    ids: list
    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    count: np.ndarray
    places: np.ndarray
    flags: np.ndarray
    passage: np.ndarray
    edits: np.ndarray
    shared: np.ndarray
    shorts: list


def build_index(ids: list, texts: list) -> Index:
    data, at = normalize(pa.array(texts, pa.string()))
    start, length = at[:-1], np.diff(at) - 1
    length = np.maximum(length, 0)
    grams = gram_hashes(data)
    item = np.repeat(np.arange(len(ids)), np.maximum(0, length - Q + 1))
    place = ragged(start, np.maximum(0, length - Q + 1))
    code = grams[place] if len(place) else np.zeros(0, np.uint64)
    order = np.argsort(code, kind="stable")
    hashes, first, count = np.unique(code[order], return_index=True, return_counts=True)
    flags = np.zeros(1 << _FLAGS_LOG2, bool)
    flags[hashes >> np.uint64(64 - _FLAGS_LOG2)] = True
    terms = np.array([passage_terms(int(n)) for n in length], np.int64).reshape(-1, 3)
    shorts = [(i, data[s: s + n].tobytes()) for i, (s, n) in enumerate(zip(start, length)) if 0 < n < Q]
    return Index(ids, data, start, length, hashes, first, count, place[order], flags, terms[:, 0], terms[:, 1], terms[:, 2], shorts)


def banded_edits(a: np.ndarray, b: np.ndarray, diagonals: int, budget: int) -> int:
    """Least edits that turn all of ``a`` into a part of ``b`` that begins on one of the first ``diagonals`` places, or
    budget + 1 if it takes more. Cell k of a row stands for diagonal k of the band."""
    width, far = diagonals + budget, budget + 1
    other = np.full(len(a) + width, 255, np.uint8)
    other[: min(len(b), len(other))] = b[: len(other)]
    step = np.arange(width)
    row = np.zeros(width, np.int64)
    row[diagonals:] = far
    for i, c in enumerate(a):
        down = np.append(row[1:], far) + 1  # a byte of `a` without partner
        best = np.minimum(row + (other[i: i + width] != c), down)
        best = np.minimum.accumulate(best - step) + step  # bytes of `b` without partner
        row = np.minimum(best, far)
        if row.min() > budget:
            return far
    return int(row.min())


def find_regions(index: Index, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Verified regions of joined normalised texts: (text, item, place in the text, place in the item, edits)."""
    hashes = gram_hashes(data)
    hit = np.flatnonzero(index.flags[hashes >> np.uint64(64 - _FLAGS_LOG2)])
    if not len(hit) or not len(index.hashes):
        return []
    where = np.minimum(np.searchsorted(index.hashes, hashes[hit]), len(index.hashes) - 1)
    true = index.hashes[where] == hashes[hit]
    hit, where = hit[true], where[true]
    if not len(hit):  # the flags alone matched
        return []
    text = np.searchsorted(at, hit, "right") - 1
    n = index.count[where]
    place = index.places[ragged(index.first[where], n)]
    doc_place, text = np.repeat(hit, n), np.repeat(text, n)
    item = np.searchsorted(index.start, place, "right") - 1
    item_place = place - index.start[item]
    doc_place = doc_place - at[text]
    diagonal = doc_place - item_place + _FAR
    # Bands are 2w wide and begin every w diagonals (w > edits): any e + 1 neighbouring diagonals lie in one of them.
    w = int(index.edits.max()) + 1
    band = np.concatenate((diagonal // w, diagonal // w - 1))
    text, item, doc_place, item_place = (np.tile(x, 2) for x in (text, item, doc_place, item_place))
    order = np.lexsort((item_place, band, item, text))
    text, item, band, doc_place, item_place = (x[order] for x in (text, item, band, doc_place, item_place))
    same = np.concatenate(([False], (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1])
                           & (item_place[1:] == item_place[:-1])))
    keep = ~same  # a q-gram of the item counts once in a band
    text, item, band, doc_place, item_place = (x[keep] for x in (text, item, band, doc_place, item_place))
    group = np.cumsum(np.concatenate(([1], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1]))))
    need, window = index.shared[item], index.passage[item] - Q
    ahead = np.arange(len(group)) + need - 1
    inside = ahead < len(group)
    ahead = np.minimum(ahead, len(group) - 1)
    retained = np.flatnonzero(inside & (group[ahead] == group) & (item_place[ahead] - item_place <= window))
    out, done = [], set()
    for k in retained:
        t, i, b = int(text[k]), int(item[k]), int(band[k])
        if (t, i) in done:
            continue
        size, budget = int(index.passage[i]), int(index.edits[i])
        text_bytes = data[at[t]: at[t + 1] - 1]
        item_bytes = index.data[index.start[i]: index.start[i] + index.length[i]]
        # Every passage that holds the shared q-grams of the window: from their last end backwards to their first place.
        low = max(0, int(item_place[ahead[k]]) + Q - size)
        high = min(int(item_place[k]), int(index.length[i]) - size)
        for p in range(high, low - 1, -1):
            if (t, i, b, p) in done:
                continue
            done.add((t, i, b, p))
            left = p + b * w - _FAR - budget  # the band's first diagonal, and as many before it as edits may shift
            part = np.concatenate((np.full(max(0, -left), 254, np.uint8), text_bytes[max(0, left): max(0, left + size + 2 * w + 3 * budget)]))
            edits = banded_edits(item_bytes[p: p + size], part, 2 * w + 2 * budget, budget)
            if edits <= budget:
                out.append((t, i, max(0, left + budget), p, edits))
                done.add((t, i))
                break
    return out


def short_regions(index: Index, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Items shorter than a q-gram: the whole item as whole words, without edits."""
    out = []
    if index.shorts:
        for t in range(len(at) - 1):
            text = b" " + data[at[t]: at[t + 1] - 1].tobytes() + b" "
            out += [(t, i, m.start(), 0, 0) for i, item in index.shorts
                    if (m := re.search(b"(?<= )" + re.escape(item) + b"(?= )", text))]
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of bounded size, streamed to the driver partition by partition."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t.encode("utf-8"))
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that share a passage: id, item id, doc_start and item_start (normalised
    bytes), passage length, edits.

    A passage is ``PASSAGE`` normalised bytes of the item, or all of a shorter
    one, found with at most ``EDIT_RATE`` edits per byte; items shorter than a
    q-gram must occur exactly, as whole words. Null and empty texts and items
    share nothing; null ids and repeated rows are reported like others; empty
    tables give no rows; other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType
    schema = f"id {kind}, item {item_kind.simpleString()}, doc_start long, item_start long, length long, edits long"
    item_type = pa.int64() if item_kind.simpleString() == "bigint" else pa.int32() if item_kind.simpleString() == "int" else pa.string()
    found = None
    for ids, texts in item_blocks(items, item_id_col, item_text_col):
        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            index = build_index(ids, texts)
            for batch in batches:
                for part in slices(batch, "text"):
                    data, at = normalize(part.column("text"))
                    rows = find_regions(index, data, at) + short_regions(index, data, at)
                    if rows:
                        t, i, doc_start, item_start, edits = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(pa.array(t)), pa.array([index.ids[k] for k in i], item_type),
                             *[pa.array(c, pa.int64()) for c in (doc_start, item_start, [int(index.passage[k]) for k in i], edits)]],
                            ["id", "item", "doc_start", "item_start", "length", "edits"])

        block = map_arrow(given, run, schema)
        found = block if found is None else found.unionByName(block)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"id": id_col, "item": item_id_col})


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """The rows (all columns) whose text shares no passage with the benchmark, as ``find_leaks`` defines it.

    Each block of items is a filter in the scan tasks, one behind the other: nothing is shuffled.
    """
    for ids, texts in item_blocks(items, item_id_col, item_text_col):
        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            index = build_index(ids, texts)
            for batch in batches:
                for part in slices(batch, text_col):
                    data, at = normalize(part.column(text_col))
                    clean = np.ones(part.num_rows, bool)
                    for row in (*find_regions(index, data, at), *short_regions(index, data, at)):
                        clean[row[0]] = False
                    yield part.filter(pa.array(clean))

        docs = map_arrow(docs, run, docs.schema)
    return docs
