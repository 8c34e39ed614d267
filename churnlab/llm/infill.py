"""Fill-in-the-middle transformation over an indexable skip list.

A text is a sequence of units (the white space before a word and the word, or
white space at the end). The units are the lowest lane of a skip list; every
lane above links every ``FAN``-th node of the lane below. A link carries how many
units and how many code points it passes over, so a descent that adds up widths
reaches the unit of any rank, and the code point where it begins, in
O(FAN * log units) steps without looking at the text again.

Both cut ranks come from a SHA-256 of the document id, so a rerun cuts alike.
The lanes of a whole slice of texts are built by numpy inside the tasks; a text
is never split over rows, nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from churnlab.llm.common import map_arrow, slices, texts, utf8

#: Nodes of a lane that a link of the next lane passes over.
FAN = 8
#: What opens prefix, suffix and middle in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and percent of those that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80


class SkipList:
    """Lanes over the units of one text. ``lanes[0]`` has the code points of every unit; a link of a higher lane carries
    (units, code points) of the ``FAN`` links below it."""

    def __init__(self, code_points: np.ndarray, fan: int = FAN):
        self.n, self.fan = len(code_points), fan
        units, points = np.ones(self.n, np.int64), np.asarray(code_points, np.int64)
        self.lanes = [(units, points)]
        while len(units) > fan:
            opens = np.arange(0, len(units), fan)
            units, points = np.add.reduceat(units, opens), np.add.reduceat(points, opens)
            self.lanes.append((units, points))

    def code_point_of(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to n), by a descent from the highest lane."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        node = passed = points = 0
        for units, widths in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                points += int(widths[node])
                node += 1
            node *= self.fan  # the same place in the lane below
        return points


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of every unit of all rows, units of each row). White space: 0x20 and 0x09 to 0x0D."""
    raw, at = utf8(column)
    solid = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    last = np.zeros(len(raw), bool)          # bytes that end a unit
    last[:-1] = solid[:-1] & ~solid[1:]
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    ends = np.flatnonzero(last) + 1
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[ends]
    before = np.searchsorted(ends, at, side="right")
    return np.diff(points, prepend=0), np.diff(before)


def draws(doc_id: int | None, seed: int = 42) -> list[int]:
    """Four numbers from the SHA-256 of ``seed:id`` (nothing stands for a null id)."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i: i + 8], 16) for i in range(0, 32, 8)]


def plan(text: str, n: int, doc_id: int | None, seed: int = 42) -> tuple[str, int, int]:
    """(form, rank of the first cut, rank of the second cut) of a text of n units."""
    first, second, rate, order = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or rate % 100 >= RATE:
        return "plain", 0, 0
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return "spm" if order % 100 < SUFFIX_FIRST else "psm", a, b


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per document: id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle). Null and
    empty texts are plain with n 0 and an empty output; a text that holds one of the marks is plain; a null id counts as
    an empty one; repeated ids are cut by the same numbers, each in its own text; an empty table gives no rows; other
    columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column("text")
                points, counts = units(column)
                ends = np.cumsum(counts).tolist()
                forms, heads, middles, out = [], [], [], []
                for doc, text, n, end in zip(part.column("id").to_pylist(), texts(column), counts.tolist(), ends):
                    form, a, b = plan(text, n, doc, seed)
                    if form != "plain":
                        lanes = SkipList(points[end - n: end])
                        a, b = lanes.code_point_of(a), lanes.code_point_of(b)
                        prefix, middle, suffix = text[:a], text[a:b], text[b:]
                        text = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
                    forms.append(form)
                    heads.append(None if form == "plain" else a)
                    middles.append(None if form == "plain" else b - a)
                    out.append(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()),
                     pa.array(out, pa.string())], schema.names)

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType)]).add("n", "long").add("form", "string") \
        .add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone (no text that holds a mark is ever cut)."""
    after = lambda text, left: F.substring(text, F.length(left) + len(MIDDLE) + 1, F.length(text))
    head = F.substring_index(output, MIDDLE, 1)
    middle = after(output, head)
    rest = F.substring(head, len(MIDDLE) + 1, F.length(head))  # psm: prefix<S>suffix, spm: suffix<P>prefix
    prefix, suffix = F.substring_index(rest, SUFFIX, 1), F.substring_index(rest, PREFIX, 1)
    psm = F.concat(prefix, middle, after(rest, prefix))
    spm = F.concat(after(rest, suffix), middle, suffix)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
