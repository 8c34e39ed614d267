"""Substring deduplication by content-defined chunking with a gear rolling hash.

1. The scan tasks cut every text where the gear hash of the bytes before a place
   is the least within ``REACH`` bytes on either side, places behind white space
   first. A cut depends on the bytes around it alone, so an insertion moves the
   cuts next to it and no others, and chunks are whole words where a text has
   words.
2. Chunks travel as digests with their place, never as text: 128 bits where a
   chunk may make up most of a window, 64 bits otherwise, so that every window
   stands for 128 bits at least and the shuffled rows are small. A partial
   aggregate finds the digests that several documents hold and the document
   that keeps each of them (the smallest id). A digest that a third of all
   documents hold is one row of that table, and the join that marks its copies
   can be split by adaptive execution.
3. Per document, neighbouring shared chunks form runs, and a run gives its
   windows: the chunks from one chunk on (or up to one) that reach ``MIN_WORDS``
   words. Windows are digested and grouped by smallest id as the chunks are. Only
   a window that one earlier document holds whole is repeated; windows that
   overlap or touch are one passage. Lines that are frequent each for itself make
   no passage by standing side by side.

Chunks are 33 bytes on average. A passage of 50 words or more (some 300 bytes)
loses less than two chunks at either end and so always leaves a run; shared
sentences and lines below ``MIN_WORDS`` words stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from churnlab.llm.common import map_arrow, row_keys, slices, utf8

#: Bytes that the rolling hash covers, and how far a cut must be the least on either side (powers of two, the first not
#: the larger one).
WINDOW, REACH = 16, 16
#: Words of a run of repeated chunks from which it counts as a passage.
MIN_WORDS = 25
#: The gear: a pseudo-random 64-bit number for each byte.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_NEVER = np.uint32(0xFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the ``WINDOW`` bytes up to each byte: sum of gear << age, by doubling."""
    h, size = GEAR[data], 1
    while size < WINDOW:
        older = np.zeros_like(h)
        older[size:] = h[:-size] << np.uint64(size)
        h = h + older
        size *= 2
    return h


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte of each text, length of each text); ``REACH`` zero bytes stand before, between and behind
    the texts, so that the cuts of a text depend on nothing but the text."""
    column = pc.fill_null(column, "")
    pad = "\0" * REACH
    raw, at = utf8(pc.binary_join_element_wise(pa.scalar(pad, column.type), column, pa.scalar("", column.type)))
    return np.concatenate((raw, np.zeros(REACH, np.uint8))), at[:-1] + REACH, np.diff(at) - REACH


def cut_places(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of ``data`` where chunks begin, the beginning of every text included.

    The rank of a place is the hash of the bytes before it; places behind white
    space rank below all others, and those inside a UTF-8 character are no
    candidates. A cut has the least rank within ``REACH`` bytes on either side
    (the first of equals).
    """
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, start + (length > 0), 1)  # the first byte is a cut anyway
    np.add.at(inside, start + length, -1)
    candidate = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
    rank = np.full(len(data), _NEVER)
    before = (gear_hash(data)[:-1] >> np.uint64(33)).astype(np.uint32)  # 31 bits
    space = _SPACE[data]
    rank[1:] = np.where(space[:-1] & ~space[1:], before, before | np.uint32(1 << 31))
    rank[~candidate] = _NEVER
    edge = np.full(REACH, _NEVER)
    least, size = np.concatenate((edge, rank, edge)), 1
    while size < REACH:  # least[i]: of the REACH places from i on, counted in the padded ranks
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    cut = (rank < least[: len(data)]) & (rank <= least[REACH + 1: REACH + 1 + len(data)]) if len(data) else np.zeros(0, bool)
    cut &= rank != _NEVER
    cut[start[length > 0]] = True
    return np.flatnonzero(cut)


CHUNKS = "id {id}, k long, d0 long, d1 long, at int, length int, words int"


def chunk_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per chunk of (id, k, text): id, k, digest (d0, d1), offset and length in bytes, and
    twice the words that begin in it, plus 1 if it begins inside a word.

    ``d1`` is 0 in chunks that hold less than half the words of a window: such a
    window has several chunks, whose digests are compared together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, "text"):
                data, start, size = padded(part.column("text"))
                cuts = cut_places(data, start, size)
                if not len(cuts):
                    continue
                row = np.searchsorted(start, cuts, "right") - 1
                ends = np.minimum(np.append(cuts[1:], len(data)), (start + size)[row])
                raw = data.tobytes()
                digests = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(cuts.tolist(), ends.tolist())]), "<i8").reshape(-1, 2)
                solid = ~_SPACE[data] & (data != 0)
                opens = np.concatenate(([0], np.cumsum(solid & ~np.concatenate(([False], solid[:-1])))))
                joined = (cuts > start[row]) & solid[cuts] & solid[cuts - 1]
                words = opens[ends] - opens[cuts]
                second = np.where(2 * (words + joined) < min_words, 0, digests[:, 1])
                columns = [digests[:, 0].copy(), second, (cuts - start[row]).astype(np.int32),
                           (ends - cuts).astype(np.int32), (2 * words + joined).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(row)) for c in ("id", "k")], *map(pa.array, columns)],
                                                 ["id", "k", "d0", "d1", "at", "length", "words"])

    return map_arrow(docs, run, CHUNKS.format(id=docs.schema["id"].dataType.simpleString()))


def _holders(rows: DataFrame, null_ids: bool) -> DataFrame:
    """The rows whose digest (d0, d1) several documents hold, with the smallest such id (``first``).

    With ``null_ids``, rows without an id come after all others, in the order of
    their numbers ``k`` (``first_row``: the smallest); ``first`` is null where no
    row with an id holds the digest.
    """
    found = [F.min("id").alias("first"), F.max("id").alias("last")]
    shared = F.col("first") != F.col("last")
    if null_ids:
        number = F.when(F.col("id").isNull(), F.col("k"))
        found += [F.min(number).alias("first_row"), F.max(number).alias("last_row")]
        shared = F.coalesce(shared, F.lit(False)) | (F.col("first_row") != F.col("last_row")) | (F.col("first").isNotNull() & F.col("first_row").isNotNull())
    held = rows.groupBy("d0", "d1").agg(*found).where(shared).drop("last", "last_row")
    return rows.join(held, ["d0", "d1"])


def _later(null_ids: bool) -> F.Column:
    """True for the rows of ``_holders`` that stand behind a document that holds the digest too."""
    later = F.col("id") != F.col("first")
    return F.when(F.col("id").isNotNull(), later).otherwise(F.col("first").isNotNull() | (F.col("k") != F.col("first_row"))) if null_ids else later


WINDOWS = "id {id}, k long, d0 long, d1 long, at int, stop int, opens int, closes int, least {id}"


def window_places(words: np.ndarray, joined: np.ndarray, min_words: int, begin: np.ndarray | None = None) -> np.ndarray:
    """(first, last) chunk of the least windows with ``min_words`` words that begin or end at each chunk of its run, in
    order; runs begin at the chunks ``begin`` (one run if it is left out).

    The first word of a window counts even if the document goes on with it from
    the chunk before (``joined``), so equal chunks make equal windows everywhere.
    Every run with enough words is the union of its windows.
    """
    n = len(words)
    begin = np.zeros(min(n, 1), np.int64) if begin is None else begin
    size = np.diff(begin, append=n)
    low, high = np.repeat(begin, size), np.repeat(begin + size, size)  # each chunk's run
    gap = 2 * np.repeat(np.arange(len(begin)), size)  # keeps the counts of a run above those of the runs before it
    upto = np.cumsum(words) + gap
    before = upto - words - joined  # words(i..j) = upto[j] - before[i], and before never falls
    last = np.searchsorted(upto, before + min_words)  # least j for each i
    first = np.searchsorted(before, upto - min_words, "right") - 1  # greatest i for each j
    ahead, behind = np.flatnonzero(last < high), np.flatnonzero(first >= low)
    pairs = np.concatenate((ahead * n + np.maximum(ahead, last[ahead]), np.minimum(first[behind], behind) * n + behind))
    return np.stack(np.divmod(np.unique(pairs), max(n, 1)), 1)


def least_within(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``values[first[i]]`` to ``values[last[i]]`` for each i, from the least of 1, 2, 4 ... values."""
    out, level = np.empty(len(first), values.dtype), np.frexp(last - first + 1)[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        at, size = np.flatnonzero(level == k), 1 << k
        out[at] = np.minimum(values[first[at]], values[last[at] - size + 1])
        values = np.minimum(values[:-size], values[size:])
    return out


def ranks(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(rank of each value among the distinct ones, the distinct ones in order with a null behind them)."""
    coded = column.dictionary_encode()
    values = coded.dictionary.to_pylist()
    order = sorted(range(len(values)), key=values.__getitem__)
    rank = np.empty(len(values) + 1, np.int64)
    rank[[*order, len(values)]] = np.arange(len(values) + 1)
    return rank[pc.fill_null(coded.indices, len(values)).to_numpy(zero_copy_only=False)], pa.array([*[values[i] for i in order], None], column.type)


def window_table(chunks: DataFrame, min_words: int) -> DataFrame:
    """Windows of ``min_words`` words within runs of neighbouring shared chunks: place, digest, and the words of the
    document's shared chunks before its beginning (``opens``) and its end (``closes``), ``first`` of its
    chunks (``least``)."""
    # A document's shared chunks are bounded by its own text.
    per_doc = chunks.groupBy("id", "k").agg(F.array_sort(F.collect_list(F.struct("at", "length", "words", "d0", "d1", "first"))).alias("chunks"))
    kind = chunks.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            rows = batch.column("chunks")
            doc, part = pc.list_parent_indices(rows).to_numpy(), rows.flatten()
            if not len(doc):
                continue
            at = part.field("at").to_numpy()
            one = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))))  # rows that repeat an id and its text
            doc, at = doc[one], at[one]
            length, counted, d0, d1 = (part.field(c).to_numpy()[one] for c in ("length", "words", "d0", "d1"))
            words, joined = (counted >> 1).astype(np.int64), counted & 1
            new = np.concatenate(([True], doc[1:] != doc[:-1]))
            begin = np.flatnonzero(new | np.concatenate(([True], at[1:] > at[:-1] + length[:-1])))
            a, b = window_places(words, joined, min_words, begin).T
            if not len(a):
                continue
            raw = np.stack((d0, d1), 1).tobytes()
            digests = np.frombuffer(b"".join([digest(raw[x:y]) for x, y in zip((16 * a).tolist(), (16 * b + 16).tolist())]), "<i8").reshape(-1, 2)
            upto = np.concatenate(([0], np.cumsum(words)))
            start = upto[:-1][new][np.cumsum(new) - 1]  # words before each chunk's document
            firsts, values = ranks(part.field("first").take(pa.array(one)))
            columns = [digests[:, 0].copy(), digests[:, 1].copy(),
                       *[c.astype(np.int32) for c in (at[a], at[b] + length[b], upto[a] - start[a], upto[b + 1] - start[a])]]
            own = pa.array(doc[a])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in ("id", "k")], *map(pa.array, columns), values.take(pa.array(least_within(firsts, a, b)))],
                                             [f.split()[0] for f in WINDOWS.split(", ")])

    return map_arrow(per_doc, run, WINDOWS.format(id=kind))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage that goes: id, start and length (bytes of the UTF-8 text), words, first_id.

    A chunk goes where a document with a smaller id holds a window of
    ``min_words`` words around it too; first_id is the smallest such id of the
    passage's chunks. Repetition inside one document
    stays. Null and empty texts and rows without an id have no passages; rows
    that repeat an id and its text are one document, those that repeat an id
    with another text one each; empty tables give no rows; other columns are
    ignored.
    """
    keyed = row_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "k", "id", null_ids=False)
    return keyed_passages(keyed.where(F.col("id").isNotNull()), min_words).drop("k").withColumnsRenamed({"id": id_col})


def keyed_passages(docs: DataFrame, min_words: int = MIN_WORDS, null_ids: bool = False) -> DataFrame:
    """``repeated_passages`` of (id, k, text) with ``row_keys`` k: id, k, start, length, words, first_id."""
    windows = window_table(_holders(chunk_table(docs, min_words), null_ids), min_words)
    marked = _holders(windows, null_ids).where(_later(null_ids))
    per_doc = marked.groupBy("id", "k").agg(F.array_sort(F.collect_list(F.struct("at", "stop", "opens", "closes", "least"))).alias("windows"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, k long, start long, length long, words long, first_id {kind}"
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, rows in zip(batch.column("id").to_pylist(), batch.column("k").to_pylist(), batch.column("windows")):
                part = rows.values
                places = (part.field(c).to_numpy() for c in ("at", "stop", "opens", "closes"))
                out += [(doc, key, *p) for p in passages(*places, part.field("least").to_pylist(), min_words)]
            if out:
                ids, *numbers, first = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, pa.int64()) for c in numbers], pa.array(first, id_type)],
                                                 ["id", "k", "start", "length", "words", "first_id"])

    return map_arrow(per_doc, run, schema)


def passages(at: np.ndarray, stop: np.ndarray, opens: np.ndarray, closes: np.ndarray, least: list, min_words: int) -> list[tuple]:
    """(start, length, words, smallest first id) of the unions of touching windows with enough words (sorted input)."""
    if not len(at):
        return []
    begin = np.flatnonzero(np.concatenate(([True], at[1:] > np.maximum.accumulate(stop)[:-1])))
    end = np.append(begin[1:], len(at))
    out = []
    for a, b in zip(begin.tolist(), end.tolist()):
        words = int(closes[a:b].max() - opens[a])
        if words >= min_words:
            out.append((int(at[a]), int(stop[a:b].max() - at[a]), words, min((f for f in least[a:b] if f is not None), default=None)))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                    null_ids: bool = False) -> DataFrame:
    """All rows and columns, with the repeated passages cut out of the text; a document left without a word goes.

    Passages are matched to rows by id and text; null texts stay as they are.
    Rows without an id stay too, or with ``null_ids`` count as documents of
    their own that come after all others.
    """
    names, where = docs.columns, docs.columns.index(text_col)
    mark = "_".join(["spans", *names])  # no column of the table has this name
    docs = row_keys(docs, f"{mark}_k", id_col, text_col, null_ids)
    given = docs.select(F.col(id_col).alias("id"), F.col(f"{mark}_k").alias("k"), F.col(text_col).alias("text"))
    spans = keyed_passages(given if null_ids else given.where(F.col("id").isNotNull()), min_words, null_ids)
    per_doc = spans.groupBy(F.col("id").alias(f"{mark}_id"), F.col("k").alias(f"{mark}_key")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias(mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in names]
            marked = pc.and_(batch.column(mark).is_valid(), columns[where].is_valid()).to_numpy(zero_copy_only=False)
            if marked.any():
                text, stays = columns[where].to_pylist(), ~marked
                for i in np.flatnonzero(marked):
                    raw, pieces, at = text[i].encode("utf-8"), [], 0
                    for s in batch.column(mark)[i].as_py():
                        pieces.append(raw[at: s["start"]])
                        at = max(at, s["start"] + s["length"])
                    text[i] = b"".join([*pieces, raw[at:]]).decode("utf-8")
                    stays[i] = bool(text[i].strip())
                columns[where] = pa.array(text, columns[where].type)
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays))
            else:
                yield pa.RecordBatch.from_arrays(columns, names)

    same = F.col(id_col).eqNullSafe(F.col(f"{mark}_id")) & (F.col(f"{mark}_k") == F.col(f"{mark}_key"))
    return map_arrow(docs.join(per_doc, same, "left").select(*names, mark), run, docs.select(*names).schema)
