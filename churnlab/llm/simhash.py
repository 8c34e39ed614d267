"""SimHash near-duplicate detection by pigeonhole blocks.

1. Fingerprints: numpy inside the scan tasks (XXH64 per shingle, then bit
   counts kept in byte lanes).
2. Equal fingerprints collapse to one row by a partial aggregate, so a group of
   exact copies of any size is one row from here on.
3. A fingerprint is cut into ``2 * max_bits`` blocks. Two fingerprints that
   differ in at most ``max_bits`` bits agree on at least ``max_bits`` whole
   blocks, so they meet under the key of one combination of blocks (32 of 64
   bits for the production setting). Keys held by one fingerprint drop out.
4. Keys with up to ``SMALL`` fingerprints are verified by Hamming distance in
   one list. The fingerprints of larger keys go once more through twice as many
   blocks: those keys fix so many bits that at most 2**18 different
   fingerprints can share one, and inside it neighbours are found by flipping
   bits. Every pair is verified, no list is unbounded and nothing is dropped.
5. A task returns a spanning forest of each list, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from churnlab.llm.common import map_arrow, materialize, slices, texts
from churnlab.llm.components import component_roots

#: Fingerprints that one key may hold before it is cut into finer keys.
SMALL = 256
SEED = 42
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words_per_shingle: int = 3) -> np.ndarray:
    """XXH64 of the shingles of one text, repeats included (empty array without words)."""
    words = text.encode("utf-8").lower().split()  # bytes.lower touches A-Z only; bytes.split cuts at 0x20, 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[len(words) - n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64, n)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per row: bit set where over half of the row's hashes set it.

    ``hashes`` holds the rows one after the other, ``counts`` their sizes; a row
    without hashes gets 0. Eight bits are counted at a time in the byte lanes of
    one word, in runs of at most 255 hashes.
    """
    counts = np.asarray(counts, np.int64)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begin = (np.cumsum(counts) - counts)[full]
    runs = -(-counts[full] // 255)
    row = np.repeat(np.arange(len(full)), runs)
    run_of_row = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    cut = begin[row] + 255 * run_of_row
    row_begin = np.cumsum(runs) - runs
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cut)
        bits = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)  # little-endian: byte j counts bit 8j+k
        total = np.add.reduceat(bits, row_begin, axis=0)
        over = total * 2 > counts[full][:, None]
        for j in range(8):
            out[full] |= over[:, j].astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_per_shingle: int = 3) -> DataFrame:
    """(id, fingerprint as signed long) of every row."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [shingle_hashes(t, words_per_shingle) for t in texts(part.column("text"))]
                prints = majority_bits(np.concatenate(rows), np.array([len(r) for r in rows]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints.view(np.int64))], ["id", "fingerprint"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("id", kind), StructField("fingerprint", LongType())])
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def block_masks(blocks: int, max_bits: int, bits: int = 64) -> list[int]:
    """Bit masks of every way to keep ``blocks - max_bits`` of the blocks."""
    edge = [bits * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(kept) for kept in combinations(block, blocks - max_bits)]


def _keyed(prints: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    masks = block_masks(blocks, max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v"))
                     for i, m in enumerate(signed)])
    return prints.select("fp", F.explode(keys).alias("k")).select("k.c", "k.v", "fp")


def forest(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (member, smallest member) of each group of fingerprints connected at ``max_bits`` within one list."""
    prints = np.unique(prints)
    n, out = len(prints), []
    if n == 2:
        a, b = prints.tolist()
        return [(b, a)] if (a ^ b).bit_count() <= max_bits else []
    flips = None
    if n > 2048:  # few free bits: look neighbours up by flipping them
        free = np.bitwise_or.reduce(prints ^ prints[0])
        singles = [1 << i for i in range(64) if int(free) >> i & 1]
        flips = np.array([sum(c) for r in range(1, max_bits + 1) for c in combinations(singles, r)], np.uint64)
        if len(flips) > n:
            flips = None
    todo = np.ones(n, bool)
    for i in range(n):
        if not todo[i]:
            continue
        todo[i], front = False, [i]
        while front:
            at = front.pop()
            if flips is None:
                left = np.flatnonzero(todo)
                if not len(left):
                    break
                near = left[np.bitwise_count(prints[left] ^ prints[at]) <= max_bits]
            else:
                want = prints[at] ^ flips
                place = np.minimum(np.searchsorted(prints, want), n - 1)
                near = place[(prints[place] == want) & todo[place]]
            todo[near] = False
            front += near.tolist()
            out += [(int(prints[j]), int(prints[i])) for j in near]
    return out


def _list_links(lists: DataFrame, max_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            at = column.offsets.to_numpy().astype(np.int64)
            prints = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            links = [x for a, b in zip(at, at[1:]) for x in forest(prints[a:b], max_bits)]
            pair = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return map_arrow(lists, run, "a long, b long")


def fingerprint_links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b) links that connect the distinct longs of column ``fp`` exactly as all pairs within ``max_bits`` do."""
    if max_bits < 1:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    keyed = _keyed(prints, 2 * max_bits, max_bits)
    shared = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    held = materialize(keyed.join(shared, ["c", "v"]))
    small = held.where(F.col("n") <= SMALL).groupBy("c", "v").agg(F.collect_list("fp").alias("fps")).select("fps")
    dense = held.where(F.col("n") > SMALL).select("fp").distinct()
    fine = (_keyed(dense, 4 * max_bits, max_bits).groupBy("c", "v").agg(F.collect_list("fp").alias("fps"))
            .where(F.size("fps") > 1).select("fps"))
    return _list_links(small, max_bits).unionByName(_list_links(fine, max_bits)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """One row per document: id, ``fingerprint`` (long) and ``component_id``, the smallest id reachable by links.

    Fingerprints within ``max_bits`` differing bits are linked. Null and empty
    texts have fingerprint 0 and are linked like any other; a null id takes part
    but never names a component unless all its members have none; repeated rows
    are returned as often as given; an empty table gives no rows; other columns
    are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words_per_shingle))
    distinct = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least"))
    roots = component_roots(fingerprint_links(distinct.select("fp"), max_bits))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return prints.join(classes, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def fingerprint_hex(column) -> F.Column:
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
