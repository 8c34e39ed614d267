"""Mixing of sources to target weights by a time-varying curriculum.

Training time runs from 0 to 1. A source has a weight over that time, piecewise
linear between knots: its class weight times the shape of its class. The
integral over the whole time is the source's share of all words; a share that
would repeat a source more often than allowed stops there, and the excess is
shared among the rest by weight.

1. Words are counted inside the scan tasks; from there on a document is a row of
   a few numbers, and texts join again only where an ordered corpus is wanted.
2. Documents are range-sorted by source and a hash of the id, and a running sum
   gives each its place among the words of its source. A source that holds a
   third of all rows is many ranges; the sums of the ranges are one row each.
3. The mix takes the words of a source from the beginning up to its target, and
   once more from the beginning where the target is larger than the source. The
   last document of the last round may be taken in part.
4. A word that lies at a fraction u of its source's target is due when the
   integral of the source's weight reaches u of its whole: the integral is
   quadratic between knots and is inverted in closed form. That gives each copy
   of a document its training position, and the corpus is range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from churnlab.llm.common import map_arrow, materialize, slices, utf8
from churnlab.operators.ranking import global_row_number

#: Class weights, dealt to the sources in order, and how often a source may be repeated.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Shape of each class's weight over training time, as (time, factor): the heavy sources come early, the light ones late.
SHAPES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))

Shape = Sequence[tuple[float, float]]


def word_counts(column: pa.Array) -> np.ndarray:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return in each row."""
    raw, at = utf8(column)
    inside = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    opens[first] = inside[first]  # the text before doesn't matter
    total = np.concatenate(([0], np.cumsum(opens)))
    return total[at[1:]] - total[at[:-1]]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, digest) of every row; a null text has size 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("source"), pa.array(word_counts(part.column("text"))), part.column("digest")],
                    ["id", "source", "size", "digest"])

    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("source", docs.schema[source_col].dataType)]) \
        .add("size", "long").add("digest", "long")
    given = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    return map_arrow(given, run, schema)


def laid_out(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``start``: the words of the source's documents before this one, in the order of a hash of the id.

    Rows that repeat an id are ordered by size and text; equal rows are interchangeable.
    """
    order = [F.col("source").asc_nulls_last(), F.md5(F.col("id").cast("string")).asc_nulls_last(), F.col("id").asc_nulls_last(), F.col("size"), F.col("digest")]
    ranged = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, held = None, 0  # the source at the end of the last batch and its words in this range so far
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            code = batch.column("source").dictionary_encode(null_encoding="encode")
            turn = np.flatnonzero(np.diff(code.indices.to_numpy(), prepend=-1))
            before = np.cumsum(size) - size
            base = before[turn]
            if batch.column("source")[0].as_py() == source:
                base[0] -= held
            local = before - np.repeat(base, np.diff(turn, append=len(size)))
            source, held = batch.column("source")[-1].as_py(), int(local[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], [*batch.schema.names, "local"])

    placed = materialize(map_arrow(ranged, run, StructType([*ranged.schema.fields]).add("local", "long")))
    ranges = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = ranges.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    return placed.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select(
        "id", "source", "size", "digest", (F.col("before") + F.col("local")).alias("start"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """(source, source_size, class, target) from (source, source_size).

    Sources in order of code points, null last, get the weights in turn. They share ``share`` of all words by weight; a
    target stops at ``repeats`` times its source, and the excess is shared again by weight until none is above. The
    sources stay a table: a round of sharing brings two sums to the driver.
    """
    numbered = global_row_number(sources, [F.col("source").asc_nulls_last()], "number")
    kind = ((F.col("number") - 1) % len(weights)).cast("int")
    held = materialize(numbered.select("source", "source_size", kind.alias("class"),
                                       F.element_at(F.array(*[F.lit(w) for w in weights]), kind + 1).alias("weight"),
                                       (F.col("source_size") * repeats).alias("most")))
    whole = (held.agg(F.sum("source_size")).first()[0] or 0) * share
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("most") <= F.col("weight") * level
        weight, used = held.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("most")))).first()
        found = (whole - (used or 0)) / weight if weight else None
        if found is None or level is not None and found <= level:
            break
        level = found
    level = float("inf") if level is None else level
    target = F.when(F.col("most") <= F.col("weight") * F.lit(level), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return held.select("source", "source_size", "class", target.alias("target"))


def due(share: Column, shape: Shape) -> Column:
    """The time at which the integral of a piecewise linear weight reaches ``share`` of its whole."""
    steps = [(t0, w0, t1 - t0, w1 - w0) for (t0, w0), (t1, w1) in zip(shape, shape[1:])]
    areas = [h * (w0 + rise / 2) for _, w0, h, rise in steps]
    reached = [0.0, *accumulate(areas)]
    area = share * reached[-1]
    out = F.lit(shape[-1][0])
    for (t0, w0, h, rise), low, high in reversed(list(zip(steps, reached, reached[1:]))):
        rest = area - low  # rest = w0 * x + rise / h * x**2 / 2
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * rise / h * rest)) + w0
        out = F.when(area < high, F.lit(t0) + F.coalesce(F.try_divide(2 * rest, root), F.lit(0.0))).otherwise(out)
    return out


def check_shapes(shapes: Sequence[Shape], weights: Sequence[int]) -> None:
    """A shape per weight, over the whole time, never negative; raises ValueError."""
    for shape in shapes:
        times = [t for t, _ in shape]
        if times != sorted(set(times)) or times[:1] != [0.0] or times[-1] != 1.0 or min(w for _, w in shape) < 0 or not any(w for _, w in shape):
            raise ValueError(f"a weight over time needs rising times from 0 to 1 and factors of which none is negative: {shape}")
    if len(shapes) != len(weights):
        raise ValueError("a shape is needed for each weight")


def assign(docs: DataFrame, weights: Sequence[int] = WEIGHTS, shapes: Sequence[Shape] = SHAPES, repeats: int = REPEATS, share: float = 1.0,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, digest (xxhash64 of the text), size, source_size, target, taken, copies.

    ``copies`` is an array of (copy, words, position): the mix takes the first ``words`` words at training time
    ``position``; ``taken`` is their sum. A source's taken words are its target rounded to whole words. Null and empty
    texts have size 0 and no copies; documents without a source are a source of their own, the last one; rows without an
    id come last in their source; rows that repeat an id are documents of their own; an empty table gives no rows; other
    columns are ignored.
    """
    check_shapes(shapes, weights)
    placed = laid_out(materialize(sized(docs, id_col, text_col, source_col)))
    goal = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats, share).withColumnRenamed("source", "s")
    row = placed.join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("budget", F.floor(F.col("target") + 0.5))

    def copy(i: int) -> Column:
        at = F.col("start") + F.col("source_size") * i
        words = F.least(F.col("size"), F.col("budget") - at)
        share_of = F.try_divide(at.cast("double"), F.col("target"))
        position = F.lit(0.0)
        for number, shape in enumerate(shapes):
            position = F.when(F.col("class") == number, due(share_of, shape)).otherwise(position)
        return F.when(words > 0, F.struct(F.lit(i).alias("copy"), words.alias("words"), position.alias("position")))

    copies = F.filter(F.array(*[copy(i) for i in range(repeats)]), lambda c: c.isNotNull())
    out = row.withColumn("copies", copies).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda held, c: held + c["words"]))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "digest", "size", "source_size", "target", "taken", "copies")


def in_order(assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per copy that the mix takes, range-sorted by training position: id, digest, copy, words, position."""
    one = assigned.select(id_col, "digest", F.explode("copies").alias("c")).select(id_col, "digest", "c.*")
    order = ["position", id_col, "digest", "copy"]
    return one.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_corpus(docs: DataFrame, assigned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts in training order: id, text, position, and words where only the first words of a text count. The
    partitions are consecutive: write them as files and read these in order."""
    copies = assigned.select(F.col(id_col).alias("i"), F.col("digest").alias("d"), F.col("size"), F.explode("copies").alias("c")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own"))
    both = rows.join(copies, F.col("id").eqNullSafe(F.col("i")) & (F.col("own") == F.col("d")))
    order = ["position", "id", "own"]
    out = both.select("id", "text", "own", F.col("c.position").alias("position"), F.col("c.words").alias("words"))
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "position", "words")
