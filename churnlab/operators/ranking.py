"""Global ordering helpers that never funnel a whole table into one task.

An un-partitioned ``Window`` (``row_number() over (order by ...)``) moves every
row into a single partition. These helpers instead range-partition on the full
sort key (a unique tie-breaker keeps one hot value from piling into a single
range), number rows inside each partition, and add per-partition offsets. The
offset table has one row per partition, so its size is bounded by the partition
count, never by the data; broadcasting it is safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.session import cut_lineage, materialize

_PID = "_rk_pid"
_MID = "_rk_mid"


def _as_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ranged(df: DataFrame, order: Sequence[str | Column], num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``order``, sort inside partitions, tag partition id and
    in-partition position, then checkpoint so later passes see identical ids."""
    cols = _as_cols(order)
    # Without an explicit count the range exchange uses the session's shuffle
    # partitions and AQE may merge adjacent (small) ranges; merged ranges stay
    # contiguous, and the sort and ids below apply to the merged partitions.
    parted = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    out = (parted
             .sortWithinPartitions(*cols)
             .withColumn(_PID, F.spark_partition_id())
             .withColumn(_MID, F.monotonically_increasing_id()))
    return cut_lineage(out)


def _offsets(stats: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """Exclusive running totals over a per-partition table (one row per partition)."""
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return stats.select(
        _PID, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_off_{c}") for c in value_cols],
        *[c for c in stats.columns if c not in (_PID, *value_cols)])


def global_row_number(df: DataFrame, order: Sequence[str | Column], out_col: str = "row_num",
                      num_partitions: int | None = None) -> DataFrame:
    """Dense 1..n numbering in ``order``. Order must be total (add a unique key)."""
    r = ranged(df, order, num_partitions)
    stats = r.groupBy(_PID).agg(F.count(F.lit(1)).alias("_n"), F.min(_MID).alias("_m0"))
    offs = _offsets(stats, ["_n"])
    return (r.join(F.broadcast(offs), _PID)
             .withColumn(out_col, F.col("_off__n") + (F.col(_MID) - F.col("_m0")) + F.lit(1))
             .drop(_PID, _MID, "_off__n", "_m0"))


def prefix_sums(df: DataFrame, order: Sequence[str | Column], sum_cols: Sequence[str],
                prefix: str = "cum_", inclusive: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` in ``order`` (inclusive or exclusive of the row).

    Local sums run per range partition (partitioned window on the partition id,
    balanced by construction), then the partition totals are offset-added.
    """
    cols = _as_cols(order)
    r = ranged(df, cols, num_partitions)
    frame_end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(_PID).orderBy(F.col(_MID)).rowsBetween(Window.unboundedPreceding, frame_end)
    local = r.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_loc_{c}") for c in sum_cols])
    stats = r.groupBy(_PID).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sum_cols])
    offs = _offsets(stats, list(sum_cols))
    out = local.join(F.broadcast(offs), _PID, "left")
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.col(f"_loc_{c}"))
    drop = [_PID, _MID] + [f"_loc_{c}" for c in sum_cols] + [f"_off_{c}" for c in sum_cols]
    return out.drop(*drop)


def previous_in_group(df: DataFrame, group_col: str, order: Sequence[str], value_cols: Sequence[str],
                      prefix: str = "prev_", num_partitions: int | None = None) -> DataFrame:
    """``lag(value) over (partition by group order by ...)`` without clustering a
    group into one task. Rows are range-partitioned on (group, order), so a group
    holding a third of the table is spread over many ranges; lag is computed
    inside each (range, group) slice and carried across range boundaries from a
    one-row-per-partition table. Null keys form one group, as in SQL."""
    r = ranged(df, [group_col, *order], num_partitions)
    # Inside a range partition a group's rows are contiguous and sorted: a window
    # over (partition, group) gives lag for every row but the first of each
    # slice. The hash exchange on (partition id, group) stays balanced because
    # the partition id already splits a hot group.
    w = Window.partitionBy(_PID, group_col).orderBy(_MID)
    local = r.select("*", F.row_number().over(w).alias("_slice_rn"),
                     *[F.lag(v).over(w).alias(f"_lag_{v}") for v in value_cols])
    # Only a partition's first slice can continue a group from an earlier
    # partition: take the last row of the nearest earlier non-empty partition
    # (one row per partition, so this table is bounded by the partition count).
    last = r.groupBy(_PID).agg(F.max_by(F.struct(F.col(group_col).alias("g"), *[F.col(v) for v in value_cols]),
                                         F.col(_MID)).alias("_last"), F.min(_MID).alias("_pmin"))
    bounds = last.select(_PID, "_pmin", F.lag("_last").over(Window.orderBy(_PID)).alias("_prev"))
    joined = local.join(F.broadcast(bounds), _PID)
    carry = ((F.col("_slice_rn") == 1) & (F.col(_MID) == F.col("_pmin"))
             & F.col("_prev.g").eqNullSafe(F.col(group_col)))
    return joined.select(*df.columns, *[
        F.when(F.col("_slice_rn") > 1, F.col(f"_lag_{v}")).when(carry, F.col(f"_prev.{v}")).alias(f"{prefix}{v}")
        for v in value_cols])


def rank_within_groups(df: DataFrame, group_col: str, order: Sequence[str | Column],
                       out_col: str = "rank_in_group", num_partitions: int | None = None,
                       count_col: str | None = None, count_if: Column | None = None) -> DataFrame:
    """1..n_g numbering inside each group, balanced even when a group is huge.

    Range-partitions on (group, order) so a group spans as many tasks as its size
    needs. The per-(partition, group) stats table has at most
    ``partitions + groups`` rows; a window over it (partitioned by group, each
    group holding at most one row per partition) turns it into the offset of
    every (partition, group) slice. Optionally also attaches the group's count of
    rows meeting ``count_if`` as ``count_col`` (e.g. candidates per scenario).
    """
    r = ranged(df, [F.col(group_col), *_as_cols(order)], num_partitions)
    extra = [F.count_if(count_if).alias("_cnt")] if count_if is not None else []
    stats = r.groupBy(_PID, group_col).agg(F.count(F.lit(1)).alias("_n"), F.min(_MID).alias("_m0"), *extra)
    w = Window.partitionBy(group_col).orderBy(_PID)
    offs = stats.select(
        _PID, group_col, "_m0",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        *([F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
           .alias(count_col)] if count_if is not None else []))
    # Null-safe on the group: rows without one are a group of their own, as in SQL.
    slices = offs.select(F.col(_PID).alias("_spid"), F.col(group_col).alias("_sgroup"), "_m0", "_off",
                         *([count_col] if count_if is not None else []))
    out = (r.join(slices, (F.col(_PID) == F.col("_spid")) & F.col(group_col).eqNullSafe(F.col("_sgroup")))
             .drop("_spid", "_sgroup").withColumn(out_col, F.col("_off") + (F.col(_MID) - F.col("_m0")) + F.lit(1))
             .drop(_PID, _MID, "_m0", "_off"))
    return out


#: Ranks of the percentile sketch are off by at most n / SKETCH; groups below SMALL_GROUP rows are taken whole.
SKETCH, SMALL_GROUP = 2000, 4000


def exact_percentiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated percentiles (``percentile`` semantics: position
    ``p * (n - 1)``) without sorting the data or holding a group's values in one buffer.

    Scan 1 sketches every (group, column) and asks for the values two sketch errors below and above every position, a
    bracket that is sure to hold both neighbouring ranks. The brackets (one row per group and column) are written, so
    Spark knows their size when it joins them. Scan 2 counts the rows below each bracket and the distinct values inside
    (about 0.2% of the rows; equal values combine map-side), and the ranks are picked from these counts. Values are
    unpivoted inside the tasks; only counts are shuffled. Nulls are skipped; rows whose group key is null are dropped.
    Output: one row per (group..., column) with ``q0, q1, ...`` for ``probs`` in order, and ``n``.
    """
    keys = [f"_g{i}" for i in range(len(group_cols))]
    by = [*keys, "j"]
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(columns)]))
    long = df.select(*[F.col(g).alias(k) for g, k in zip(group_cols, keys)], cells.alias("s")).select(*keys, "s.*")
    for k in [*keys, "v"]:
        long = long.where(F.col(k).isNotNull())
    edges = [min(1.0, max(0.0, p + side * 2 / SKETCH)) for p in probs for side in (-1, 1)]
    sketch = long.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"),
                                   F.percentile_approx("v", edges, SKETCH).alias("e"))
    whole, spots = F.col("n") < SMALL_GROUP, range(len(probs))
    brackets = materialize(sketch.select(
        *by, "n", F.array(*[F.when(whole, F.col("least")).otherwise(F.col("e")[2 * i]) for i in spots]).alias("lo"),
        F.array(*[F.when(whole, F.col("most")).otherwise(F.col("e")[2 * i + 1]) for i in spots]).alias("hi")))

    # A group taken whole has one bracket for all its positions, kept under position 0. Rows below a bracket count under null.
    v, near = F.col("v"), []
    for i in spots:
        own = v <= F.col("hi")[i] if i == 0 else (v <= F.col("hi")[i]) & ~whole
        near.append(F.when(own, F.struct(F.lit(i).alias("kept"), F.when(v >= F.col("lo")[i], v).alias("v"))))
    values = (long.join(brackets, by).select(*by, F.explode(F.filter(F.array(*near), lambda x: x.isNotNull())).alias("s"))
              .groupBy(*by, "s.kept", "s.v").agg(F.count("*").alias("c")))
    upto = Window.partitionBy(*by, "kept").orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("last", F.sum("c").over(upto)).where(F.col("v").isNotNull())

    position = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    wanted = brackets.select(*by, "n", position.alias("s")).select(
        *by, "n", "s.i", F.when(whole, 0).otherwise(F.col("s.i")).alias("kept"), (F.col("s.p") * (F.col("n") - 1)).alias("pos"))
    at = lambda rank: F.max(F.when(rank.between(F.col("last") - F.col("c") + 1, F.col("last")), F.col("v")))
    picked = wanted.join(ranked, [*by, "kept"]).groupBy(*by, "i").agg(
        F.first("n").alias("n"), F.first(F.col("pos") - F.floor("pos")).alias("part"),
        at(F.floor("pos") + 1).alias("a"), at(F.ceil("pos") + 1).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    wide = picked.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("i") == i, value)).alias(f"q{i}") for i in spots])
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("j") + 1)
    return wide.select(*[F.col(k).alias(g) for g, k in zip(group_cols, keys)], name.alias("column"),
                       F.col("n").cast("long").alias("n"), *[f"q{i}" for i in spots])
