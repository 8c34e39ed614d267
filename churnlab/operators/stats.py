"""Column profiles and statistics (survey C16, C18, A10, A33-A37).

Moments are one global ``agg`` over all requested columns (partial aggregation
per task, a single small final merge), unpivoted to long form. Quartiles are
exact (``ranking.exact_percentiles``); ``approx=True`` takes sketches instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from churnlab.operators.clean import LEAKAGE_COLUMNS
from churnlab.operators.ranking import exact_percentiles


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns by schema (plan-time)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def describe(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, std (sample), min, 25%, 50%, 75%, max per numeric column.
    Moments come from one aggregate; quartiles from the exact percentiles
    (or a bounded sketch with ``approx``)."""
    cols = list(columns or numeric_columns(df))
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"), F.stddev_samp(x).alias(f"{c}|std"),
                 F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
    moments = ["count", "mean", "std", "min", "max"]
    rows = ", ".join(f"'{c}', " + ", ".join(f"cast(`{c}|{m}` as double)" for m in moments) for c in cols)
    mom = df.agg(*aggs).selectExpr(f"stack({len(cols)}, {rows}) as (`column`, {', '.join(moments)})")
    qs = quartiles(df, cols, [0.25, 0.5, 0.75], approx).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    out = mom.join(qs, "column", "left")
    # Quartiles interpolate between values; 9 places keeps them off the rounding edge.
    return out.select("column", F.col("count").cast("long").alias("count"), F.round("mean", 6).alias("mean"),
                      F.round("std", 6).alias("std"), F.round("min", 9).alias("min"), F.round("p25", 9).alias("p25"),
                      F.round("p50", 9).alias("p50"), F.round("p75", 9).alias("p75"), F.round("max", 9).alias("max"))


def quartiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], approx: bool = False,
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Long (group..., column, n, q0..) percentiles: exact (default), or
    ``percentile_approx`` sketches on request."""
    if not approx:
        return exact_percentiles(df, cols, probs, group_cols)
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(*group_cols, kv.alias("kv")).select(*group_cols, "kv.column", "kv.v").where(F.col("v").isNotNull())
    agg = long.groupBy(*group_cols, "column").agg(F.count(F.lit(1)).alias("n"),
                                                  F.percentile_approx("v", list(probs), 10000).alias("_q"))
    return agg.select(*group_cols, "column", "n", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])


def info(df: DataFrame) -> DataFrame:
    """Column, position, dtype, non-null count."""
    fields = df.schema.fields
    wide = df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in fields])
    rows = ", ".join(f"'{f.name}', {i}, '{f.dataType.simpleString()}', `{f.name}`" for i, f in enumerate(fields))
    return wide.selectExpr(f"stack({len(fields)}, {rows}) as (`column`, position, dtype, non_null)")


def box_stats(df: DataFrame, value: str, keys: Sequence[str], approx: bool = False) -> DataFrame:
    """A10: quartiles, 1.5 IQR whiskers (most extreme data inside the fences) and
    outlier count per group. Exact quartiles per group, then one aggregate over the data joined to its group's row (one per group)."""
    base = df.where(F.col(value).isNotNull())
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    q = quartiles(base, [value], [0.25, 0.5, 0.75], approx, keys).select(
        *keys, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi = F.col("q3") + F.lit(1.5) * F.col("iqr")
    v = F.col(value)
    w = base.join(q, list(keys)).groupBy(*keys).agg(
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.count_if((v < lo) | (v > hi)).alias("outliers"))
    return q.join(w, list(keys)).select(
        *keys, "n", *[F.round(c, 9).alias(c) for c in ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"]],
        "outliers")


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column, count of values outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR].
    Exact quartiles first, then one aggregate of conditional counts next to the
    one-row table of all fences."""
    cols = list(columns or numeric_columns(df))
    q = quartiles(df, cols, [0.25, 0.75], approx)
    fences = q.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col(k))).alias(f"_{k}_{n}")
                               for n, c in enumerate(cols) for k in ("q0", "q1")])  # one row
    aggs = []
    for n, c in enumerate(cols):
        x, q1, q3 = F.col(c).cast("double"), F.col(f"_q0_{n}"), F.col(f"_q1_{n}")
        iqr = q3 - q1
        aggs.append(F.count_if((x < q1 - F.lit(1.5) * iqr) | (x > q3 + F.lit(1.5) * iqr)).alias(f"_o{n}"))
    wide = df.select(*cols).crossJoin(F.broadcast(fences)).agg(*aggs)
    rows = ", ".join(f"'{c}', _o{n}" for n, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {rows}) as (`column`, outliers)")


def _gram_partials(cols: Sequence[str], means: Sequence[float]):
    """Per-partition sums for pairwise-complete Pearson r, via numpy matrix
    products: with X the centred values (missing -> 0) and M the presence mask,
    N = M'M (pair counts), S = X'M (sum of x_i where x_j present),
    Q = (X*X)'M (sum of x_i^2 where x_j present), P = X'X (sum of x_i x_j).
    The transposes of S and Q are the same sums for x_j."""
    import numpy as np
    import pandas as pd

    mu = np.asarray(means, dtype="float64")

    def fn(batches):
        d = len(cols)
        n = np.zeros((d, d)); sx = np.zeros((d, d)); sq = np.zeros((d, d)); sp = np.zeros((d, d))
        for pdf in batches:
            x = pdf[list(cols)].to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(x)
            x = np.where(m, x - mu, 0.0)
            mf = m.astype("float64")
            n += mf.T @ mf
            sx += x.T @ mf
            sq += (x * x).T @ mf
            sp += x.T @ x
        cells = {"n": n, "sx": sx, "sy": sx.T, "sxx": sq, "syy": sq.T, "sxy": sp}
        yield pd.DataFrame({k: [v.ravel()] for k, v in cells.items()})
    return fn


MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlation_long(df: DataFrame, columns: Sequence[str] | None = None, include_diagonal: bool = False) -> DataFrame:
    """Pearson r for every column pair (i < j), pairwise-complete like pandas.

    One Python scan: each task folds its rows into d x d moment matrices with
    numpy (Arrow batches), so work per row is O(d^2) vectorized; the per-task
    matrices (size fixed by the column count, not the data) are summed by cell
    in a small aggregate and turned into r there. Values are centred by the
    column means (a one-row aggregate, run first) to keep the sums well
    conditioned. Pairs without two common rows or without variance give null."""
    cols = list(columns or numeric_columns(df))
    d = len(cols)
    mean_row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    means = [float(mean_row[c]) if mean_row[c] is not None else 0.0 for c in cols]
    src = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    parts = src.mapInPandas(_gram_partials(cols, means), ", ".join(f"{m} array<double>" for m in MOMENTS))
    cells = (parts.select(F.posexplode(F.arrays_zip(*MOMENTS)).alias("pos", "v"))
                  .groupBy("pos").agg(*[F.sum(f"v.{m}").alias(m) for m in MOMENTS]))
    i, j = (F.col("pos") / d).cast("int"), (F.col("pos") % d).cast("int")
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in MOMENTS)
    r = F.try_divide(sxy - sx * sy / n, F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)))
    names = F.array(*[F.lit(c) for c in cols])
    return cells.where((i <= j) if include_diagonal else (i < j)).select(
        F.element_at(names, i + 1).alias("col_i"), F.element_at(names, j + 1).alias("col_j"),
        F.round(F.when((n > 1) & ~F.isnan(r), r), 6).alias("r"))


def strong_pairs(corr: DataFrame, min_abs: float = 0.6) -> DataFrame:
    """Upper-triangle pairs with |r| >= min_abs, strongest first."""
    return corr.where(F.abs("r") >= min_abs).orderBy(F.abs("r").desc(), "col_i", "col_j")


def label_correlations(df: DataFrame, label: str = "churn_flag", exclude: Sequence[str] = ()) -> DataFrame:
    """Correlation of each numeric column with the label (same one-scan moments)."""
    cols = [c for c in numeric_columns(df, exclude) if c != label]
    long = correlation_long(df, cols + [label])
    return long.where(F.col("col_j") == label).select(F.col("col_i").alias("feature"), "r")


def strong_label_correlations(df: DataFrame, label: str = "churn_flag", min_abs: float = 0.6,
                              fallback_top: int = 5) -> DataFrame:
    """Features with |r| >= min_abs; when none, the top ``fallback_top`` by r
    (descending, as the reference sorts the signed series)."""
    lc = label_correlations(df, label).where(F.col("r").isNotNull())  # one row per column
    every = Window.partitionBy(F.lit(0))
    ranked = lc.select("feature", "r", F.count_if(F.abs("r") >= min_abs).over(every).alias("_n"),
                       F.row_number().over(every.orderBy(F.col("r").desc(), "feature")).alias("_rk"))
    strong = F.abs("r") >= min_abs
    return ranked.where(F.when(F.col("_n") > 0, strong).otherwise(F.col("_rk") <= fallback_top)).select(
        "feature", "r", F.when(F.col("_n") > 0, "strong").otherwise("top").alias("kind"))


def top_label_correlations(df: DataFrame, label: str = "churn_flag", k: int = 2) -> DataFrame:
    """The k features with the largest |r| with the label (leakage columns dropped)."""
    lc = label_correlations(df.drop(*[c for c in LEAKAGE_COLUMNS if c in df.columns]), label)
    return lc.where(F.col("r").isNotNull()).orderBy(F.abs("r").desc(), "feature").limit(k)
