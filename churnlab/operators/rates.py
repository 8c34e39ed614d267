"""Churn-rate breakdowns (survey A1-A32, A38, A39).

``rate`` is a single ``groupBy().agg()``: Spark plans it as partial (map-side)
plus final hash aggregation, so even a key that holds a third of the rows is
combined inside every map task before the shuffle; only one row per key and
task crosses the network. Outputs are small (one row per key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.functions import features as fx

LABEL = "churn_flag"


def _cols(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def rate(df: DataFrame, keys: Sequence[str | Column], label: str = LABEL, digits: int = 6) -> DataFrame:
    """customers, churned, churn_rate per key combination; rows with a null key
    are dropped first (pandas ``groupby`` default, S3)."""
    kc = _cols(keys)
    names = [df.select(k).columns[0] for k in kc]
    keyed = df.select(*kc, F.col(label).alias("_y"))
    for n in names:
        keyed = keyed.where(F.col(n).isNotNull())
    return keyed.groupBy(*names).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("_y").cast("long").alias("churned"),
        F.round(F.avg("_y"), digits).alias("churn_rate"),
    )


def with_percent(df: DataFrame, rate_col: str = "churn_rate", out: str = "churn_rate_pct") -> DataFrame:
    """``round(rate * 100, 2)``."""
    return df.withColumn(out, F.round(F.col(rate_col) * 100, 2))


def rate_with_levels(df: DataFrame, key: str | Column, levels: Sequence, label: str = LABEL,
                     order_col: str = "level_order") -> DataFrame:
    """Rate per level, every level present (``observed=False``, S5): the fixed
    level list (plan-time literal, size known) LEFT JOINs the aggregate."""
    agg = rate(df, [key], label)
    name = agg.columns[0]
    spark = df.sparkSession
    lv = spark.createDataFrame([(v, i) for i, v in enumerate(levels)], [name, order_col])
    lv = lv.withColumn(name, F.col(name).cast(agg.schema[name].dataType))
    return (F.broadcast(lv).join(agg, name, "left")
            .select(name, order_col,
                    F.coalesce("customers", F.lit(0)).cast("long").alias("customers"),
                    F.coalesce("churned", F.lit(0)).cast("long").alias("churned"),
                    "churn_rate"))


def rate_by_premium_increase(df: DataFrame) -> DataFrame:
    """A1: ordered label (No increase < Increase) with percent column."""
    out = rate(df, [fx.premium_increased_label().alias("premium_increased_label")])
    out = out.withColumn("label_order", F.when(F.col("premium_increased_label") == "Increase", 1).otherwise(0))
    return with_percent(out)


def rate_by_premium_change_bin(df: DataFrame) -> DataFrame:
    """A2: the four right-closed bins, empty ones kept."""
    keyed = df.withColumn("premium_change_bin", fx.premium_change_bin())
    return rate_with_levels(keyed, "premium_change_bin", fx.PREMIUM_CHANGE_BINS)


def pivot_rate(df: DataFrame, row_key: str, col_key: str, values: Sequence, label: str = LABEL,
               scale: float = 1.0, digits: int = 6) -> DataFrame:
    """``pivot_table(aggfunc='mean')`` with the column values given
    up front, so Spark skips the extra distinct-values job."""
    p = (df.where(F.col(row_key).isNotNull() & F.col(col_key).isNotNull())
           .groupBy(row_key).pivot(col_key, list(values)).agg(F.avg(label)))
    return p.select(row_key, *[F.round(F.col(str(v)) * scale, digits).alias(str(v)) for v in values])


def stacked_rates(df: DataFrame, sections: Sequence[tuple[str, Sequence[Column]]], label: str = LABEL) -> DataFrame:
    """The rate tables of several sections as one long table (section, group_key), from one scan: every row
    yields its key of each section, and the counts combine map-side. A key with a null part drops out of its section."""
    made = []
    for section, keys in sections:
        known = F.lit(True)
        for k in keys:
            known = known & k.isNotNull()
        key = F.when(known, F.concat_ws(" / ", *[k.cast("string") for k in keys]))
        made.append(F.struct(F.lit(section).alias("section"), key.alias("group_key")))
    long = df.select(F.explode(F.array(*made)).alias("s"), F.col(label).alias("_y")).where(F.col("s.group_key").isNotNull())
    return long.groupBy("s.section", "s.group_key").agg(
        F.count("*").alias("customers"), F.sum("_y").cast("long").alias("churned"), F.round(F.avg("_y"), 6).alias("churn_rate"))


def tenure_window_rates(df: DataFrame) -> DataFrame:
    """Overlapping tenure groups in one pass (conditional averages)."""
    t = F.col("customer_tenure_months")
    y = F.col(LABEL)
    return df.agg(
        F.count_if(t <= 6).alias("customers_le6"),
        F.round(F.avg(F.when(t <= 6, y)), 6).alias("rate_le6"),
        F.count_if(t <= 12).alias("customers_le12"),
        F.round(F.avg(F.when(t <= 12, y)), 6).alias("rate_le12"),
        F.count_if(t > 12).alias("customers_gt12"),
        F.round(F.avg(F.when(t > 12, y)), 6).alias("rate_gt12"),
    )


def multi_group_vs_overall(df: DataFrame) -> DataFrame:
    """Rate per multi-policy group next to the whole-table mean (a one-row
    aggregate, cross-joined by broadcast: its size is one row by construction)."""
    overall = df.agg(F.round(F.avg(LABEL), 6).alias("overall_rate"))
    groups = rate(df.where(F.col("multi_policy_flag") == 1),
                  [fx.analysis_feature_exprs()["multi_policy_group"].alias("multi_policy_group")])
    return (groups.crossJoin(F.broadcast(overall))
                  .withColumn("diff_vs_overall", F.round(F.col("churn_rate") - F.col("overall_rate"), 6)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and normalized shares (nulls dropped, as pandas does)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
                  .select(column, "count", F.round(F.col("count") / F.col("_total"), 6).alias("share")))


def hypothesis_long(df: DataFrame) -> DataFrame:
    """Long form (hypothesis, score, churn_flag) of the four hypothesis scores."""
    scored = fx.add_hypothesis_scores(df)
    stack = ", ".join(f"'{h}', {h}" for h in fx.HYPOTHESES)
    return scored.selectExpr(f"stack({len(fx.HYPOTHESES)}, {stack}) as (hypothesis, score)", LABEL)


def hypothesis_summary(df: DataFrame) -> DataFrame:
    """Per hypothesis the mean score and the highest per-score churn rate (%)."""
    long = hypothesis_long(df)
    per_level = long.groupBy("hypothesis", "score").agg(F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("r"))
    labels = df.sparkSession.createDataFrame(list(fx.HYPOTHESIS_LABELS.items()), ["hypothesis", "hypothesis_ko"])
    return (per_level.groupBy("hypothesis")
            .agg(F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 2).alias("mean_score"),
                 F.round(F.max("r") * 100, 2).alias("max_group_rate_pct"))
            .join(F.broadcast(labels), "hypothesis"))


def hypothesis_curve(df: DataFrame) -> DataFrame:
    """Churn rate per (hypothesis, score level), absent levels kept (null rate)."""
    long = hypothesis_long(df)
    per_level = long.groupBy("hypothesis", "score").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.avg(LABEL), 6).alias("churn_rate"))
    levels = df.sparkSession.createDataFrame(
        [(h, s) for h, top in fx.HYPOTHESIS_LEVELS.items() for s in range(top + 1)], ["hypothesis", "score"])
    return (F.broadcast(levels).join(per_level, ["hypothesis", "score"], "left")
            .select("hypothesis", F.col("score").cast("int").alias("score"),
                    F.coalesce("customers", F.lit(0)).cast("long").alias("customers"), "churn_rate"))


def quantile_edges(df: DataFrame, column: str, q: int = 5) -> DataFrame:
    """One-row frame with ``edges``: exact linear-interpolated quantiles at
    0, 1/q, ..., 1 with duplicates dropped (``qcut(duplicates='drop')``, S6)."""
    from churnlab.operators.ranking import exact_percentiles
    probs = [i / q for i in range(q + 1)]
    qs = exact_percentiles(df, [column], probs)
    return qs.select(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(len(probs))])).alias("edges"))


def qcut_bucket(x: Column, edges: Column) -> Column:
    """Right-closed bucket number (1-based), lowest edge included."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e < x)) + 1)


def rate_by_quantile(df: DataFrame, column: str, q: int = 5) -> DataFrame:
    """Churn rate per quintile bucket of ``column``; every bucket listed."""
    edges = quantile_edges(df, column, q)
    keyed = (df.select(column, LABEL).crossJoin(F.broadcast(edges))
               .withColumn("bucket", qcut_bucket(F.col(column), F.col("edges"))))
    agg = keyed.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.avg(LABEL), 6).alias("churn_rate"))
    buckets = edges.select(F.posexplode(F.slice(F.col("edges"), 2, F.greatest(F.size("edges") - 1, F.lit(0)))).alias("pos", "upper"),
                           F.col("edges"))
    buckets = buckets.select((F.col("pos") + 1).cast("int").alias("bucket"),
                             F.round(F.element_at("edges", (F.col("pos") + 1).cast("int")), 9).alias("lower"),
                             F.round("upper", 9).alias("upper"))
    return (buckets.join(agg, "bucket", "left")
            .select(F.lit(column).alias("feature"), "bucket", "lower", "upper",
                    F.coalesce("customers", F.lit(0)).cast("long").alias("customers"), "churn_rate"))


def class_ratio(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Negatives, positives and neg/pos ratio (weight for the positive class)."""
    return df.agg(F.count_if(F.col(label) == 0).alias("negatives"),
                  F.count_if(F.col(label) == 1).alias("positives")).withColumn(
        "neg_pos_ratio", F.round(F.try_divide(F.col("negatives"), F.col("positives")), 6))


DEFAULT_CUSTOMER_VALUE = 1200000


def default_customer_value(df: DataFrame) -> DataFrame:
    """``int(mean(current_premium) * 12)``; the fixed fallback when the column is absent."""
    if "current_premium" not in df.columns:
        return df.sparkSession.range(1).select(F.lit(DEFAULT_CUSTOMER_VALUE).cast("long").alias("customer_value"))
    return df.agg(F.floor(F.avg("current_premium") * 12).cast("long").alias("customer_value"))
