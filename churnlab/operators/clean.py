"""Projections, cleaning and row filters (survey C1-C15, C17).

Drops and selections are plan-time column lists, so Catalyst prunes them all the
way into the Parquet scan (ReadSchema); filters push down as PushedFilters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.functions.features import clip_upper
from churnlab.operators.ranking import rank_within_groups

# The column drop lists of the reference.
UNUSED_COLUMNS = ["customer_id", "region_name", "as_of_date", "renewal_month", "payment_frequency",
                  "autopay_enabled", "churn_type", "churn_probability_true"]
REDUNDANT_COLUMNS = ["age_band", "premium_last_year", "missed_payment_flag", "coverage_amount",
                     "num_approved_claims_12m", "num_pending_claims_12m", "num_policies",
                     "complaint_resolution_days", "total_claim_amount_12m"]
CATEGORICAL_COLUMNS = ["age_band", "marital_status", "policy_type"]
LEAKAGE_COLUMNS = ["customer_id", "as_of_date", "churn_type", "churn_probability_true"]
LABEL = "churn_flag"
PREVIEW_COLUMNS = ["customer_id", "region_name", "age", "policy_type", "current_premium",
                   "premium_change_pct", "churn_flag", "churn_probability_true"]


def drop_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop only the columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_unused(df: DataFrame) -> DataFrame:
    """C1."""
    return drop_present(df, UNUSED_COLUMNS)


def drop_redundant(df: DataFrame) -> DataFrame:
    """C2."""
    return drop_present(df, REDUNDANT_COLUMNS)


def encoding_table(df: DataFrame, cols: Sequence[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """C3 map (column, code, label): alphabetical codes over the distinct values
    rendered as strings (null -> 'nan'), like ``LabelEncoder`` on ``astype(str)``.
    The labels are numbered by ``rank_within_groups``, so a column with very many
    labels is not gathered into one task."""
    parts = None
    for c in cols:
        if c not in df.columns:
            continue
        vals = df.select(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("label")).distinct()
        p = vals.select(F.lit(c).alias("column"), "label")
        parts = p if parts is None else parts.unionByName(p)
    ranked = rank_within_groups(parts, "column", ["label"], "_rk")
    return ranked.select("column", (F.col("_rk") - 1).cast("int").alias("code"), "label")


def label_encode(df: DataFrame, cols: Sequence[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Replace each categorical column by its alphabetical code (a join
    against the code table; Spark broadcasts it only if its size allows)."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    codes = encoding_table(df, present)
    out = df
    for c in present:
        m = codes.where(F.col("column") == c).select(F.col("label").alias(f"_lbl_{c}"), F.col("code").alias(f"_code_{c}"))
        out = (out.join(m, F.coalesce(F.col(c).cast("string"), F.lit("nan")) == F.col(f"_lbl_{c}"), "left")
                  .withColumn(c, F.col(f"_code_{c}")).drop(f"_lbl_{c}", f"_code_{c}"))
    return out.select(*df.columns)


def load_level(df: DataFrame, level: int | None) -> DataFrame:
    """IO2 preprocessing levels: None -> drop unused; 1 -> + drop redundant + encode; else raw."""
    if level is None:
        return drop_unused(df)
    if level == 1:
        return label_encode(drop_redundant(drop_unused(df)))
    return df


def feature_frame(df: DataFrame) -> DataFrame:
    """C4: drop leakage columns and the label."""
    return drop_present(df, LEAKAGE_COLUMNS + [LABEL])


def clip_policies(df: DataFrame, cap: int = 10) -> DataFrame:
    """C6."""
    return df.withColumn("num_policies", clip_upper(F.col("num_policies"), cap).cast("int"))


def cap_rate(df: DataFrame, column: str = "premium_change_pct", cap: float = 0.119) -> DataFrame:
    """C7."""
    return df.withColumn(column, clip_upper(F.col(column), cap))


def inf_to_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """+/-inf and NaN -> null -> 0 on floating columns."""
    from pyspark.sql.types import DoubleType, FloatType
    targets = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({
        c: F.coalesce(F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))), F.col(c)), F.lit(0.0))
        for c in targets})


def claimants(df: DataFrame) -> DataFrame:
    """C9."""
    return df.where(F.col("num_claims_12m") > 0)


def multi_policy_only(df: DataFrame) -> DataFrame:
    """C10."""
    return df.where(F.col("multi_policy_flag") == 1)


def parse_date(df: DataFrame, column: str = "as_of_date", out: str | None = None) -> DataFrame:
    """C11: coerced parse; unparseable -> null."""
    return df.withColumn(out or column, F.to_date(F.try_to_timestamp(F.col(column))))


def preview(df: DataFrame, cols: Sequence[str] = PREVIEW_COLUMNS, n: int = 20) -> DataFrame:
    """Fixed columns, first n by customer id (top-n report)."""
    return df.select(*[c for c in cols if c in df.columns]).orderBy("customer_id").limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """C14: filter options."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def distinct_count(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """C15."""
    agg = F.approx_count_distinct(column) if approx else F.count_distinct(column)
    return df.agg(agg.alias("distinct_count"))
