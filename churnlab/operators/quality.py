"""Data-quality checks as queries (survey D1-D6): one row per check with
total, matching and failing row counts, from a single conditional aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.operators.clean import LEAKAGE_COLUMNS, LABEL


Rule = tuple[str, Column, Column]


def _run(df: DataFrame, *rules: Rule) -> DataFrame:
    """All rules in one aggregate, one row per rule."""
    aggs = []
    for i, (_, applicable, ok) in enumerate(rules):
        aggs += [F.count_if(applicable).alias(f"t{i}"), F.count_if(applicable & F.coalesce(ok, F.lit(False))).alias(f"m{i}")]
    rows = ", ".join(f"'{name}', t{i}, m{i}" for i, (name, _, _) in enumerate(rules))
    return df.agg(*aggs).selectExpr(f"stack({len(rules)}, {rows}) as (`check`, total, matching)").withColumn(
        "failing", F.col("total") - F.col("matching"))


def change_pct_rule(tol: float = 1e-4) -> Rule:
    """Pct ~ (premium - last) / last, where all three are present."""
    cur, last, pct = F.col("current_premium"), F.col("premium_last_year"), F.col("premium_change_pct")
    app = cur.isNotNull() & last.isNotNull() & pct.isNotNull() & (last != 0)
    return "premium_change_pct", app, F.abs(pct - (cur - last) / last) < tol


def missed_flag_rule() -> Rule:
    """Missed flag <=> late >= 4."""
    ok = F.col("missed_payment_flag") == (F.col("late_payment_count_12m") >= 4).cast("int")
    return "missed_payment_flag", F.lit(True), ok


def coverage_ratio_rule(tol: float = 0.01) -> Rule:
    """D3: ratio ~ premium / coverage within +/- tol (absolute, B6)."""
    cur, cov, ratio = F.col("current_premium"), F.col("coverage_amount"), F.col("premium_to_coverage_ratio")
    app = cur.isNotNull() & cov.isNotNull() & ratio.isNotNull() & (cov != 0)
    return "premium_to_coverage_ratio", app, F.abs(ratio - cur / cov) < tol


def claim_split_rule() -> Rule:
    """claims = approved + rejected + pending."""
    ok = F.col("num_claims_12m") == (F.col("num_approved_claims_12m") + F.col("num_rejected_claims_12m")
                                     + F.col("num_pending_claims_12m"))
    return "claim_split", F.lit(True), ok


def check_change_pct(df: DataFrame, tol: float = 1e-4) -> DataFrame:
    return _run(df, change_pct_rule(tol))


def check_missed_flag(df: DataFrame) -> DataFrame:
    return _run(df, missed_flag_rule())


def check_coverage_ratio(df: DataFrame, tol: float = 0.01) -> DataFrame:
    return _run(df, coverage_ratio_rule(tol))


def check_claim_split(df: DataFrame) -> DataFrame:
    return _run(df, claim_split_rule())


def all_checks(df: DataFrame) -> DataFrame:
    """D1-D4 in one scan."""
    return _run(df, change_pct_rule(), missed_flag_rule(), coverage_ratio_rule(), claim_split_rule())


def leakage_check(df: DataFrame, features: DataFrame) -> DataFrame:
    """D5 as a table: one row per column of ``df`` that must not reach a model, and whether it is among ``features``."""
    present = set(leakage_columns_present(features.columns))
    rows = [(c, c in present) for c in sorted({*LEAKAGE_COLUMNS, LABEL}) if c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, among_features boolean")


def leakage_columns_present(feature_columns: Sequence[str]) -> list[str]:
    """Plan-time schema check; an empty list means no leakage."""
    return [c for c in LEAKAGE_COLUMNS + [LABEL] if c in feature_columns]


def unchanged(before: DataFrame, after: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Is the scenario output identical to its input? Null-safe row compare
    on the key (1:1 join)."""
    b = before.select(key, F.struct(*cols).alias("_b"))
    a = after.select(key, F.struct(*cols).alias("_a"))
    return b.join(a, key, "full").agg(
        F.coalesce(F.bool_and(F.col("_b").eqNullSafe(F.col("_a"))), F.lit(True)).alias("identical"),
        F.count_if(~F.col("_b").eqNullSafe(F.col("_a"))).alias("rows_changed"))
