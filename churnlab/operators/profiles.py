"""Profile completion and explanations, re-aimed from a one-row form to a batch
job over a table of partial profiles (survey P1-P5, J4).

The base profile is one aggregate row (medians of numeric columns, modes of
string columns); it is cross-joined by broadcast (exactly one row) to every
partial profile, and the override rules are column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from churnlab.functions import scoring as sc
from churnlab.operators.clean import drop_present
from churnlab.operators.prep import modes
from churnlab.sources.fixture import age_band_expr

PROFILE_DROP = ["customer_id", "as_of_date", "churn_flag", "churn_type", "churn_probability_true"]
PARTIAL_COLUMNS = ["profile_id", "age", "policy_type", "tenure", "premium", "late_payment_count",
                   "quote_requested_flag", "num_claims_12m"]


def base_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row; numeric columns -> median (interpolated, exact unless
    ``approx``), string columns -> most frequent value, smallest on ties."""
    from churnlab.operators.stats import quartiles
    feats = drop_present(df, PROFILE_DROP)
    nums = [f.name for f in feats.schema.fields if isinstance(f.dataType, NumericType)]
    strs = [f.name for f in feats.schema.fields if f.name not in nums]
    # Exact medians, then one row (pivot over the known names).
    med = quartiles(feats, nums, [0.5], approx).groupBy().pivot("column", nums).agg(F.first("q0"))
    row = med.crossJoin(F.broadcast(modes(feats, strs)))  # one row each
    return row.select(*[F.col(f.name).cast("double") if f.name in nums else F.col(f.name) for f in feats.schema.fields])


def partial_profiles(df: DataFrame) -> DataFrame:
    """The seven form inputs of every customer, as a partial-profile table."""
    return df.select(F.col("customer_id").alias("profile_id"), "age", "policy_type",
                     F.col("customer_tenure_months").alias("tenure"), F.col("current_premium").alias("premium"),
                     F.col("late_payment_count_12m").alias("late_payment_count"), "quote_requested_flag",
                     "num_claims_12m")


def complete_profiles(partial: DataFrame, base: DataFrame) -> DataFrame:
    """Base profile x partial rows with the override rules applied."""
    b = base.select(*[F.col(c).alias(f"_b_{c}") for c in base.columns])
    x = partial.crossJoin(F.broadcast(b))
    cols = base.columns
    premium, late = F.col("premium"), F.col("late_payment_count")
    claims, quote = F.col("num_claims_12m"), F.col("quote_requested_flag")
    last = premium / F.lit(1.05)
    out = {c: F.col(f"_b_{c}") for c in cols}
    out.update({
        "age": F.col("age"), "policy_type": F.col("policy_type"), "customer_tenure_months": F.col("tenure"),
        "current_premium": premium, "late_payment_count_12m": late, "quote_requested_flag": quote,
        "num_claims_12m": claims,
    })
    if "missed_payment_flag" in cols:
        out["missed_payment_flag"] = F.when(late >= 4, 1).otherwise(0)
    if "premium_last_year" in cols:
        out["premium_last_year"] = last
    if "premium_change_pct" in cols:
        prev = last if "premium_last_year" in cols else F.col("_b_premium_last_year")
        out["premium_change_pct"] = (premium - prev) / (prev + F.lit(1e-6))
    if "num_price_increases_last_3y" in cols:
        out["num_price_increases_last_3y"] = F.when(quote == 1, 2).otherwise(1)
    for c, v in (("num_pending_claims_12m", F.lit(0)), ("num_rejected_claims_12m", F.lit(0)),
                 ("num_approved_claims_12m", claims)):
        if c in cols:
            out[c] = v
    avg_claim = F.col("_b_avg_claim_amount") if "avg_claim_amount" in cols else F.lit(0.0)
    if "avg_claim_amount" in cols:
        avg_claim = F.when(claims == 0, F.lit(0.0)).otherwise(F.col("_b_avg_claim_amount"))
        out["avg_claim_amount"] = avg_claim
    total_claim = avg_claim * claims
    if "total_claim_amount_12m" in cols:
        out["total_claim_amount_12m"] = total_claim
    if "total_payout_amount_12m" in cols:
        ratio = F.col("_b_payout_ratio_12m") if "payout_ratio_12m" in cols else F.lit(0.8)
        claim_total = total_claim if "total_claim_amount_12m" in cols else F.lit(0.0)
        out["total_payout_amount_12m"] = claim_total * ratio
    if "payment_frequency" in cols:
        pf = F.col("_b_payment_frequency")
        out["payment_frequency"] = F.when(pf.isNull() | (pf == ""), F.lit("Monthly")).otherwise(pf)
    if "age_band" in cols:
        out["age_band"] = age_band_expr(F.col("age"))
    return x.select("profile_id", *[out[c].alias(c) for c in cols])


def profile_explanations(partial: DataFrame) -> DataFrame:
    """Up to three phrases per profile (five rules), newline-joined."""
    r = sc.profile_reasons("late_payment_count", "quote_requested_flag", "tenure", "premium", "num_claims_12m")
    return partial.select("profile_id", F.array_join(r, "\n").alias("explanation"))


def quick_explanations(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """P5: every firing phrase of the six quick rules, newline-joined."""
    r = sc.quick_reasons("premium_change_pct", "late_payment_count_12m", "quote_requested_flag",
                         "coverage_downgrade_flag", "customer_tenure_months", "missed_payment_flag")
    return df.select(key, F.array_join(r, "\n").alias("explanation"))
