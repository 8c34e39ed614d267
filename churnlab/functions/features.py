"""Column expressions for engineered features (survey F1-F26).

All are built-in Catalyst expressions, so they fuse into whole-stage codegen.
Null rules (survey S1/S2): a comparison against a missing value yields flag 0;
arithmetic on a missing value stays missing (``greatest`` would skip nulls, so
clipping is guarded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int; a null comparison counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip_lower(x: Column, lower: float = 0.0) -> Column:
    """``clip(lower=...)`` keeping nulls null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lower)))


def clip_upper(x: Column, upper: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(upper)))


# ---------------------------------------------------------------- F1 (14 features)
ENGINEERED_FEATURES = [
    "premium_increase_shock", "premium_jump_flag", "payment_risk_score", "service_risk_score",
    "engagement_risk_score", "tenure_inverse", "single_policy_short_tenure", "premium_x_complaint",
    "premium_x_quote", "late_x_quote", "downgrade_x_quote", "monthly_payment_flag",
    "monthly_x_premium_jump", "auto_or_health",
]


def engineered_feature_exprs() -> dict[str, Column]:
    pct = F.col("premium_change_pct")
    jump = flag(pct >= 0.12)
    pay = F.col("late_payment_count_12m") + F.col("missed_payment_flag") * 2
    service = F.col("complaint_flag") + F.col("quote_requested_flag") + F.col("coverage_downgrade_flag")
    monthly = flag(F.col("payment_frequency") == "Monthly")
    return {
        "premium_increase_shock": clip_lower(pct) * (F.lit(1) + F.col("num_price_increases_last_3y")),
        "premium_jump_flag": jump,
        "payment_risk_score": pay,
        "service_risk_score": service,
        "engagement_risk_score": pay + service,
        "tenure_inverse": F.lit(1.0) / (F.col("customer_tenure_months") + F.lit(1)),
        "single_policy_short_tenure": flag((F.col("multi_policy_flag") == 0)
                                           & (F.col("customer_tenure_months") <= 24)),
        "premium_x_complaint": jump * F.col("complaint_flag"),
        "premium_x_quote": jump * F.col("quote_requested_flag"),
        "late_x_quote": flag(F.col("late_payment_count_12m") >= 2) * F.col("quote_requested_flag"),
        "downgrade_x_quote": F.col("coverage_downgrade_flag") * F.col("quote_requested_flag"),
        "monthly_payment_flag": monthly,
        "monthly_x_premium_jump": monthly * jump,
        "auto_or_health": flag(F.col("policy_type").isin("Auto", "Health")),
    }


def add_engineered_features(df: DataFrame) -> DataFrame:
    """one projection adding the 14 model features (shared by training,
    scoring, profiles and scenarios)."""
    return df.withColumns(engineered_feature_exprs())


# ---------------------------------------------------------------- F2-F5 hypothesis scores
HYPOTHESES = ["price_risk_score", "payment_hyp_score", "service_hyp_score", "retention_hyp_score"]
# Display names of the four hypothesis groups, in the reference's order.
HYPOTHESIS_LABELS = {
    "price_risk_score": "가격 충격",
    "payment_hyp_score": "납부 불안정",
    "service_hyp_score": "서비스 불만",
    "retention_hyp_score": "계약 결속도 약함",
}
HYPOTHESIS_LEVELS = {"price_risk_score": 2, "payment_hyp_score": 2, "service_hyp_score": 3,
                     "retention_hyp_score": 2}


def hypothesis_score_exprs() -> dict[str, Column]:
    return {
        "price_risk_score": flag(F.col("premium_change_pct") >= 0.12)
                            + flag(F.col("num_price_increases_last_3y") >= 2),
        "payment_hyp_score": flag(F.col("late_payment_count_12m") >= 2) + F.col("missed_payment_flag"),
        "service_hyp_score": F.col("complaint_flag") + F.col("quote_requested_flag")
                             + F.col("coverage_downgrade_flag"),
        "retention_hyp_score": flag(F.col("customer_tenure_months") <= 24)
                               + flag(F.col("multi_policy_flag") == 0),
    }


def add_hypothesis_scores(df: DataFrame) -> DataFrame:
    return df.withColumns(hypothesis_score_exprs())


# ---------------------------------------------------------------- F6-F26 analysis features
# Bin labels used by the analysis notebooks.
PREMIUM_CHANGE_BINS = ["<=0%", "0-5%", "5-10%", "10%+"]
PAYOUT_GROUPS = ["0-20%(매우불만)", "20-40%", "40-60%", "60-80%", "80-100%(매우만족)"]
INCREASE_LABELS = {0: "No increase", 1: "Increase"}
MULTI_GROUPS = ["General Multi", "Auto Combo", "Home Combo"]
RISK_LEVELS_3 = ["저위험", "중위험", "고위험"]          # F25: (-1,.4], (.4,.7], (.7,1]
PROB_LEVELS_3 = ["낮은 위험군", "중간 위험군", "높은 위험군"]  # <30%, <70%, else


def premium_increased(pct: Column | str = "premium_change_pct") -> Column:
    """pct > 0 as 0/1 (missing -> 0)."""
    return flag(col(pct) > 0)


def premium_increased_label(pct: Column | str = "premium_change_pct") -> Column:
    return F.when(premium_increased(pct) == 1, INCREASE_LABELS[1]).otherwise(INCREASE_LABELS[0])


def premium_change_bin(pct: Column | str = "premium_change_pct") -> Column:
    """``pd.cut`` right-closed bins (-inf,0], (0,.05], (.05,.10], (.10,inf); null stays null."""
    x = col(pct)
    return (F.when(x <= 0, PREMIUM_CHANGE_BINS[0]).when(x <= 0.05, PREMIUM_CHANGE_BINS[1])
             .when(x <= 0.10, PREMIUM_CHANGE_BINS[2]).when(x.isNotNull(), PREMIUM_CHANGE_BINS[3]))


def premium_change_bin_order(pct: Column | str = "premium_change_pct") -> Column:
    x = col(pct)
    return F.when(x <= 0, 0).when(x <= 0.05, 1).when(x <= 0.10, 2).when(x.isNotNull(), 3)


def is_rejected(c: Column | str = "num_rejected_claims_12m") -> Column:
    """F8."""
    return flag(col(c) > 0)


def payout_group(c: Column | str = "payout_ratio_12m") -> Column:
    """five right-closed 20% bins over [0, 1], the lowest edge included; outside -> null."""
    x = col(c)
    return (F.when((x < 0) | (x > 1), F.lit(None).cast("string"))
             .when(x <= 0.2, PAYOUT_GROUPS[0]).when(x <= 0.4, PAYOUT_GROUPS[1])
             .when(x <= 0.6, PAYOUT_GROUPS[2]).when(x <= 0.8, PAYOUT_GROUPS[3])
             .when(x <= 1.0, PAYOUT_GROUPS[4]))


def unpaid_ratio(c: Column | str = "payout_ratio_12m") -> Column:
    """F10."""
    return F.lit(1.0) - col(c)


def analysis_feature_exprs() -> dict[str, Column]:
    """F6-F24 as named columns (F15 only when ``num_claims_6m`` exists; see
    ``recent_activity_ratio``)."""
    pct = F.col("premium_change_pct")
    claims = F.col("num_claims_12m")
    rejected = F.col("num_rejected_claims_12m")
    multi = F.col("multi_policy_flag")
    ptype = F.col("policy_type")
    is_auto = flag((ptype == "Auto") & (multi == 1))
    is_home = flag((ptype == "Home") & (multi == 1))
    return {
        "premium_increased": premium_increased(pct),
        "premium_increased_label": premium_increased_label(pct),
        "premium_change_bin": premium_change_bin(pct),
        "is_rejected": is_rejected(rejected),
        "payout_group": payout_group("payout_ratio_12m"),
        "unpaid_ratio": unpaid_ratio("payout_ratio_12m"),
        "anger_index_binary": pct * is_rejected(rejected),
        "anger_index_count": pct * rejected,
        "claim_approval_rate": (claims - rejected) / (claims + F.lit(0.1)),
        "loyalty_pain_score": F.col("customer_tenure_months") * F.col("complaint_flag"),
        "claim_rejection_rate": rejected / (claims + F.lit(1e-8)),
        "is_premium_spiked": flag(pct > 0.10),
        "active_churn_signal": flag((F.col("quote_requested_flag") == 1) | (F.col("coverage_downgrade_flag") == 1)),
        "premium_per_policy": F.try_divide(F.col("current_premium"), F.col("num_policies")),
        "has_auto_home_potential": flag((multi == 1) & ptype.isin("Auto", "Home")),
        "is_auto": is_auto,
        "is_home": is_home,
        "multi_policy_group": F.when(multi == 1, F.when(is_home == 1, MULTI_GROUPS[2])
                                     .when(is_auto == 1, MULTI_GROUPS[1]).otherwise(MULTI_GROUPS[0])),
        "late_payment_risk_flag": flag(F.col("late_payment_count_12m") >= 2),
    }


def recent_activity_ratio(df: DataFrame) -> DataFrame:
    """only when the optional ``num_claims_6m`` column exists (C17 tolerance)."""
    if "num_claims_6m" not in df.columns:
        return df
    return df.withColumn("recent_activity_ratio",
                         F.col("num_claims_6m") / (F.col("num_claims_12m") / 2 + F.lit(0.1)))


def risk_level_3(p: Column | str = "churn_probability_true") -> Column:
    """``pd.cut(bins=[-1, .4, .7, 1])``; outside (-1, 1] -> null."""
    x = col(p)
    return (F.when((x <= -1) | (x > 1), F.lit(None).cast("string"))
             .when(x <= 0.4, RISK_LEVELS_3[0]).when(x <= 0.7, RISK_LEVELS_3[1])
             .when(x <= 1.0, RISK_LEVELS_3[2]))


def probability_level_3(p: Column | str) -> Column:
    """percent < 30 low, < 70 mid, else high."""
    pct = col(p) * 100
    return F.when(pct < 30, PROB_LEVELS_3[0]).when(pct < 70, PROB_LEVELS_3[1]).otherwise(PROB_LEVELS_3[2])
