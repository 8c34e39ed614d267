"""SQL text of the feature and scoring expressions, for the DuckDB oracle.

These restate ``churnlab.functions`` in SQL; they are only used to check the
Spark plans, never to compute results.
"""

from __future__ import annotations

from churnlab.functions import features as fx
from churnlab.functions import scoring as sc


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


F1_SQL = {
    "premium_increase_shock": "(CASE WHEN premium_change_pct IS NOT NULL THEN greatest(premium_change_pct, 0.0e0) END"
                              " * (1 + num_price_increases_last_3y))",
    "premium_jump_flag": flag("premium_change_pct >= 0.12e0"),
    "payment_risk_score": "(late_payment_count_12m + missed_payment_flag * 2)",
    "service_risk_score": "(complaint_flag + quote_requested_flag + coverage_downgrade_flag)",
    "engagement_risk_score": "(late_payment_count_12m + missed_payment_flag * 2 + complaint_flag"
                             " + quote_requested_flag + coverage_downgrade_flag)",
    "tenure_inverse": "(1.0e0 / (customer_tenure_months + 1))",
    "single_policy_short_tenure": flag("multi_policy_flag = 0 AND customer_tenure_months <= 24"),
    "premium_x_complaint": f"({flag('premium_change_pct >= 0.12e0')} * complaint_flag)",
    "premium_x_quote": f"({flag('premium_change_pct >= 0.12e0')} * quote_requested_flag)",
    "late_x_quote": f"({flag('late_payment_count_12m >= 2')} * quote_requested_flag)",
    "downgrade_x_quote": "(coverage_downgrade_flag * quote_requested_flag)",
    "monthly_payment_flag": flag("payment_frequency = 'Monthly'"),
    "monthly_x_premium_jump": "(" + flag("payment_frequency = 'Monthly'") + " * "
                              + flag("premium_change_pct >= 0.12e0") + ")",
    "auto_or_health": flag("policy_type IN ('Auto', 'Health')"),
}

F1_SELECT = ",\n  ".join(f"{e} AS {n}" for n, e in F1_SQL.items())

HYP_SQL = {
    "price_risk_score": f"({flag('premium_change_pct >= 0.12e0')} + {flag('num_price_increases_last_3y >= 2')})",
    "payment_hyp_score": f"({flag('late_payment_count_12m >= 2')} + missed_payment_flag)",
    "service_hyp_score": "(complaint_flag + quote_requested_flag + coverage_downgrade_flag)",
    "retention_hyp_score": f"({flag('customer_tenure_months <= 24')} + {flag('multi_policy_flag = 0')})",
}

PREMIUM_BIN_SQL = (f"CASE WHEN premium_change_pct <= 0 THEN {q(fx.PREMIUM_CHANGE_BINS[0])}"
                   f" WHEN premium_change_pct <= 0.05e0 THEN {q(fx.PREMIUM_CHANGE_BINS[1])}"
                   f" WHEN premium_change_pct <= 0.10e0 THEN {q(fx.PREMIUM_CHANGE_BINS[2])}"
                   f" WHEN premium_change_pct IS NOT NULL THEN {q(fx.PREMIUM_CHANGE_BINS[3])} END")
INCREASE_LABEL_SQL = (f"CASE WHEN coalesce(premium_change_pct > 0, false) THEN {q('Increase')}"
                      f" ELSE {q('No increase')} END")
PAYOUT_GROUP_SQL = ("CASE WHEN payout_ratio_12m < 0 OR payout_ratio_12m > 1 THEN NULL"
                    + "".join(f" WHEN payout_ratio_12m <= {e}e0 THEN {q(lbl)}"
                              for e, lbl in zip(["0.2", "0.4", "0.6", "0.8", "1.0"], fx.PAYOUT_GROUPS))
                    + " END")
MULTI_GROUP_SQL = (f"CASE WHEN multi_policy_flag = 1 THEN CASE WHEN policy_type = 'Home' THEN {q(fx.MULTI_GROUPS[2])}"
                   f" WHEN policy_type = 'Auto' THEN {q(fx.MULTI_GROUPS[1])} ELSE {q(fx.MULTI_GROUPS[0])} END END")

ANALYSIS_SQL = {
    "premium_increased": flag("premium_change_pct > 0"),
    "premium_increased_label": INCREASE_LABEL_SQL,
    "premium_change_bin": PREMIUM_BIN_SQL,
    "is_rejected": flag("num_rejected_claims_12m > 0"),
    "payout_group": PAYOUT_GROUP_SQL,
    "unpaid_ratio": "(1.0e0 - payout_ratio_12m)",
    "anger_index_binary": f"(premium_change_pct * {flag('num_rejected_claims_12m > 0')})",
    "anger_index_count": "(premium_change_pct * num_rejected_claims_12m)",
    "claim_approval_rate": "((num_claims_12m - num_rejected_claims_12m) / (num_claims_12m + 0.1e0))",
    "loyalty_pain_score": "(customer_tenure_months * complaint_flag)",
    "claim_rejection_rate": "(num_rejected_claims_12m / (num_claims_12m + 1e-8))",
    "is_premium_spiked": flag("premium_change_pct > 0.10e0"),
    "active_churn_signal": flag("quote_requested_flag = 1 OR coverage_downgrade_flag = 1"),
    "premium_per_policy": "(current_premium / nullif(num_policies, 0))",
    "has_auto_home_potential": flag("multi_policy_flag = 1 AND policy_type IN ('Auto', 'Home')"),
    "is_auto": flag("policy_type = 'Auto' AND multi_policy_flag = 1"),
    "is_home": flag("policy_type = 'Home' AND multi_policy_flag = 1"),
    "multi_policy_group": MULTI_GROUP_SQL,
    "late_payment_risk_flag": flag("late_payment_count_12m >= 2"),
}

AGE_BAND_SQL = ("CASE WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44'"
                " WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' WHEN age < 75 THEN '65-74' ELSE '75+' END")

FEATURES_CTE = f"features AS (\n  SELECT *,\n  {F1_SELECT}\n  FROM policyholders\n)"


def tier_sql(score: str, threshold: float) -> str:
    c = sc.tier_cutoffs(threshold)
    return (f"CASE WHEN {score} >= {c['critical']!r}e0 THEN 'critical' WHEN {score} >= {c['high']!r}e0 THEN 'high'"
            f" WHEN {score} >= {c['watch']!r}e0 THEN 'watch' ELSE 'stable' END")


def tier_ko_sql(tier: str) -> str:
    return ("CASE " + " ".join(f"WHEN {tier} = {q(k)} THEN {q(v)}" for k, v in sc.TIER_LABELS_KO.items())
            + f" ELSE {tier} END")


def reason_sql() -> str:
    """R5 in SQL: list of fired phrases, first three joined, fallback when none."""
    rules = [
        f"CASE WHEN premium_change_pct >= 0.12e0 THEN {q(sc.REASON_PRICE_JUMP)}"
        f" WHEN num_price_increases_last_3y >= 2 THEN {q(sc.REASON_PRICE_COUNT)} END",
        f"CASE WHEN late_payment_count_12m >= 2 THEN {q(sc.REASON_LATE)}"
        f" WHEN missed_payment_flag = 1 THEN {q(sc.REASON_MISSED)} END",
        f"CASE WHEN complaint_flag = 1 THEN {q(sc.REASON_COMPLAINT)} END",
        f"CASE WHEN quote_requested_flag = 1 THEN {q(sc.REASON_QUOTE)} END",
        f"CASE WHEN coverage_downgrade_flag = 1 THEN {q(sc.REASON_DOWNGRADE)} END",
        f"CASE WHEN customer_tenure_months <= 12 THEN {q(sc.REASON_SHORT_TENURE)} END",
        f"CASE WHEN multi_policy_flag = 0 THEN {q(sc.REASON_SINGLE_POLICY)} END",
    ]
    lst = f"list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({lst}) = 0 THEN {q(sc.REASON_FALLBACK)} ELSE array_to_string({lst}[1:3], ', ') END"


def scored_cte(threshold: float = sc.DEFAULT_THRESHOLD, score: str = "churn_probability_true",
               source: str = "policyholders") -> str:
    """Scored table with the fixture probability as the model score (R6 twin)."""
    return f"""scored AS (
  SELECT s.*, CAST(row_number() OVER (ORDER BY churn_probability DESC, customer_id) AS BIGINT) AS coupon_priority
  FROM (
    SELECT *, {score} AS churn_probability,
           CAST({score} >= {threshold!r}e0 AS INTEGER) AS predicted_churn,
           {tier_sql(score, threshold)} AS risk_tier,
           {tier_ko_sql(tier_sql(score, threshold))} AS risk_tier_ko,
           {reason_sql()} AS prediction_reason
    FROM {source}) s
)"""
