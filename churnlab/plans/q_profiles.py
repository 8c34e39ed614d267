"""Catalogue: base profile, completed partial profiles, explanations (survey P1-P5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab.functions import scoring as sc
from churnlab.functions.scoring import DEFAULT_THRESHOLD, predicted_class, risk_tier
from churnlab.operators import profiles as pr
from churnlab.operators.whatif import linear_probability
from churnlab.plans.oracle_base import with_ctes
from churnlab.plans.registry import register
from churnlab.plans.sql_fragments import AGE_BAND_SQL, q, tier_sql
from churnlab.session import materialize, memo, memo_key
from churnlab.sources.fixture import POLICYHOLDER_COLUMNS, policyholders

STRING_COLS = {"region_name", "age_band", "marital_status", "policy_type", "payment_frequency"}
FEATURE_COLS = [c for c in POLICYHOLDER_COLUMNS if c not in pr.PROFILE_DROP]


def _base_sql() -> str:
    parts = []
    for c in FEATURE_COLS:
        if c in STRING_COLS:
            parts.append(f"(SELECT {c} FROM policyholders WHERE {c} IS NOT NULL GROUP BY {c}"
                         f" ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}")
        else:
            parts.append(f"(SELECT median(CAST({c} AS DOUBLE)) FROM policyholders) AS {c}")
    return "SELECT " + ", ".join(parts)


BASE_CTE = f"base AS ({_base_sql()})"
PARTIAL_CTE = ("partial AS (SELECT customer_id AS profile_id, age, policy_type, customer_tenure_months AS tenure,"
               " current_premium AS premium, late_payment_count_12m AS late_payment_count, quote_requested_flag,"
               " num_claims_12m FROM policyholders)")


def _completed_sql() -> str:
    ov = {
        "age": "p.age", "policy_type": "p.policy_type", "customer_tenure_months": "p.tenure",
        "current_premium": "p.premium", "late_payment_count_12m": "p.late_payment_count",
        "quote_requested_flag": "p.quote_requested_flag", "num_claims_12m": "p.num_claims_12m",
        "missed_payment_flag": "CASE WHEN p.late_payment_count >= 4 THEN 1 ELSE 0 END",
        "premium_last_year": "p.premium / 1.05e0",
        "premium_change_pct": "(p.premium - p.premium / 1.05e0) / (p.premium / 1.05e0 + 1e-6)",
        "num_price_increases_last_3y": "CASE WHEN p.quote_requested_flag = 1 THEN 2 ELSE 1 END",
        "num_pending_claims_12m": "0", "num_rejected_claims_12m": "0", "num_approved_claims_12m": "p.num_claims_12m",
        "avg_claim_amount": "CASE WHEN p.num_claims_12m = 0 THEN 0.0e0 ELSE b.avg_claim_amount END",
        "total_claim_amount_12m": "(CASE WHEN p.num_claims_12m = 0 THEN 0.0e0 ELSE b.avg_claim_amount END"
                                  " * p.num_claims_12m)",
        "total_payout_amount_12m": "(CASE WHEN p.num_claims_12m = 0 THEN 0.0e0 ELSE b.avg_claim_amount END"
                                   " * p.num_claims_12m) * b.payout_ratio_12m",
        "payment_frequency": "CASE WHEN b.payment_frequency IS NULL OR b.payment_frequency = '' THEN 'Monthly'"
                             " ELSE b.payment_frequency END",
        "age_band": AGE_BAND_SQL.replace("age <", "p.age <"),
    }
    return ("SELECT p.profile_id, " + ", ".join(f"{ov.get(c, 'b.' + c)} AS {c}" for c in FEATURE_COLS)
            + " FROM partial p CROSS JOIN base b")


COMPLETED_CTE = f"completed AS ({_completed_sql()})"


_BASE: dict = memo()


def base(spark, d):
    """Base profile (one row), checkpointed once per session and folder."""
    key = memo_key(spark, d)
    if key not in _BASE:
        _BASE[key] = materialize(pr.base_profile(policyholders(spark, d)))
    return _BASE[key]


def completed(spark, d):
    return pr.complete_profiles(pr.partial_profiles(policyholders(spark, d)), base(spark, d))


@register("p01_base_profile", with_ctes("SELECT * FROM base", BASE_CTE))
def q_p01(spark, d):
    return pr.base_profile(policyholders(spark, d))


@register("p02_completed_profiles", with_ctes("SELECT * FROM completed", BASE_CTE, PARTIAL_CTE, COMPLETED_CTE))
def q_p02(spark, d):
    return completed(spark, d)


T = DEFAULT_THRESHOLD
LIN_SQL = ("round(1.0e0 / (1.0e0 + exp(-(-2.3e0 + 2.0e0 * greatest(coalesce(premium_change_pct, 0.0e0), 0.0e0)"
           " + 0.35e0 * late_payment_count_12m + 0.7e0 * complaint_flag + 0.6e0 * quote_requested_flag"
           " + 0.6e0 * coverage_downgrade_flag - 0.6e0 * multi_policy_flag"
           " + 0.7e0 * CAST(customer_tenure_months <= 24 AS INTEGER)))), 6)")


@register("p03_profile_tiers_linear", with_ctes(
    f"SELECT profile_id, prob AS churn_probability, CAST(prob >= {T!r}e0 AS INTEGER) AS predicted_churn,"
    f" {tier_sql('prob', T)} AS risk_tier FROM (SELECT profile_id, {LIN_SQL} AS prob FROM completed)",
    BASE_CTE, PARTIAL_CTE, COMPLETED_CTE))
def q_p03(spark, d):
    """P3 with the deterministic linear scorer (the model-based twin is in the ML catalogue)."""
    c = completed(spark, d).withColumn("churn_probability", linear_probability())
    return c.select("profile_id", "churn_probability",
                    predicted_class("churn_probability", T).alias("predicted_churn"),
                    risk_tier("churn_probability", T).alias("risk_tier"))


def _reasons_sql(rules: list[str], limit: int | None, fallback: str) -> str:
    lst = f"list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL)"
    kept = f"{lst}[1:{limit}]" if limit else lst
    return f"CASE WHEN len({lst}) = 0 THEN {q(fallback)} ELSE array_to_string({kept}, chr(10)) END"


_P4_RULES = [
    f"CASE WHEN late_payment_count >= 2 THEN {q(sc.PROFILE_REASONS[0])} END",
    f"CASE WHEN quote_requested_flag = 1 THEN {q(sc.PROFILE_REASONS[1])} END",
    f"CASE WHEN tenure <= 24 THEN {q(sc.PROFILE_REASONS[2])} END",
    f"CASE WHEN premium >= 200000 THEN {q(sc.PROFILE_REASONS[3])} END",
    f"CASE WHEN num_claims_12m >= 3 THEN {q(sc.PROFILE_REASONS[4])} END",
]


@register("p04_profile_explanations", with_ctes(
    f"SELECT profile_id, {_reasons_sql(_P4_RULES, 3, sc.PROFILE_FALLBACK)} AS explanation FROM partial", PARTIAL_CTE))
def q_p04(spark, d):
    return pr.profile_explanations(pr.partial_profiles(policyholders(spark, d)))


_P5_RULES = [
    f"CASE WHEN premium_change_pct > 0.1e0 THEN {q(sc.QUICK_REASONS[0])} END",
    f"CASE WHEN late_payment_count_12m >= 2 THEN {q(sc.QUICK_REASONS[1])} END",
    f"CASE WHEN quote_requested_flag = 1 THEN {q(sc.QUICK_REASONS[2])} END",
    f"CASE WHEN coverage_downgrade_flag = 1 THEN {q(sc.QUICK_REASONS[3])} END",
    f"CASE WHEN customer_tenure_months < 12 THEN {q(sc.QUICK_REASONS[4])} END",
    f"CASE WHEN missed_payment_flag = 1 THEN {q(sc.QUICK_REASONS[5])} END",
]


@register("p05_quick_explanations", with_ctes(
    f"SELECT customer_id, {_reasons_sql(_P5_RULES, None, sc.QUICK_FALLBACK)} AS explanation FROM policyholders"))
def q_p05(spark, d):
    return pr.quick_explanations(policyholders(spark, d))
