"""Probability -> class, risk tier, tier label and reason text (survey R1-R5, P4, P5).

Everything is a literal-folded ``CASE WHEN`` or array expression: the row-wise
``apply`` of the reference becomes codegen'd projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.functions.features import col, flag

TIERS = ["critical", "high", "watch", "stable"]
# Korean tier labels.
TIER_LABELS_KO = {"critical": "즉시 대응", "high": "고위험", "watch": "관찰 필요", "stable": "안정"}

# Reason phrases of the scored table, in rule order.
REASON_PRICE_JUMP = "보험료 인상폭이 큼"
REASON_PRICE_COUNT = "최근 보험료 인상 횟수가 많음"
REASON_LATE = "최근 연체 횟수가 많음"
REASON_MISSED = "납부 누락 이력이 있음"
REASON_COMPLAINT = "민원 이력이 있음"
REASON_QUOTE = "타사 비교 견적 요청 이력이 있음"
REASON_DOWNGRADE = "보장 축소 이력이 있음"
REASON_SHORT_TENURE = "가입 기간이 짧음"
REASON_SINGLE_POLICY = "복수 계약이 아님"
REASON_FALLBACK = "여러 위험 신호가 복합적으로 감지됨"

DEFAULT_THRESHOLD = 0.20


def tier_cutoffs(threshold: float) -> dict[str, float]:
    """R2: plan-time constants (folded into the tier expression)."""
    return {"watch": max(0.25, threshold * 1.2), "high": max(0.40, threshold * 2.0),
            "critical": max(0.60, threshold * 3.0)}


def predicted_class(score: Column | str, threshold: float) -> Column:
    """R1."""
    return flag(col(score) >= F.lit(float(threshold)))


def risk_tier(score: Column | str, threshold: float) -> Column:
    """Inclusive lower bounds, checked from the top."""
    c = tier_cutoffs(threshold)
    s = col(score)
    return (F.when(s >= c["critical"], "critical").when(s >= c["high"], "high")
             .when(s >= c["watch"], "watch").otherwise("stable"))


def tier_label_ko(tier: Column | str) -> Column:
    """Unknown values pass through."""
    m = F.create_map(*[F.lit(x) for kv in TIER_LABELS_KO.items() for x in kv])
    return F.coalesce(m[col(tier)], col(tier))


def _opt(df_cols: set[str] | None, name: str, default) -> Column:
    """Column if present, else the reference's ``row.get`` default (C17)."""
    if df_cols is not None and name not in df_cols:
        return F.lit(default)
    return F.col(name)


def reason_text(df_cols: set[str] | None = None, limit: int = 3) -> Column:
    """Up to seven rules in order (two if/elif pairs), fallback phrase when
    none fires, first ``limit`` joined with ', '. A null value fires no rule."""
    g = lambda name, d: _opt(df_cols, name, d)
    pct, inc = g("premium_change_pct", 0), g("num_price_increases_last_3y", 0)
    late, missed = g("late_payment_count_12m", 0), g("missed_payment_flag", 0)
    t = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        F.when(t(pct >= 0.12), REASON_PRICE_JUMP).when(t(inc >= 2), REASON_PRICE_COUNT),
        F.when(t(late >= 2), REASON_LATE).when(t(missed == 1), REASON_MISSED),
        F.when(t(g("complaint_flag", 0) == 1), REASON_COMPLAINT),
        F.when(t(g("quote_requested_flag", 0) == 1), REASON_QUOTE),
        F.when(t(g("coverage_downgrade_flag", 0) == 1), REASON_DOWNGRADE),
        F.when(t(g("customer_tenure_months", 9999) <= 12), REASON_SHORT_TENURE),
        F.when(t(g("multi_policy_flag", 1) == 0), REASON_SINGLE_POLICY),
    ]
    fired = F.array_compact(F.array(*rules))
    kept = F.slice(fired, 1, limit)
    return F.when(F.size(fired) == 0, REASON_FALLBACK).otherwise(F.concat_ws(", ", kept))


def add_score_columns(df: DataFrame, score_col: str, threshold: float = DEFAULT_THRESHOLD,
                      prob_col: str = "churn_probability") -> DataFrame:
    """R1, R3, R4, R5 on a table that already carries a probability in ``score_col``."""
    cols = set(df.columns)
    return df.withColumns({
        prob_col: F.col(score_col),
        "predicted_churn": predicted_class(score_col, threshold),
        "risk_tier": risk_tier(score_col, threshold),
    }).withColumns({
        "risk_tier_ko": tier_label_ko("risk_tier"),
        "prediction_reason": reason_text(cols),
    })


# Profile explanation phrases (P4, five rules, first three kept).
PROFILE_REASONS = [
    "연체 횟수가 높아 납부 불안정 신호가 있습니다.",
    "비교 견적 요청 이력이 있어 이탈 가능성이 높아질 수 있습니다.",
    "가입 기간이 짧아 계약 결속도가 낮을 수 있습니다.",
    "보험료 수준이 높아 가격 부담이 작용할 수 있습니다.",
    "최근 청구 이력이 많아 서비스 경험이 이탈에 영향을 줄 수 있습니다.",
]
PROFILE_FALLBACK = "입력 정보 기준 뚜렷한 위험 신호는 상대적으로 적습니다."

# Quick explanation phrases (P5, six rules, all kept).
QUICK_REASONS = [
    "보험료 상승률이 높아 이탈 가능성이 커질 수 있습니다.",
    "최근 연체 횟수가 많아 유지 리스크가 증가할 수 있습니다.",
    "견적 요청 이력이 있어 다른 보험 상품을 비교 중일 가능성이 있습니다.",
    "보장 축소 이력이 있어 비용 부담 기반 이탈 신호일 수 있습니다.",
    "가입 기간이 짧아 고객 충성도가 낮을 가능성이 있습니다.",
    "연체 심각 여부가 활성화되어 있어 강한 위험 신호로 볼 수 있습니다.",
]
QUICK_FALLBACK = "입력된 정보 기준 뚜렷한 고위험 신호는 상대적으로 적습니다."


def profile_reasons(late: str, quote: str, tenure: str, premium: str, claims: str) -> Column:
    """Array of up to three phrases (fallback phrase when none fires)."""
    t = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        F.when(t(F.col(late) >= 2), PROFILE_REASONS[0]),
        F.when(t(F.col(quote) == 1), PROFILE_REASONS[1]),
        F.when(t(F.col(tenure) <= 24), PROFILE_REASONS[2]),
        F.when(t(F.col(premium) >= 200000), PROFILE_REASONS[3]),
        F.when(t(F.col(claims) >= 3), PROFILE_REASONS[4]),
    ]
    fired = F.array_compact(F.array(*rules))
    return F.when(F.size(fired) == 0, F.array(F.lit(PROFILE_FALLBACK))).otherwise(F.slice(fired, 1, 3))


def quick_reasons(pct: str, late: str, quote: str, downgrade: str, tenure: str, missed: str) -> Column:
    """P5: every firing phrase (fallback phrase when none fires)."""
    t = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        F.when(t(F.col(pct) > 0.1), QUICK_REASONS[0]),
        F.when(t(F.col(late) >= 2), QUICK_REASONS[1]),
        F.when(t(F.col(quote) == 1), QUICK_REASONS[2]),
        F.when(t(F.col(downgrade) == 1), QUICK_REASONS[3]),
        F.when(t(F.col(tenure) < 12), QUICK_REASONS[4]),
        F.when(t(F.col(missed) == 1), QUICK_REASONS[5]),
    ]
    fired = F.array_compact(F.array(*rules))
    return F.when(F.size(fired) == 0, F.array(F.lit(QUICK_FALLBACK))).otherwise(fired)
