"""Small fixed lookup tables (column dictionary, translations, tiers, scenarios).

Each is a literal of known size, so a broadcast join against it is bounded by
construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlab.functions.scoring import TIER_LABELS_KO, TIERS

# The policyholder column dictionary (column, description), in file order.
COLUMN_DESCRIPTIONS = [
    ("customer_id", "Unique customer identifier"),
    ("as_of_date", "Reference date for features/label"),
    ("region_name", "Customer region"),
    ("age", "Customer age (years)"),
    ("age_band", "Age band bucket"),
    ("marital_status", "Marital status"),
    ("customer_tenure_months", "Tenure with insurer in months"),
    ("multi_policy_flag", "1 if customer holds multiple policies, else 0"),
    ("num_policies", "Number of policies held by customer (synthetic)"),
    ("policy_type", "Primary policy type"),
    ("renewal_month", "Policy renewal month (1-12)"),
    ("current_premium", "Current annualised premium amount (NZD)"),
    ("premium_last_year", "Prior year annualised premium amount (NZD)"),
    ("premium_change_pct", "Premium change percentage vs last year"),
    ("num_price_increases_last_3y", "Count of premium increases in last 3 years (synthetic)"),
    ("coverage_amount", "Coverage amount / sum insured (NZD)"),
    ("premium_to_coverage_ratio", "Premium divided by coverage amount"),
    ("payment_frequency", "Payment frequency (Monthly/Annual)"),
    ("autopay_enabled", "1 if autopay enabled, else 0"),
    ("late_payment_count_12m", "Count of late payments in last 12 months"),
    ("missed_payment_flag", "1 if missed payments flag (>=4 late payments), else 0"),
    ("payment_method_change_flag", "1 if payment method changed recently, else 0"),
    ("num_claims_12m", "Number of claims in last 12 months"),
    ("num_approved_claims_12m", "Number of approved claims in last 12 months"),
    ("num_rejected_claims_12m", "Number of rejected claims in last 12 months"),
    ("num_pending_claims_12m", "Number of pending claims in last 12 months"),
    ("avg_claim_amount", "Average claim amount (NZD)"),
    ("total_claim_amount_12m", "Total claim amount in last 12 months (NZD)"),
    ("total_payout_amount_12m", "Total payout amount in last 12 months (NZD)"),
    ("payout_ratio_12m", "Total payout divided by total claim amount (last 12 months)"),
    ("avg_settlement_time_days", "Average settlement time for claims (days)"),
    ("days_since_last_claim", "Days since last claim (proxy recency)"),
    ("num_contacts_12m", "Number of customer contacts in last 12 months"),
    ("complaint_flag", "1 if complaint lodged, else 0"),
    ("complaint_resolution_days", "Complaint resolution time in days (0 if no complaint)"),
    ("quote_requested_flag", "1 if customer requested a quote (proxy shopping), else 0"),
    ("coverage_downgrade_flag", "1 if customer downgraded coverage, else 0"),
    ("churn_flag", "Target label: 1 = churned at renewal, 0 = retained"),
    ("churn_type", "Heuristic churn reason (synthetic)"),
    ("churn_probability_true", "Underlying churn probability used to generate labels (drop before upload if desired)"),
]

# Korean translation of each description.
DESCRIPTION_KO = {
    "Unique customer identifier": "고객 고유 식별자",
    "Reference date for features/label": "피처와 타깃 산출 기준일",
    "Customer region": "고객 지역",
    "Customer age (years)": "고객 나이(연 단위)",
    "Age band bucket": "연령대 구간",
    "Marital status": "혼인 상태",
    "Tenure with insurer in months": "보험사 거래 기간(개월)",
    "1 if customer holds multiple policies, else 0": "여러 보험을 보유하면 1, 아니면 0",
    "Number of policies held by customer (synthetic)": "고객 보유 보험 수(합성 데이터)",
    "Primary policy type": "주요 보험 상품 유형",
    "Policy renewal month (1-12)": "보험 갱신 월(1-12)",
    "Current annualised premium amount (NZD)": "현재 연간 환산 보험료(NZD)",
    "Prior year annualised premium amount (NZD)": "전년도 연간 환산 보험료(NZD)",
    "Premium change percentage vs last year": "전년 대비 보험료 변동률",
    "Count of premium increases in last 3 years (synthetic)": "최근 3년간 보험료 인상 횟수(합성 데이터)",
    "Coverage amount / sum insured (NZD)": "보장 금액 / 가입 금액(NZD)",
    "Premium divided by coverage amount": "보장 금액 대비 보험료 비율",
    "Payment frequency (Monthly/Annual)": "납입 주기(월납/연납)",
    "1 if autopay enabled, else 0": "자동이체 사용 시 1, 아니면 0",
    "Count of late payments in last 12 months": "최근 12개월 연체 횟수",
    "1 if missed payments flag (>=4 late payments), else 0": "미납 위험 플래그(연체 4회 이상이면 1, 아니면 0)",
    "1 if payment method changed recently, else 0": "최근 결제수단 변경 시 1, 아니면 0",
    "Number of claims in last 12 months": "최근 12개월 청구 건수",
    "Number of approved claims in last 12 months": "최근 12개월 승인된 청구 건수",
    "Number of rejected claims in last 12 months": "최근 12개월 거절된 청구 건수",
    "Number of pending claims in last 12 months": "최근 12개월 처리 대기 청구 건수",
    "Average claim amount (NZD)": "평균 청구 금액(NZD)",
    "Total claim amount in last 12 months (NZD)": "최근 12개월 총 청구 금액(NZD)",
    "Total payout amount in last 12 months (NZD)": "최근 12개월 총 지급 금액(NZD)",
    "Total payout divided by total claim amount (last 12 months)": "총 지급 금액 / 총 청구 금액 비율(최근 12개월)",
    "Average settlement time for claims (days)": "청구 평균 처리 기간(일)",
    "Days since last claim (proxy recency)": "마지막 청구 이후 경과 일수",
    "Number of customer contacts in last 12 months": "최근 12개월 고객 접촉 횟수",
    "1 if complaint lodged, else 0": "민원 접수 시 1, 아니면 0",
    "Complaint resolution time in days (0 if no complaint)": "민원 처리 소요 일수(민원 없으면 0)",
    "1 if customer requested a quote (proxy shopping), else 0": "견적 요청 이력이 있으면 1, 아니면 0",
    "1 if customer downgraded coverage, else 0": "보장 축소 이력이 있으면 1, 아니면 0",
    "Target label: 1 = churned at renewal, 0 = retained": "타깃 라벨: 갱신 시 이탈이면 1, 유지면 0",
    "Heuristic churn reason (synthetic)": "휴리스틱 기반 이탈 사유(합성 데이터)",
    "Underlying churn probability used to generate labels (drop before upload if desired)":
        "라벨 생성용 내부 이탈 확률",
}


def column_dictionary(spark: SparkSession) -> DataFrame:
    """C12 lookup: (column, description, description_ko); unknown descriptions pass through."""
    rows = [(c, d, DESCRIPTION_KO.get(d, d)) for c, d in COLUMN_DESCRIPTIONS]
    return spark.createDataFrame(rows, "column string, description string, description_ko string")


def tier_labels(spark: SparkSession) -> DataFrame:
    """(risk_tier, risk_tier_ko, tier_order) for all four tiers."""
    return spark.createDataFrame([(t, TIER_LABELS_KO[t], i) for i, t in enumerate(TIERS)],
                                 "risk_tier string, risk_tier_ko string, tier_order int")
