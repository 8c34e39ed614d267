"""Scored table, KPIs, dashboards and watchlists (survey R6-R17, W1-W4).

The scored table is the policyholder table plus six columns. Everything after
it is a filter, a one-pass conditional aggregate, or a top-n report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.functions.scoring import DEFAULT_THRESHOLD, TIERS, add_score_columns
from churnlab.operators.ranking import global_row_number
from churnlab.sources.lookups import tier_labels

SCORED_EXTRA = ["churn_probability", "predicted_churn", "risk_tier", "risk_tier_ko", "prediction_reason",
                "coupon_priority"]


def add_coupon_priority(df: DataFrame, prob_col: str = "churn_probability") -> DataFrame:
    """Dense global rank by probability (desc), ties by customer id: range
    partitioned numbering, never a single-partition window."""
    return global_row_number(df, [F.col(prob_col).desc(), F.col("customer_id").asc()], "coupon_priority")


def score_table(df: DataFrame, score_col: str = "churn_probability_true",
                threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """R6 with a given probability column (deterministic twin of model scoring)."""
    return add_coupon_priority(add_score_columns(df, score_col, threshold))


def score_with_model(df: DataFrame, model, threshold: float) -> DataFrame:
    """Feature frame -> fitted ``PipelineModel`` -> probability of class 1 ->
    class, tier, label, reason, priority. The model sees only feature columns;
    the raw columns ride along in the same rows (no join back)."""
    from pyspark.ml.functions import vector_to_array

    feats = fx.add_engineered_features(df)
    pred = model.transform(feats)
    prob = vector_to_array(F.col("probability"))[1]
    scored = pred.select(*df.columns, prob.alias("_p"))
    return add_coupon_priority(add_score_columns(scored, "_p", threshold).drop("_p"))


def sort_scored(df: DataFrame) -> DataFrame:
    """Predicted first, then probability, both descending (ties by id)."""
    return df.orderBy(F.col("predicted_churn").desc(), F.col("churn_probability").desc(), "customer_id")


def kpi_summary(df: DataFrame) -> DataFrame:
    """R8 (+ R16 expected-to-stay)."""
    tier = F.col("risk_tier")
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("predicted_churn").cast("long").alias("predicted_churn_customers"),
        F.count_if(tier == "critical").alias("critical_customers"),
        F.count_if(tier == "high").alias("high_customers"),
        F.count_if(tier == "watch").alias("watch_customers"),
    ).withColumn("expected_to_stay", F.col("total_customers") - F.col("predicted_churn_customers"))


def home_kpis(df: DataFrame) -> DataFrame:
    """R9."""
    tier = F.col("risk_tier")
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(tier == "critical").alias("critical_customers"),
        F.round(F.try_divide(F.count_if(tier.isin("high", "critical")) * 100.0, F.count(F.lit(1))), 6)
         .alias("high_risk_rate_pct"),
        F.count_if(tier == "stable").alias("stable_customers"),
    )


def age_band_kpis(df: DataFrame) -> DataFrame:
    """Predicted-churn % and high-risk % per age band."""
    return df.where(F.col("age_band").isNotNull()).groupBy("age_band").agg(
        F.round(F.avg("predicted_churn") * 100, 6).alias("avg_churn_pct"),
        F.round(F.avg(fx.flag(F.col("risk_tier").isin("high", "critical"))) * 100, 6).alias("avg_high_risk_pct"))


def customers_per_product(df: DataFrame) -> DataFrame:
    """R11."""
    return df.where(F.col("policy_type").isNotNull()).groupBy("policy_type").agg(
        F.count(F.lit(1)).alias("customers"))


def old_home_kpis(df: DataFrame) -> DataFrame:
    """Total, churn rate (label), high-risk count by the 3-level bin of the
    generating probability."""
    return df.agg(F.count(F.lit(1)).alias("total_customers"),
                  F.round(F.avg("churn_flag"), 6).alias("churn_rate"),
                  F.count_if(fx.risk_level_3("churn_probability_true") == fx.RISK_LEVELS_3[2]).alias("high_risk"))


def tier_distribution(df: DataFrame) -> DataFrame:
    """Count and share per tier; all four tiers always listed."""
    counts = df.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (F.broadcast(tier_labels(df.sparkSession)).join(counts, "risk_tier", "left")
            .crossJoin(F.broadcast(total))
            .select("risk_tier", "risk_tier_ko", "tier_order",
                    F.coalesce("customers", F.lit(0)).cast("long").alias("customers"),
                    F.round(F.coalesce(F.try_divide(F.col("customers") * 100.0, F.col("_total")), F.lit(0.0)), 2)
                     .alias("pct")))


# Tier insight sentences (numbers filled in with one decimal).
INSIGHT_TEMPLATES = {
    "critical": "보험료 변동({prem}%)과 타사 견적 요청({quote}%)이 결합된 이탈 직전 단계입니다.",
    "high": "민원 발생률({comp}%)이 상대적으로 높으며 가격 민감도가 상승 중입니다.",
    "watch": "이탈 징후가 낮으나 견적 요청({quote}%) 등의 간접 신호가 관측됩니다.",
    "stable": "변동성이 낮으며 서비스 만족도가 유지되고 있는 층입니다.",
}
INSIGHT_EMPTY = "해당 그룹의 데이터가 없습니다."


def one_decimal(x: Column) -> Column:
    """Half-up to one decimal, then printed."""
    return F.format_string("%.1f", F.round(F.round(x, 9), 1))


def tier_insight(df: DataFrame) -> DataFrame:
    """Per tier mean premium change %, complaint %, quote % and the sentence."""
    agg = df.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("customers"),
        (F.avg("premium_change_pct") * 100).alias("prem"),
        (F.avg("complaint_flag") * 100).alias("comp"),
        (F.avg("quote_requested_flag") * 100).alias("quote"))
    t = F.broadcast(tier_labels(df.sparkSession)).join(agg, "risk_tier", "left")
    prem, comp, quote = (F.coalesce(one_decimal(F.col(c)), F.lit("nan")) for c in ("prem", "comp", "quote"))

    def fill(tpl: str) -> Column:
        parts, rest = [], tpl
        for key, val in (("{prem}", prem), ("{comp}", comp), ("{quote}", quote)):
            if key in rest:
                a, rest = rest.split(key, 1)
                parts += [F.lit(a), val]
        return F.concat(*parts, F.lit(rest))

    sentence = F.when(F.col("customers").isNull(), F.lit(INSIGHT_EMPTY))
    for tier in TIERS:
        sentence = sentence.when(F.col("risk_tier") == tier, fill(INSIGHT_TEMPLATES[tier]))
    return t.select("risk_tier", "tier_order", F.coalesce("customers", F.lit(0)).cast("long").alias("customers"),
                    F.round("prem", 9).alias("premium_change_mean_pct"), F.round("comp", 9).alias("complaint_pct"),
                    F.round("quote", 9).alias("quote_pct"), sentence.alias("insight"))


def keyword_filter(df: DataFrame, keyword: str | None, scope: str = "all") -> DataFrame:
    """Trimmed, case-insensitive regex search over id and/or region."""
    if not keyword or not keyword.strip():
        return df
    pattern = "(?i)" + keyword.strip()
    by_id = F.col("customer_id").cast("string").rlike(pattern)
    by_region = F.col("region_name").cast("string").rlike(pattern)
    cond = {"all": by_id | by_region, "id": by_id, "region": by_region}[scope]
    return df.where(F.coalesce(cond, F.lit(False)))


# Display headings of the two watchlists.
WATCHLIST_A_HEADINGS = ["우선순위", "고객 ID", "지역", "나이", "상품 유형", "가입기간", "현재 보험료",
                        "예측 이탈확률", "위험등급", "예측 사유"]
WATCHLIST_B_HEADINGS = {"coupon_priority": "우선순위", "customer_id": "고객 ID", "region_name": "지역",
                        "policy_type": "상품 유형", "current_premium": "현재 보험료",
                        "churn_probability": "이탈 예상 확률(%)", "risk_tier_ko": "위험 등급",
                        "prediction_reason": "이탈 예상 이유"}


def watchlist_a(df: DataFrame, predicted_only: bool = True, keyword: str | None = None, scope: str = "all",
                tier_ko: str | None = None) -> DataFrame:
    """Filters, then formatted display columns."""
    out = df
    if predicted_only:
        out = out.where(F.col("predicted_churn") == 1)
    out = keyword_filter(out, keyword, scope)
    if tier_ko:
        out = out.where(F.col("risk_tier_ko") == tier_ko)
    cols = [
        F.col("coupon_priority"), F.col("customer_id"), F.col("region_name"), F.col("age"), F.col("policy_type"),
        F.concat(one_decimal(F.col("customer_tenure_months") / 12.0), F.lit("년")),
        F.concat(F.format_number(F.col("current_premium").cast("long"), 0), F.lit("원")),
        F.round(F.col("churn_probability") * 100, 1), F.col("risk_tier_ko"), F.col("prediction_reason"),
    ]
    return out.select(*[c.alias(h) for c, h in zip(cols, WATCHLIST_A_HEADINGS)])


def watchlist_b(df: DataFrame, predicted_only: bool = True, tier_ko: str | None = None,
                policy_type: str | None = None, region: str | None = None, keyword: str | None = None,
                top_n: int = 100) -> DataFrame:
    """Filters in the scored order, first ``top_n`` rows (the feature), renamed."""
    out = df
    if predicted_only:
        out = out.where(F.col("predicted_churn") == 1)
    if tier_ko:
        out = out.where(F.col("risk_tier_ko") == tier_ko)
    if policy_type:
        out = out.where(F.col("policy_type") == policy_type)
    if region:
        out = out.where(F.col("region_name") == region)
    out = keyword_filter(out, keyword, "all")
    top = sort_scored(out).limit(top_n)
    return top.select(
        *[(F.round("current_premium", 0).cast("long") if c == "current_premium"
           else F.round(F.col(c) * 100, 2) if c == "churn_probability" else F.col(c)).alias(h)
          for c, h in WATCHLIST_B_HEADINGS.items()])


def export_csv(df: DataFrame, path: str) -> None:
    """IO6: header CSV export (UTF-8)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def top_by_probability(df: DataFrame, n: int = 30) -> DataFrame:
    """Top-n preview by probability (ties by id)."""
    cols = [c for c in ["customer_id", "churn_probability", "risk_tier_ko", "premium_change_pct",
                        "prediction_reason"] if c in df.columns]
    return df.orderBy(F.col("churn_probability").desc(), "customer_id").limit(n).select(*cols)
