"""Catalogue: scored table, KPIs, dashboards, watchlists (survey R, W1-W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab.functions.scoring import DEFAULT_THRESHOLD
from churnlab.operators import scoring as so
from churnlab.plans.oracle_base import with_ctes
from churnlab.plans.registry import register
from churnlab.plans.sql_fragments import q, scored_cte
from churnlab.session import materialize, memo, memo_key
from churnlab.sources.fixture import policyholders

_SCORED: dict = memo()


def scored(spark, d):
    """Scored policyholders (fixture probability as the score, t = 0.20),
    checkpointed once per session and folder."""
    key = memo_key(spark, d)
    if key not in _SCORED:
        _SCORED[key] = materialize(so.score_table(policyholders(spark, d), "churn_probability_true",
                                                  DEFAULT_THRESHOLD))
    return _SCORED[key]


SC = scored_cte()


def S(body: str, *extra: str) -> str:
    return with_ctes(body, SC, *extra)


@register("r06_scored_table", S("SELECT * FROM scored"))
def q_r06(spark, d):
    return scored(spark, d)


@register("w01_coupon_priority", S("SELECT customer_id, churn_probability, coupon_priority FROM scored"))
def q_w01(spark, d):
    return scored(spark, d).select("customer_id", "churn_probability", "coupon_priority")


@register("w02_sorted_scored", S("SELECT customer_id, predicted_churn, churn_probability FROM scored"))
def q_w02(spark, d):
    return so.sort_scored(scored(spark, d)).select("customer_id", "predicted_churn", "churn_probability")


@register("w03_top30_by_probability", S(
    "SELECT customer_id, churn_probability, risk_tier_ko, premium_change_pct, prediction_reason FROM scored"
    " ORDER BY churn_probability DESC, customer_id LIMIT 30"))
def q_w03(spark, d):
    return so.top_by_probability(scored(spark, d), 30)


@register("r08_kpi_summary", S(
    "SELECT count(*) AS total_customers, CAST(sum(predicted_churn) AS BIGINT) AS predicted_churn_customers,"
    " count(*) FILTER (WHERE risk_tier = 'critical') AS critical_customers,"
    " count(*) FILTER (WHERE risk_tier = 'high') AS high_customers,"
    " count(*) FILTER (WHERE risk_tier = 'watch') AS watch_customers,"
    " count(*) - CAST(sum(predicted_churn) AS BIGINT) AS expected_to_stay FROM scored"))
def q_r08(spark, d):
    return so.kpi_summary(scored(spark, d))


@register("r09_home_kpis", S(
    "SELECT count(*) AS total_customers, count(*) FILTER (WHERE risk_tier = 'critical') AS critical_customers,"
    " round(count(*) FILTER (WHERE risk_tier IN ('high', 'critical')) * 100.0e0 / count(*), 6) AS high_risk_rate_pct,"
    " count(*) FILTER (WHERE risk_tier = 'stable') AS stable_customers FROM scored"))
def q_r09(spark, d):
    return so.home_kpis(scored(spark, d))


@register("r10_age_band_kpis", S(
    "SELECT age_band, round(avg(predicted_churn) * 100, 6) AS avg_churn_pct,"
    " round(avg(CAST(risk_tier IN ('high', 'critical') AS INTEGER)) * 100, 6) AS avg_high_risk_pct"
    " FROM scored WHERE age_band IS NOT NULL GROUP BY age_band"))
def q_r10(spark, d):
    return so.age_band_kpis(scored(spark, d))


@register("r11_customers_per_product", S(
    "SELECT policy_type, count(*) AS customers FROM scored WHERE policy_type IS NOT NULL GROUP BY policy_type"))
def q_r11(spark, d):
    return so.customers_per_product(scored(spark, d))


@register("r12_old_home_kpis", with_ctes(
    "SELECT count(*) AS total_customers, round(avg(churn_flag), 6) AS churn_rate,"
    f" count(*) FILTER (WHERE churn_probability_true > 0.7e0 AND churn_probability_true <= 1.0e0) AS high_risk"
    " FROM policyholders"))
def q_r12(spark, d):
    return so.old_home_kpis(policyholders(spark, d))


_TIERS_VALUES = "(VALUES ('critical', '즉시 대응', 0), ('high', '고위험', 1), ('watch', '관찰 필요', 2), ('stable', '안정', 3))" \
                " t(risk_tier, risk_tier_ko, tier_order)"


@register("r13_tier_distribution", S(
    f"SELECT t.risk_tier, t.risk_tier_ko, CAST(t.tier_order AS INTEGER) AS tier_order,"
    " CAST(coalesce(c.customers, 0) AS BIGINT) AS customers,"
    " round(coalesce(c.customers * 100.0e0 / (SELECT count(*) FROM scored), 0.0e0), 2) AS pct"
    f" FROM {_TIERS_VALUES} LEFT JOIN (SELECT risk_tier, count(*) AS customers FROM scored GROUP BY risk_tier) c"
    " ON t.risk_tier = c.risk_tier"))
def q_r13(spark, d):
    return so.tier_distribution(scored(spark, d))


def _od(x: str) -> str:
    return f"coalesce(printf('%.1f', round(round({x}, 9), 1)), 'nan')"


def _insight_sql() -> str:
    def fill(tpl):
        out = q(tpl)
        for key, col in (("{prem}", "a.prem"), ("{comp}", "a.comp"), ("{quote}", "a.quote")):
            out = f"replace({out}, {q(key)}, {_od(col)})"
        return out
    cases = " ".join(f"WHEN t.risk_tier = {q(k)} THEN {fill(v)}" for k, v in so.INSIGHT_TEMPLATES.items())
    return (f"SELECT t.risk_tier, CAST(t.tier_order AS INTEGER) AS tier_order,"
            f" CAST(coalesce(a.customers, 0) AS BIGINT) AS customers, round(a.prem, 9) AS premium_change_mean_pct,"
            f" round(a.comp, 9) AS complaint_pct, round(a.quote, 9) AS quote_pct,"
            f" CASE WHEN a.customers IS NULL THEN {q(so.INSIGHT_EMPTY)} {cases} END AS insight"
            f" FROM {_TIERS_VALUES} LEFT JOIN (SELECT risk_tier, count(*) AS customers,"
            " avg(premium_change_pct) * 100 AS prem, avg(complaint_flag) * 100 AS comp,"
            " avg(quote_requested_flag) * 100 AS quote FROM scored GROUP BY risk_tier) a ON t.risk_tier = a.risk_tier")


@register("r14_tier_insight", S(_insight_sql()))
def q_r14(spark, d):
    return so.tier_insight(scored(spark, d))


def _wa_sql(where: str) -> str:
    h = so.WATCHLIST_A_HEADINGS
    return (f"SELECT coupon_priority AS \"{h[0]}\", customer_id AS \"{h[1]}\", region_name AS \"{h[2]}\","
            f" age AS \"{h[3]}\", policy_type AS \"{h[4]}\","
            f" {_od('customer_tenure_months / 12.0e0')} || '년' AS \"{h[5]}\","
            f" CASE WHEN current_premium IS NOT NULL THEN format('{{:,}}', trunc(current_premium)::BIGINT) || '원' END"
            f" AS \"{h[6]}\", round(churn_probability * 100, 1) AS \"{h[7]}\", risk_tier_ko AS \"{h[8]}\","
            f" prediction_reason AS \"{h[9]}\" FROM scored WHERE {where}")


@register("r15_watchlist_a", S(_wa_sql("predicted_churn = 1")))
def q_r15(spark, d):
    return so.watchlist_a(scored(spark, d))


@register("r15_watchlist_a_keyword", S(_wa_sql(
    "predicted_churn = 1 AND (regexp_matches(CAST(customer_id AS VARCHAR), 'asia', 'i')"
    " OR regexp_matches(CAST(region_name AS VARCHAR), 'asia', 'i')) AND risk_tier_ko = '고위험'")))
def q_r15k(spark, d):
    return so.watchlist_a(scored(spark, d), keyword="  asia ", scope="all", tier_ko="고위험")


@register("r15_watchlist_a_region_scope", S(_wa_sql(
    "predicted_churn = 1 AND regexp_matches(CAST(region_name AS VARCHAR), 'EUR', 'i')")))
def q_r15r(spark, d):
    return so.watchlist_a(scored(spark, d), keyword="eur", scope="region")


def _wb_sql(where: str, n: int) -> str:
    cols = []
    for c, h in so.WATCHLIST_B_HEADINGS.items():
        e = ("CAST(round(current_premium, 0) AS BIGINT)" if c == "current_premium"
             else "round(churn_probability * 100, 2)" if c == "churn_probability" else c)
        cols.append(f"{e} AS \"{h}\"")
    return (f"SELECT {', '.join(cols)} FROM scored WHERE {where}"
            f" ORDER BY predicted_churn DESC, churn_probability DESC, customer_id LIMIT {n}")


@register("r17_watchlist_b", S(_wb_sql("predicted_churn = 1", 100)))
def q_r17(spark, d):
    return so.watchlist_b(scored(spark, d), top_n=100)


@register("r17_watchlist_b_filtered", S(_wb_sql(
    "policy_type = 'Auto' AND region_name = 'EUROPE' AND (regexp_matches(CAST(customer_id AS VARCHAR), 'customer', 'i')"
    " OR regexp_matches(CAST(region_name AS VARCHAR), 'customer', 'i'))", 20)))
def q_r17f(spark, d):
    return so.watchlist_b(scored(spark, d), predicted_only=False, policy_type="Auto", region="EUROPE",
                          keyword="customer", top_n=20)


@register("r17_watchlist_b_csv_export", S(_wb_sql("predicted_churn = 1", 100)))
def q_r17csv(spark, d):
    """IO6: the watchlist exported as header CSV (UTF-8) and read back with its schema."""
    from churnlab.sources import io
    wl = so.watchlist_b(scored(spark, d), top_n=100)
    path = io.scratch_path(spark, "watchlist")
    io.export_watchlist_csv(wl, path)
    return spark.read.schema(wl.schema).option("header", True).csv(path)


@register("io04_scored_roundtrip", S("SELECT * FROM scored"))
def q_io04(spark, d):
    """IO4/IO5: the scored table written as Parquet and read back."""
    from churnlab.sources import io
    path = io.scratch_path(spark, "scored-copy")
    io.write_scored(scored(spark, d), path)
    return io.read_scored(spark, path)


@register("c14_distinct_tiers", S("SELECT DISTINCT risk_tier_ko FROM scored WHERE risk_tier_ko IS NOT NULL"))
def q_c14t(spark, d):
    from churnlab.operators.clean import distinct_values
    return distinct_values(scored(spark, d), "risk_tier_ko")


@register("r07_incremental_priority", with_ctes(
    "SELECT customer_id, batch, row_number() OVER (ORDER BY churn_probability_true DESC, customer_id) AS coupon_priority"
    " FROM (SELECT *, CAST('0x' || substr(md5(customer_id), 1, 7) AS BIGINT) % 3 AS batch FROM policyholders)"))
def q_r07i(spark, d):
    """Three batches written one after the other; priorities of all rows from the merged score histograms."""
    from churnlab.sources import io
    from churnlab.streaming import rescoring
    sink, p = io.scratch_path(spark, "refresh"), policyholders(spark, d)
    number = F.conv(F.substring(F.md5("customer_id"), 1, 7), 16, 10).cast("long") % 3
    for batch in range(3):
        rescoring.write_batch(p.where(number == batch), batch, sink)
    return rescoring.priorities(spark, sink).select("customer_id", F.col("batch").cast("long").alias("batch"), "coupon_priority")
