"""Catalogue: churn-rate breakdowns and statistics (survey A1-A39)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import rates, stats
from churnlab.operators.clean import clip_policies
from churnlab.plans.oracle_base import with_ctes
from churnlab.plans.registry import register
from churnlab.plans.sql_fragments import (ANALYSIS_SQL, FEATURES_CTE, HYP_SQL, INCREASE_LABEL_SQL, PAYOUT_GROUP_SQL,
                                          PREMIUM_BIN_SQL, flag, q)
from churnlab.sources.fixture import policyholders

PH = policyholders


def rate_sql(keys: list[tuple[str, str]], source: str = "policyholders", where: str = "") -> str:
    """SQL twin of ``rates.rate``: keys are (sql expression, output name)."""
    sel = ", ".join(f"{e} AS {n}" for e, n in keys)
    names = ", ".join(n for _, n in keys)
    nn = " AND ".join(f"{n} IS NOT NULL" for _, n in keys)
    w = f"WHERE {where}" if where else ""
    return (f"SELECT {names}, count(*) AS customers, CAST(sum(churn_flag) AS BIGINT) AS churned,"
            f" round(avg(churn_flag), 6) AS churn_rate"
            f" FROM (SELECT {sel}, churn_flag FROM {source} {w}) t WHERE {nn} GROUP BY {names}")


def levels_sql(key_expr: str, name: str, levels: list[str], source: str = "policyholders", where: str = "") -> str:
    vals = ", ".join(f"({q(v)}, {i})" for i, v in enumerate(levels))
    return (f"SELECT lv.{name}, CAST(lv.level_order AS INTEGER) AS level_order,"
            f" CAST(coalesce(r.customers, 0) AS BIGINT) AS customers, CAST(coalesce(r.churned, 0) AS BIGINT) AS churned,"
            f" r.churn_rate FROM (VALUES {vals}) lv({name}, level_order)"
            f" LEFT JOIN ({rate_sql([(key_expr, name)], source, where)}) r ON lv.{name} = r.{name}")


def simple_rate(name: str, key: str, where_spark=None, where_sql: str = ""):
    """Register a one-key rate query on a policyholder column."""
    def fn(spark, d):
        df = PH(spark, d)
        if where_spark is not None:
            df = df.where(where_spark())
        return rates.rate(df, [key])
    register(name, with_ctes(rate_sql([(key, key)], where=where_sql)))(fn)


# A1 ------------------------------------------------------------------------
@register("a01_rate_by_premium_increase", with_ctes(
    "SELECT *, CASE WHEN premium_increased_label = 'Increase' THEN 1 ELSE 0 END AS label_order,"
    " round(churn_rate * 100, 2) AS churn_rate_pct FROM ("
    + rate_sql([(INCREASE_LABEL_SQL, "premium_increased_label")]) + ")"))
def q_a01(spark, d):
    return rates.rate_by_premium_increase(PH(spark, d))


@register("a02_rate_by_premium_change_bin", with_ctes(
    levels_sql(PREMIUM_BIN_SQL, "premium_change_bin", fx.PREMIUM_CHANGE_BINS)))
def q_a02(spark, d):
    return rates.rate_by_premium_change_bin(PH(spark, d))


simple_rate("a03_rate_by_price_increases", "num_price_increases_last_3y")


@register("a04_rate_by_policy_and_increase", with_ctes(
    rate_sql([("policy_type", "policy_type"), (INCREASE_LABEL_SQL, "premium_increased_label")])))
def q_a04(spark, d):
    return rates.rate(PH(spark, d), ["policy_type", fx.premium_increased_label().alias("premium_increased_label")])


_INC = [fx.INCREASE_LABELS[0], fx.INCREASE_LABELS[1]]


@register("a05_pivot_policy_by_increase", with_ctes(
    "SELECT policy_type, " + ", ".join(
        f"round(avg(churn_flag) FILTER (WHERE lbl = {q(v)}) * 100, 2) AS \"{v}\"" for v in _INC)
    + f" FROM (SELECT policy_type, {INCREASE_LABEL_SQL} AS lbl, churn_flag FROM policyholders)"
    " WHERE policy_type IS NOT NULL GROUP BY policy_type"))
def q_a05(spark, d):
    df = PH(spark, d).withColumn("lbl", fx.premium_increased_label())
    return rates.pivot_rate(df, "policy_type", "lbl", _INC, scale=100.0, digits=2)


def _a06_sections():
    label = fx.premium_increased_label()
    return [("premium_increase", [label]), ("premium_change_bin", [fx.premium_change_bin()]),
            ("price_increases", [F.col("num_price_increases_last_3y")]), ("policy_x_increase", [F.col("policy_type"), label])]


def _a06_sql():
    parts = [
        ("premium_increase", rate_sql([(INCREASE_LABEL_SQL, "k")]), "CAST(k AS VARCHAR)"),
        ("premium_change_bin", rate_sql([(PREMIUM_BIN_SQL, "k")]), "CAST(k AS VARCHAR)"),
        ("price_increases", rate_sql([("num_price_increases_last_3y", "k")]), "CAST(k AS VARCHAR)"),
        ("policy_x_increase", rate_sql([("policy_type", "p"), (INCREASE_LABEL_SQL, "k")]),
         "concat_ws(' / ', p, k)"),
    ]
    return " UNION ALL ".join(
        f"SELECT {q(s)} AS section, {key} AS group_key, customers, churned, churn_rate FROM ({body})"
        for s, body, key in parts)


@register("a06_premium_summary", with_ctes(_a06_sql()))
def q_a06(spark, d):
    return rates.stacked_rates(PH(spark, d), _a06_sections())


simple_rate("a07_rate_by_age_band", "age_band")


@register("a08_rate_by_age_band_quote", with_ctes(
    rate_sql([("age_band", "age_band"), ("quote_requested_flag", "quote_requested_flag")])))
def q_a08(spark, d):
    return rates.rate(PH(spark, d), ["age_band", "quote_requested_flag"])


@register("a09_quote_rate_by_age_band", with_ctes(
    "SELECT age_band, count(*) AS customers, round(avg(quote_requested_flag), 6) AS quote_rate"
    " FROM policyholders WHERE age_band IS NOT NULL GROUP BY age_band"))
def q_a09(spark, d):
    return rates.rate(PH(spark, d), ["age_band"], label="quote_requested_flag").select(
        "age_band", "customers", F.col("churn_rate").alias("quote_rate"))


def _box_sql(value, keys):
    k = ", ".join(keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in [value] + keys)
    on = " AND ".join(f"b.{c} = qq.{c}" for c in keys)
    return f"""SELECT {', '.join('qq.' + c for c in keys)}, qq.n, round(qq.q1, 9) AS q1, round(qq.median, 9) AS median,
  round(qq.q3, 9) AS q3, round(qq.q3 - qq.q1, 9) AS iqr,
  round(min(b.{value}) FILTER (WHERE b.{value} >= qq.q1 - 1.5e0 * (qq.q3 - qq.q1)), 9) AS whisker_low,
  round(max(b.{value}) FILTER (WHERE b.{value} <= qq.q3 + 1.5e0 * (qq.q3 - qq.q1)), 9) AS whisker_high,
  count(*) FILTER (WHERE b.{value} < qq.q1 - 1.5e0 * (qq.q3 - qq.q1) OR b.{value} > qq.q3 + 1.5e0 * (qq.q3 - qq.q1))
    AS outliers
FROM (SELECT * FROM policyholders WHERE {nn}) b
JOIN (SELECT {k}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
             quantile_cont({value}, 0.75) AS q3, count(*) AS n
      FROM policyholders WHERE {nn} GROUP BY {k}) qq ON {on}
GROUP BY {', '.join('qq.' + c for c in keys)}, qq.n, qq.q1, qq.median, qq.q3"""


@register("a10_box_premium_change_by_age_churn", with_ctes(
    _box_sql("premium_change_pct", ["age_band", "churn_flag"])))
def q_a10(spark, d):
    return stats.box_stats(PH(spark, d), "premium_change_pct", ["age_band", "churn_flag"])


simple_rate("a11_rate_by_missed_payment", "missed_payment_flag")
simple_rate("a11_rate_by_autopay", "autopay_enabled")
simple_rate("a12_rate_by_multi_policy", "multi_policy_flag")
simple_rate("a13_rate_by_num_policies", "num_policies")


@register("a13_rate_by_num_policies_capped", with_ctes(
    rate_sql([("CAST(least(num_policies, 10) AS INTEGER)", "num_policies")])))
def q_a13c(spark, d):
    return rates.rate(clip_policies(PH(spark, d)), ["num_policies"])


@register("a14_rate_by_auto_home_potential", with_ctes(
    rate_sql([(ANALYSIS_SQL["has_auto_home_potential"], "has_auto_home_potential")])))
def q_a14(spark, d):
    return rates.rate(PH(spark, d), [fx.analysis_feature_exprs()["has_auto_home_potential"]
                                     .alias("has_auto_home_potential")])


@register("a15_multi_group_vs_overall", with_ctes(
    "SELECT g.*, o.overall_rate, round(g.churn_rate - o.overall_rate, 6) AS diff_vs_overall FROM ("
    + rate_sql([(ANALYSIS_SQL["multi_policy_group"], "multi_policy_group")], where="multi_policy_flag = 1")
    + ") g CROSS JOIN (SELECT round(avg(churn_flag), 6) AS overall_rate FROM policyholders) o"))
def q_a15(spark, d):
    return rates.multi_group_vs_overall(PH(spark, d))


@register("a16_policy_counts_in_multi", with_ctes(
    "SELECT policy_type, count(*) AS count FROM policyholders WHERE multi_policy_flag = 1"
    " AND policy_type IS NOT NULL GROUP BY policy_type"))
def q_a16(spark, d):
    return (PH(spark, d).where((F.col("multi_policy_flag") == 1) & F.col("policy_type").isNotNull())
            .groupBy("policy_type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc()))


simple_rate("a17_rate_by_tenure_month", "customer_tenure_months")
simple_rate("a17_rate_first_12_months", "customer_tenure_months",
            where_spark=lambda: F.col("customer_tenure_months") <= 12, where_sql="customer_tenure_months <= 12")


@register("a18_tenure_window_rates", with_ctes(
    "SELECT count(*) FILTER (WHERE customer_tenure_months <= 6) AS customers_le6,"
    " round(avg(churn_flag) FILTER (WHERE customer_tenure_months <= 6), 6) AS rate_le6,"
    " count(*) FILTER (WHERE customer_tenure_months <= 12) AS customers_le12,"
    " round(avg(churn_flag) FILTER (WHERE customer_tenure_months <= 12), 6) AS rate_le12,"
    " count(*) FILTER (WHERE customer_tenure_months > 12) AS customers_gt12,"
    " round(avg(churn_flag) FILTER (WHERE customer_tenure_months > 12), 6) AS rate_gt12 FROM policyholders"))
def q_a18(spark, d):
    return rates.tenure_window_rates(PH(spark, d))


simple_rate("a19_rate_by_contacts", "num_contacts_12m")
simple_rate("a20_rate_by_complaint", "complaint_flag")


@register("a21_rate_by_rejected_claim", with_ctes(
    rate_sql([(ANALYSIS_SQL["is_rejected"], "is_rejected")], where="num_claims_12m > 0")))
def q_a21(spark, d):
    df = PH(spark, d).where(F.col("num_claims_12m") > 0)
    return rates.rate(df, [fx.is_rejected().alias("is_rejected")])


@register("a21_rate_by_payout_group", with_ctes(
    levels_sql(PAYOUT_GROUP_SQL, "payout_group", fx.PAYOUT_GROUPS, where="num_claims_12m > 0")))
def q_a21b(spark, d):
    df = PH(spark, d).where(F.col("num_claims_12m") > 0).withColumn("payout_group", fx.payout_group())
    return rates.rate_with_levels(df, "payout_group", fx.PAYOUT_GROUPS)


@register("a21_rejected_ratio", with_ctes(
    "SELECT round(avg(churn_flag) FILTER (WHERE num_rejected_claims_12m > 0), 6) AS rate_rejected,"
    " round(avg(churn_flag) FILTER (WHERE NOT coalesce(num_rejected_claims_12m > 0, false)), 6) AS rate_not_rejected,"
    " round(avg(churn_flag) FILTER (WHERE num_rejected_claims_12m > 0)"
    " / avg(churn_flag) FILTER (WHERE NOT coalesce(num_rejected_claims_12m > 0, false)), 6) AS ratio"
    " FROM policyholders WHERE num_claims_12m > 0"))
def q_a21c(spark, d):
    df = PH(spark, d).where(F.col("num_claims_12m") > 0)
    rej = fx.is_rejected() == 1
    a = F.avg(F.when(rej, F.col("churn_flag")))
    b = F.avg(F.when(~rej, F.col("churn_flag")))
    return df.agg(F.round(a, 6).alias("rate_rejected"), F.round(b, 6).alias("rate_not_rejected"),
                  F.round(F.try_divide(a, b), 6).alias("ratio"))


simple_rate("a22_rate_by_marital", "marital_status")


@register("a23_rate_by_policy_marital", with_ctes(
    rate_sql([("policy_type", "policy_type"), ("marital_status", "marital_status")])))
def q_a23(spark, d):
    return rates.rate(PH(spark, d), ["policy_type", "marital_status"])


@register("a24_rate_by_marital_policy_age", with_ctes(
    rate_sql([("marital_status", "marital_status"), ("policy_type", "policy_type"), ("age_band", "age_band")])))
def q_a24(spark, d):
    return rates.rate(PH(spark, d), ["marital_status", "policy_type", "age_band"])


@register("a24_grouping_sets", with_ctes(
    "SELECT marital_status, policy_type, age_band,"
    " CAST(GROUPING(marital_status, policy_type, age_band) AS BIGINT) AS grouping_id,"
    " count(*) AS customers, CAST(sum(churn_flag) AS BIGINT) AS churned, round(avg(churn_flag), 6) AS churn_rate"
    " FROM policyholders GROUP BY GROUPING SETS ((marital_status), (policy_type, marital_status),"
    " (marital_status, policy_type, age_band))"))
def q_a24g(spark, d):
    """A22-A24 as one GROUPING SETS aggregate (one scan, one shuffle)."""
    df = PH(spark, d)
    return (df.groupingSets([["marital_status"], ["policy_type", "marital_status"],
                             ["marital_status", "policy_type", "age_band"]],
                            "marital_status", "policy_type", "age_band")
              .agg(F.grouping_id().cast("long").alias("grouping_id"), F.count(F.lit(1)).alias("customers"),
                   F.sum("churn_flag").cast("long").alias("churned"),
                   F.round(F.avg("churn_flag"), 6).alias("churn_rate")))


def _vc_sql(c):
    return (f"SELECT {c}, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share"
            f" FROM policyholders WHERE {c} IS NOT NULL GROUP BY {c}")


@register("a25_value_counts_churn_flag", with_ctes(_vc_sql("churn_flag")))
def q_a25(spark, d):
    return rates.value_counts(PH(spark, d), "churn_flag")


@register("a25_value_counts_policy_type", with_ctes(_vc_sql("policy_type")))
def q_a25b(spark, d):
    return rates.value_counts(PH(spark, d), "policy_type")


def _hyp_long_sql():
    return " UNION ALL ".join(f"SELECT {q(h)} AS hypothesis, {e} AS score, churn_flag FROM policyholders"
                              for h, e in HYP_SQL.items())


@register("a27_hypothesis_summary", with_ctes(
    "SELECT hypothesis, round(sum(score * n) / sum(n), 2) AS mean_score, round(max(r) * 100, 2) AS max_group_rate_pct,"
    " CASE hypothesis " + " ".join(f"WHEN {q(h)} THEN {q(lbl)}" for h, lbl in fx.HYPOTHESIS_LABELS.items())
    + " END AS hypothesis_ko FROM (SELECT hypothesis, score, count(*) AS n, avg(churn_flag) AS r FROM ("
    + _hyp_long_sql() + ") GROUP BY hypothesis, score) GROUP BY hypothesis"))
def q_a27(spark, d):
    return rates.hypothesis_summary(PH(spark, d))


@register("a28_hypothesis_curve", with_ctes(
    "SELECT lv.hypothesis, CAST(lv.score AS INTEGER) AS score, CAST(coalesce(r.customers, 0) AS BIGINT) AS customers,"
    " r.churn_rate FROM (VALUES " + ", ".join(f"({q(h)}, {s})" for h, top in fx.HYPOTHESIS_LEVELS.items()
                                               for s in range(top + 1))
    + ") lv(hypothesis, score) LEFT JOIN (SELECT hypothesis, score, count(*) AS customers,"
    " round(avg(churn_flag), 6) AS churn_rate FROM (" + _hyp_long_sql() + ") GROUP BY hypothesis, score) r"
    " ON lv.hypothesis = r.hypothesis AND lv.score = r.score"))
def q_a28(spark, d):
    return rates.hypothesis_curve(PH(spark, d))


@register("a29_rate_by_engagement_score", with_ctes(
    rate_sql([("engagement_risk_score", "engagement_risk_score")], source="features"), FEATURES_CTE))
def q_a29(spark, d):
    return rates.rate(fx.add_engineered_features(PH(spark, d)), ["engagement_risk_score"])


def _qcut_sql(column: str) -> str:
    return f"""SELECT {q(column)} AS feature, bk.bucket, bk.lower, bk.upper,
  CAST(coalesce(a.customers, 0) AS BIGINT) AS customers, a.churn_rate
FROM (SELECT CAST(i AS INTEGER) AS bucket, round(e[i], 9) AS lower, round(e[i + 1], 9) AS upper
      FROM (SELECT unnest(range(1, len(e))) AS i, e FROM edges)) bk
LEFT JOIN (SELECT bucket, count(*) AS customers, round(avg(churn_flag), 6) AS churn_rate
           FROM (SELECT CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < {column})) + 1 AS INTEGER) AS bucket, churn_flag
                 FROM features CROSS JOIN edges WHERE {column} IS NOT NULL) GROUP BY bucket) a
ON bk.bucket = a.bucket"""


def _edges_cte(column: str) -> str:
    return (f"edges AS (SELECT list_sort(list_distinct(quantile_cont({column}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e"
            f" FROM features WHERE {column} IS NOT NULL)")


@register("a30_quintile_premium_shock", with_ctes(
    _qcut_sql("premium_increase_shock"), FEATURES_CTE, _edges_cte("premium_increase_shock")))
def q_a30a(spark, d):
    return rates.rate_by_quantile(fx.add_engineered_features(PH(spark, d)), "premium_increase_shock")


@register("a30_quintile_tenure_inverse", with_ctes(
    _qcut_sql("tenure_inverse"), FEATURES_CTE, _edges_cte("tenure_inverse")))
def q_a30b(spark, d):
    return rates.rate_by_quantile(fx.add_engineered_features(PH(spark, d)), "tenure_inverse")


def _heat_sql(row_expr, row_name, col_expr):
    return (f"SELECT {row_name}, " + ", ".join(
        f"round(avg(churn_flag) FILTER (WHERE c = {v}), 6) AS \"{v}\"" for v in (0, 1))
        + f" FROM (SELECT {row_expr} AS {row_name}, {col_expr} AS c, churn_flag FROM policyholders)"
          f" GROUP BY {row_name}")


@register("a31_heat_jump_by_complaint", with_ctes(
    _heat_sql(flag("premium_change_pct >= 0.12e0"), "premium_jump_flag", "complaint_flag")))
def q_a31(spark, d):
    df = fx.add_engineered_features(PH(spark, d))
    return rates.pivot_rate(df, "premium_jump_flag", "complaint_flag", [0, 1])


@register("a32_heat_late_by_quote", with_ctes(
    _heat_sql(flag("late_payment_count_12m >= 2"), "late_payment_risk_flag", "quote_requested_flag")))
def q_a32(spark, d):
    df = PH(spark, d).withColumn("late_payment_risk_flag", fx.flag(F.col("late_payment_count_12m") >= 2))
    return rates.pivot_rate(df, "late_payment_risk_flag", "quote_requested_flag", [0, 1])


# Numeric columns of the policyholder table, in schema order (C5 on the fixture schema).
NUMERIC_COLS = ["age", "customer_tenure_months", "multi_policy_flag", "num_policies", "renewal_month",
                "current_premium", "premium_last_year", "premium_change_pct", "num_price_increases_last_3y",
                "coverage_amount", "premium_to_coverage_ratio", "autopay_enabled", "late_payment_count_12m",
                "missed_payment_flag", "payment_method_change_flag", "num_claims_12m", "num_approved_claims_12m",
                "num_rejected_claims_12m", "num_pending_claims_12m", "avg_claim_amount", "total_claim_amount_12m",
                "total_payout_amount_12m", "payout_ratio_12m", "avg_settlement_time_days", "days_since_last_claim",
                "num_contacts_12m", "complaint_flag", "complaint_resolution_days", "quote_requested_flag",
                "coverage_downgrade_flag", "churn_flag", "churn_probability_true"]


def _corr_sql(pairs, source="policyholders"):
    sel = ", ".join(f"coalesce(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 'NaN'::DOUBLE) AS \"{a}|{b}\""
                    for a, b in pairs)
    return (f"SELECT split_part(pair, '|', 1) AS col_i, split_part(pair, '|', 2) AS col_j,"
            f" CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) END AS r"
            f" FROM (UNPIVOT (SELECT {sel} FROM {source}) ON COLUMNS(*) INTO NAME pair VALUE r)")


_PAIRS = list(combinations(NUMERIC_COLS, 2))


@register("a33_correlation_matrix", with_ctes(_corr_sql(_PAIRS)))
def q_a33(spark, d):
    return stats.correlation_long(PH(spark, d), NUMERIC_COLS)


@register("a34_strong_pairs", with_ctes(
    "SELECT * FROM (" + _corr_sql(_PAIRS) + ") WHERE abs(r) >= 0.6e0"))
def q_a34(spark, d):
    return stats.strong_pairs(stats.correlation_long(PH(spark, d), NUMERIC_COLS))


_LABEL_FEATS = [c for c in NUMERIC_COLS if c != "churn_flag"]
_LABEL_CORR_SQL = ("SELECT split_part(pair, '|', 1) AS feature, CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) END AS r"
                   " FROM (UNPIVOT (SELECT "
                   + ", ".join(f"coalesce(corr(CAST({c} AS DOUBLE), CAST(churn_flag AS DOUBLE)), 'NaN'::DOUBLE) AS \"{c}|\""
                               for c in _LABEL_FEATS)
                   + " FROM policyholders) ON COLUMNS(*) INTO NAME pair VALUE r)")


@register("a35_strong_label_correlations", with_ctes(
    "SELECT feature, r, kind FROM (SELECT feature, r, 'strong' AS kind FROM lc WHERE abs(r) >= 0.6e0"
    " UNION ALL SELECT feature, r, 'top' AS kind FROM (SELECT * FROM lc ORDER BY r DESC, feature LIMIT 5))"
    " CROSS JOIN (SELECT count(*) AS n FROM lc WHERE abs(r) >= 0.6e0)"
    " WHERE (n > 0 AND kind = 'strong') OR (n = 0 AND kind = 'top')",
    f"lc AS (SELECT * FROM ({_LABEL_CORR_SQL}) WHERE r IS NOT NULL)"))
def q_a35(spark, d):
    return stats.strong_label_correlations(PH(spark, d).select(*NUMERIC_COLS))


_TOP2_FEATS = [c for c in _LABEL_FEATS if c != "churn_probability_true"]


@register("a36_top2_label_correlations", with_ctes(
    "SELECT feature, r FROM (SELECT split_part(pair, '|', 1) AS feature,"
    " CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) END AS r FROM (UNPIVOT (SELECT "
    + ", ".join(f"coalesce(corr(CAST({c} AS DOUBLE), CAST(churn_flag AS DOUBLE)), 'NaN'::DOUBLE) AS \"{c}|\""
              for c in _TOP2_FEATS)
    + " FROM policyholders) ON COLUMNS(*) INTO NAME pair VALUE r)) WHERE r IS NOT NULL"
    " ORDER BY abs(r) DESC, feature LIMIT 2"))
def q_a36(spark, d):
    return stats.top_label_correlations(PH(spark, d).select(*NUMERIC_COLS))


def _iqr_sql(cols):
    qs = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS \"{c}_q1\", quantile_cont(CAST({c} AS DOUBLE), 0.75)"
                   f" AS \"{c}_q3\"" for c in cols)
    parts = " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", count(*) FILTER (WHERE CAST({c} AS DOUBLE) < \"{c}_q1\" - 1.5e0 * (\"{c}_q3\""
        f" - \"{c}_q1\") OR CAST({c} AS DOUBLE) > \"{c}_q3\" + 1.5e0 * (\"{c}_q3\" - \"{c}_q1\")) AS outliers"
        f" FROM policyholders CROSS JOIN qt" for c in cols)
    return parts, f"qt AS (SELECT {qs} FROM policyholders)"


_IQR_BODY, _IQR_CTE = _iqr_sql(NUMERIC_COLS)


@register("a37_iqr_outliers", with_ctes(_IQR_BODY, _IQR_CTE))
def q_a37(spark, d):
    return stats.iqr_outliers(PH(spark, d), NUMERIC_COLS)


@register("a38_class_ratio", with_ctes(
    "SELECT count(*) FILTER (WHERE churn_flag = 0) AS negatives, count(*) FILTER (WHERE churn_flag = 1) AS positives,"
    " round(count(*) FILTER (WHERE churn_flag = 0) / nullif(count(*) FILTER (WHERE churn_flag = 1), 0), 6)"
    " AS neg_pos_ratio FROM policyholders"))
def q_a38(spark, d):
    return rates.class_ratio(PH(spark, d))


@register("a39_default_customer_value", with_ctes(
    "SELECT CAST(floor(avg(current_premium) * 12) AS BIGINT) AS customer_value FROM policyholders"))
def q_a39(spark, d):
    return rates.default_customer_value(PH(spark, d))


@register("a36_top2_scatter_rows", with_ctes(
    "SELECT u.customer_id, u.feature, u.value, u.churn_flag FROM (UNPIVOT (SELECT customer_id, churn_flag, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _TOP2_FEATS)
    + " FROM policyholders) ON " + ", ".join(_TOP2_FEATS) + " INTO NAME feature VALUE value) u"
    " JOIN (SELECT feature FROM (SELECT split_part(pair, '|', 1) AS feature,"
    " CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) END AS r FROM (UNPIVOT (SELECT "
    + ", ".join(f"coalesce(corr(CAST({c} AS DOUBLE), CAST(churn_flag AS DOUBLE)), 'NaN'::DOUBLE) AS \"{c}|\""
                for c in _TOP2_FEATS)
    + " FROM policyholders) ON COLUMNS(*) INTO NAME pair VALUE r)) WHERE r IS NOT NULL"
    " ORDER BY abs(r) DESC, feature LIMIT 2) t ON u.feature = t.feature"))
def q_a36s(spark, d):
    """The scatter rows of the top-2 label-correlated features, long form
    (customer, feature, value, label) over the whole table."""
    p = PH(spark, d)
    names = [r.feature for r in stats.top_label_correlations(p.select(*NUMERIC_COLS)).collect()]  # two rows
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names]))
    long = p.select("customer_id", "churn_flag", *names).select("customer_id", "churn_flag", kv.alias("kv"))
    return long.select("customer_id", "kv.feature", "kv.value", "churn_flag").where(F.col("value").isNotNull())
