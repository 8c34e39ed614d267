"""Catalogue: what-if scenarios with the deterministic linear re-scorer (survey N, D6)."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import functions as F

from churnlab.functions.scoring import DEFAULT_THRESHOLD
from churnlab.operators import quality
from churnlab.operators import whatif as wi
from churnlab.operators.rates import default_customer_value
from churnlab.plans.oracle_base import with_ctes
from churnlab.plans.registry import register
from churnlab.plans.sql_fragments import F1_SQL, q
from churnlab.session import materialize, memo, memo_key
from churnlab.sources.fixture import policyholders

T = DEFAULT_THRESHOLD
_FAN: dict = memo()
# Besides the scenario inputs, the checked consumers read only these (F1 inputs).
CARRY = ["payment_frequency", "policy_type"]


def fan(spark, d):
    """Population x default scenarios after N2-N8, with the linear probability;
    checkpointed once per session and folder."""
    key = memo_key(spark, d)
    if key not in _FAN:
        sims = wi.apply_scenarios(policyholders(spark, d), wi.scenario_table(spark), active=wi.DEFAULT_SCENARIOS,
                                  carry=CARRY)
        _FAN[key] = materialize(sims.withColumn("sim_probability", wi.linear_probability()))
    return _FAN[key]


def summary(spark, d):
    return wi.scenario_summary(fan(spark, d), T)


# ------------------------------------------------------------------ SQL twin
PRIO_SQL = ("((((((((0.0e0 + coalesce(premium_change_pct, 0) * 12.0e0) + coalesce(num_price_increases_last_3y, 0) * 2.5e0)"
            " + coalesce(late_payment_count_12m, 0) * 3.5e0) + coalesce(missed_payment_flag, 0) * 4.0e0)"
            " + coalesce(complaint_flag, 0) * 4.5e0) + coalesce(quote_requested_flag, 0) * 3.0e0)"
            " + coalesce(coverage_downgrade_flag, 0) * 3.0e0)"
            " + CAST(coalesce(multi_policy_flag, 0) = 0 AS INTEGER) * 1.5e0)"
            " + CAST(coalesce(customer_tenure_months, 999) <= 24 AS INTEGER) * 2.0e0")


def _sc_values(scenarios=wi.DEFAULT_SCENARIOS) -> str:
    rows = []
    for s in scenarios:
        t = astuple(s)
        rows.append("(" + ", ".join(q(v) if isinstance(v, str) else ("true" if v is True else "false" if v is False
                                                                      else str(v)) for v in t) + ")")
    return ("sc AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(scenario, policy_ko, is_base, is_single, "
            + ", ".join(wi.PARAMS) + "))")


def _step(name: str, prev: str, cand: str, param: str, sets: dict[str, str]) -> str:
    rep = ", ".join(f"CASE WHEN _cand = 1 AND _rk <= least(greatest(ceil(_ncand * {param} / 100.0e0), 0), _ncand)"
                    f" THEN {v} ELSE {c} END AS {c}" for c, v in sets.items())
    return f"""{name} AS (
  SELECT * EXCLUDE (_cand, _prio, _rk, _ncand) REPLACE ({rep})
  FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY _cand DESC, _prio DESC, customer_id) AS _rk,
               sum(_cand) OVER (PARTITION BY scenario) AS _ncand
        FROM (SELECT *, CAST(coalesce({cand}, false) AND {param} > 0 AND NOT is_base AS INTEGER) AS _cand,
                     {PRIO_SQL} AS _prio FROM {prev}))
)"""


def _chain_ctes(scenarios=wi.DEFAULT_SCENARIOS, decrement: bool = True) -> list[str]:
    orig = ", ".join(f"p.{c} AS orig_{c}" for c in wi.SIM_COLUMNS)
    ctes = [
        _sc_values(scenarios),
        f"f0 AS (SELECT p.*, {orig}, sc.* FROM policyholders p CROSS JOIN sc)",
        "f1 AS (SELECT * REPLACE (CASE WHEN NOT is_base AND price_relief_pct > 0 THEN premium_change_pct"
        " * (1.0e0 - price_relief_pct / 100.0e0) ELSE premium_change_pct END AS premium_change_pct) FROM f0)",
        _step("f2", "f1", "premium_change_pct >= 0.12e0", "reduce_price_jump_pct",
              {"premium_change_pct": f"{wi.JUMP_CAP!r}e0"}),
        ("f3 AS (SELECT * REPLACE (CASE WHEN NOT is_base AND num_price_increases_last_3y IS NOT NULL"
         " THEN greatest(num_price_increases_last_3y - 1, 0) ELSE num_price_increases_last_3y END"
         " AS num_price_increases_last_3y) FROM f2)") if decrement else "f3 AS (SELECT * FROM f2)",
        _step("f4", "f3", "late_payment_count_12m >= 2", "reduce_late_pct",
              {"late_payment_count_12m": "1", "missed_payment_flag": "0"}),
        _step("f5", "f4", "complaint_flag = 1", "reduce_complaint_pct", {"complaint_flag": "0"}),
        _step("f6", "f5", "quote_requested_flag = 1", "reduce_quote_pct", {"quote_requested_flag": "0"}),
        _step("f7", "f6", "coverage_downgrade_flag = 1", "reduce_downgrade_pct", {"coverage_downgrade_flag": "0"}),
        """fan AS (SELECT *, round(1.0e0 / (1.0e0 + exp(-(
            -2.3e0 + 2.0e0 * greatest(coalesce(premium_change_pct, 0.0e0), 0.0e0) + 0.35e0 * late_payment_count_12m
            + 0.7e0 * complaint_flag + 0.6e0 * quote_requested_flag + 0.6e0 * coverage_downgrade_flag
            - 0.6e0 * multi_policy_flag + 0.7e0 * CAST(customer_tenure_months <= 24 AS INTEGER)))), 6)
            AS sim_probability FROM f7)""",
    ]
    return ctes


CHAIN = _chain_ctes()
SUMMARY_CTE = (f"summ AS (SELECT scenario, policy_ko, is_base, is_single,"
               f" round(avg(CAST(sim_probability >= {T!r}e0 AS INTEGER)) * 100, 6) AS churn_rate_pct,"
               " round(avg(sim_probability) * 100, 9) AS avg_prob_pct,"
               f" CAST(sum(CAST(sim_probability >= {T!r}e0 AS INTEGER)) AS BIGINT) AS churn_count"
               " FROM fan GROUP BY scenario, policy_ko, is_base, is_single)")
EFFECTS_CTE = ("eff AS (SELECT s.scenario, s.policy_ko, s.is_single, round(b.avg_prob_pct - s.avg_prob_pct, 6)"
               " AS avg_prob_drop, round(b.churn_rate_pct - s.churn_rate_pct, 6) AS churn_rate_drop,"
               " b.churn_count - s.churn_count AS saved_customers FROM summ s CROSS JOIN"
               " (SELECT * FROM summ WHERE is_base) b WHERE NOT s.is_base)")


def W(body: str, *extra: str) -> str:
    return with_ctes(body, *CHAIN, *extra)


@register("n01_priority_score", with_ctes(f"SELECT customer_id, {PRIO_SQL} AS priority FROM policyholders"))
def q_n01(spark, d):
    p = policyholders(spark, d)
    return p.select("customer_id", wi.priority_score(set(p.columns)).alias("priority"))


@register("n09_scenario_fanout", W("SELECT customer_id, scenario, " + ", ".join(wi.SIM_COLUMNS)
                                   + ", sim_probability FROM fan"))
def q_n09(spark, d):
    return fan(spark, d).select("customer_id", "scenario", *wi.SIM_COLUMNS, "sim_probability")


@register("n10_scenario_summary", W("SELECT * FROM summ", SUMMARY_CTE))
def q_n10(spark, d):
    return summary(spark, d)


@register("n11_policy_effects", W("SELECT * FROM eff", SUMMARY_CTE, EFFECTS_CTE))
def q_n11(spark, d):
    return wi.compare_to_base(summary(spark, d)).orderBy("avg_prob_drop")


@register("n13_best_policy", W(
    "SELECT arg_max(policy_ko, (avg_prob_drop, scenario)) AS best_policy, max(avg_prob_drop) AS avg_prob_drop"
    " FROM eff WHERE is_single", SUMMARY_CTE, EFFECTS_CTE))
def q_n13(spark, d):
    return wi.best_policy(wi.compare_to_base(summary(spark, d)))


def _raw_sql(scenario: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", round(avg(orig_{c}), 9) AS before_mean, round(avg({c}), 9) AS after_mean,"
        f" round(avg({c}) - avg(orig_{c}), 9) AS diff,"
        f" count(*) FILTER (WHERE orig_{c} IS DISTINCT FROM {c}) AS rows_changed FROM fan WHERE scenario = {q(scenario)}"
        for c in wi.RAW_CHECK_COLUMNS)


@register("n14_raw_means_combined", W(_raw_sql("combined")))
def q_n14(spark, d):
    return wi.raw_means(fan(spark, d), "combined")


def _eng_sql(scenario: str) -> str:
    before = {c: e for c, e in F1_SQL.items()}
    parts = []
    for c in wi.ENGINEERED_CHECK_COLUMNS:
        e = before[c]
        eb = e
        for s in sorted(wi.SIM_COLUMNS, key=len, reverse=True):
            eb = eb.replace(s, f"orig_{s}")
        parts.append(f"SELECT {q(c)} AS feature, round(avg({eb}), 9) AS before_mean, round(avg({e}), 9) AS after_mean,"
                     f" round(avg({e}) - avg({eb}), 9) AS diff FROM fan WHERE scenario = {q(scenario)}")
    return " UNION ALL ".join(parts)


@register("n16_engineered_means_combined", W(_eng_sql("combined")))
def q_n16(spark, d):
    return wi.engineered_means(fan(spark, d), "combined")


@register("n17_prediction_comparison", W(
    "SELECT CASE WHEN is_base THEN 'base' ELSE scenario END AS version, avg_prob_pct, churn_rate_pct, churn_count"
    " FROM summ WHERE is_base OR scenario = 'combined'", SUMMARY_CTE))
def q_n17(spark, d):
    return wi.prediction_comparison(summary(spark, d), "combined")


def _sentence_sql() -> str:
    t = q(wi.SUMMARY_TEMPLATE)
    for k, v in (("{base}", "format('{:,}', base_count)"), ("{sim}", "format('{:,}', sim_count)"),
                 ("{saved}", "format('{:,}', base_count - sim_count)"),
                 ("{value}", "format('{:,}', (base_count - sim_count) * customer_value)"), ("{best}", "best_policy")):
        t = f"replace({t}, {q(k)}, {v})"
    return (f"SELECT base_count, sim_count, base_count - sim_count AS saved_customers,"
            f" (base_count - sim_count) * customer_value AS saved_value, best_policy, {t} AS summary FROM"
            " (SELECT churn_count AS base_count FROM summ WHERE is_base)"
            " CROSS JOIN (SELECT churn_count AS sim_count FROM summ WHERE scenario = 'combined')"
            " CROSS JOIN (SELECT arg_max(policy_ko, (avg_prob_drop, scenario)) AS best_policy FROM eff WHERE is_single)"
            " CROSS JOIN (SELECT CAST(floor(avg(current_premium) * 12) AS BIGINT) AS customer_value FROM policyholders)")


@register("n19_summary_sentence", W(_sentence_sql(), SUMMARY_CTE, EFFECTS_CTE))
def q_n19(spark, d):
    s = summary(spark, d)
    return wi.summary_sentence(s, wi.compare_to_base(s), default_customer_value(policyholders(spark, d)), "combined")


@register("n18_older_scenario", with_ctes(
    "SELECT customer_id, CASE WHEN _cand = 1 AND _rk <= floor(_n * (30 / 100.0e0)) THEN 0 ELSE complaint_flag END"
    " AS complaint_flag, CASE WHEN premium_change_pct IS NOT NULL THEN least(premium_change_pct, 0.12e0) END"
    " AS premium_change_pct FROM (SELECT *, row_number() OVER (ORDER BY _cand DESC, md5(customer_id || '42'),"
    " customer_id) AS _rk, sum(_cand) OVER () AS _n FROM (SELECT *, CAST(coalesce(complaint_flag = 1, false)"
    " AS INTEGER) AS _cand FROM policyholders))"))
def q_n18(spark, d):
    out = wi.older_scenario(policyholders(spark, d), 30, 12)
    return out.select("customer_id", "complaint_flag", "premium_change_pct")


@register("d06_zero_scenario_unchanged", with_ctes(
    "SELECT true AS identical, CAST(0 AS BIGINT) AS rows_changed FROM (SELECT count(*) FROM policyholders)"))
def q_d06(spark, d):
    """A non-base scenario with every lever at 0 and no decrement leaves each row as it was."""
    p = policyholders(spark, d)
    zero = [wi.Scenario("zero", "zero", False, False)]
    after = wi.apply_scenarios(p, wi.scenario_table(spark, zero), decrement_price_increases=False, active=zero)
    return quality.unchanged(p, after.select(*p.columns), "customer_id", wi.SIM_COLUMNS)


_SIM = list(wi.SIM_COLUMNS)


@register("d06_combined_scenario_changes", W(
    "SELECT count(*) = 0 AS identical, count(*) AS rows_changed FROM fan f JOIN policyholders p USING (customer_id)"
    " WHERE f.scenario = 'combined' AND (" + " OR ".join(f"f.{c} IS DISTINCT FROM p.{c}" for c in _SIM) + ")"))
def q_d06c(spark, d):
    """D6 for a scenario that does change rows."""
    return quality.unchanged(policyholders(spark, d), fan(spark, d).where(F.col("scenario") == "combined"), "customer_id", _SIM)
