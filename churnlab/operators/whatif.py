"""What-if policy scenarios, re-scored over the whole population (survey N1-N19, D6).

All scenarios run in one pass: the population is cross-joined with the small
scenario literal (size fixed by the scenario list, so broadcasting it is safe),
and each row carries its scenario's parameters. The steps then run in order on
the already-changed rows:

  N2 relief -> N3 price-jump cap (top r%) -> N4 decrement increases ->
  N5 late normalisation (top r%) -> N6 complaint -> N7 quote -> N8 downgrade

A "top r%" step ranks the candidates of every scenario by the N1 priority
(ties by customer id) with ``global_row_number`` on (scenario, candidate,
priority, id): range partitions split each scenario across many tasks, so a
scenario (which holds the whole population) never lands in a single task.
Steps whose percentage is 0 in every scenario are skipped at plan time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators.ranking import SKETCH, SMALL_GROUP, global_row_number, rank_within_groups

SIM_COLUMNS = ["premium_change_pct", "num_price_increases_last_3y", "late_payment_count_12m",
               "missed_payment_flag", "complaint_flag", "quote_requested_flag", "coverage_downgrade_flag"]
RAW_CHECK_COLUMNS = ["premium_change_pct", "num_price_increases_last_3y", "late_payment_count_12m",
                     "complaint_flag", "quote_requested_flag", "coverage_downgrade_flag"]
ENGINEERED_CHECK_COLUMNS = ["premium_increase_shock", "premium_jump_flag", "payment_risk_score",
                            "service_risk_score", "engagement_risk_score", "premium_x_quote", "late_x_quote",
                            "downgrade_x_quote", "monthly_x_premium_jump"]
PARAMS = ["price_relief_pct", "reduce_price_jump_pct", "reduce_late_pct", "reduce_complaint_pct",
          "reduce_quote_pct", "reduce_downgrade_pct"]
JUMP_CAP = 0.119


@dataclass(frozen=True)
class Scenario:
    scenario: str
    policy_ko: str
    is_base: bool
    is_single: bool
    price_relief_pct: int = 0
    reduce_price_jump_pct: int = 0
    reduce_late_pct: int = 0
    reduce_complaint_pct: int = 0
    reduce_quote_pct: int = 0
    reduce_downgrade_pct: int = 0


# Page defaults (relief 40, jump 60, late 60, complaint 0, quote 0,
# downgrade 50) and the six single-policy names.
DEFAULT_SCENARIOS = [
    Scenario("base", "기준", True, False),
    Scenario("combined", "종합", False, False, 40, 60, 60, 0, 0, 50),
    Scenario("price_relief", "보험료 인상폭 완화", False, True, 40, 0, 0, 0, 0, 0),
    Scenario("price_jump", "급격한 보험료 인상 고객 완화", False, True, 0, 60, 0, 0, 0, 0),
    Scenario("late_payment", "고연체 고객 정상화", False, True, 0, 0, 60, 0, 0, 0),
    Scenario("complaint", "민원 고객 해소", False, True, 0, 0, 0, 0, 0, 0),
    Scenario("quote", "비교 견적 요청 감소", False, True, 0, 0, 0, 0, 0, 0),
    Scenario("downgrade", "보장 축소 고객 감소", False, True, 0, 0, 0, 0, 0, 50),
    Scenario("all_levers", "all levers", False, False, 40, 60, 60, 50, 50, 50),
]

SCENARIO_SCHEMA = ("scenario string, policy_ko string, is_base boolean, is_single boolean, price_relief_pct int, "
                   "reduce_price_jump_pct int, reduce_late_pct int, reduce_complaint_pct int, reduce_quote_pct int, "
                   "reduce_downgrade_pct int")


def scenario_table(spark, scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS) -> DataFrame:
    return spark.createDataFrame([astuple(s) for s in scenarios], SCENARIO_SCHEMA)


def priority_score(cols: set[str] | None = None) -> Column:
    """Weighted risk sum; a missing value counts 0 (tenure: 999); an absent
    column contributes nothing (C17). Summed left to right like the reference."""
    def has(c):
        return cols is None or c in cols
    terms = [("premium_change_pct", 12.0), ("num_price_increases_last_3y", 2.5), ("late_payment_count_12m", 3.5),
             ("missed_payment_flag", 4.0), ("complaint_flag", 4.5), ("quote_requested_flag", 3.0),
             ("coverage_downgrade_flag", 3.0)]
    score = F.lit(0.0)
    for c, w in terms:
        if has(c):
            score = score + F.coalesce(F.col(c), F.lit(0)) * F.lit(w)
    if has("multi_policy_flag"):
        score = score + (F.coalesce(F.col("multi_policy_flag"), F.lit(0)) == 0).cast("int") * F.lit(1.5)
    if has("customer_tenure_months"):
        score = score + (F.coalesce(F.col("customer_tenure_months"), F.lit(999)) <= 24).cast("int") * F.lit(2.0)
    return score


#: Rows tied at a cut that one task may order; more go through the range-partitioned ranking (the result is the same).
FEW_TIES = 100_000


def top_cuts(cands: DataFrame, pct_col: str, key: str) -> list[tuple[str, float, object]]:
    """(scenario, priority, key) of the last candidate that each scenario selects; key is None if all rows with that
    priority are selected. Reads columns scenario, ``pct_col``, ``_prio`` and ``key``.

    A selection needs a cut, not a ranking: a sketch per scenario gives a bracket that is sure to hold the cut, the
    rows above and the priorities inside are counted exactly, and only rows tied at the cut are ordered by key. One
    row per scenario reaches the driver.
    """
    edges = [min(1.0, max(0.0, 1 - p / 100 + side * 2 / SKETCH)) for p in range(101) for side in (-1, 1)]
    stats = cands.groupBy("scenario", pct_col).agg(
        F.count("*").alias("_n"), F.min("_prio").alias("_min"), F.max("_prio").alias("_max"),
        F.percentile_approx("_prio", edges, SKETCH).alias("_e"))
    pct, whole = F.least(F.greatest(F.col(pct_col), F.lit(0)), F.lit(100)), F.col("_n") < SMALL_GROUP
    stats = stats.select(
        "scenario", F.least(F.ceil(F.col("_n") * F.col(pct_col) / F.lit(100.0)), F.col("_n")).alias("_k"),
        F.when(whole, F.col("_min")).otherwise(F.element_at("_e", 2 * pct + 1)).alias("_lo"),
        F.when(whole, F.col("_max")).otherwise(F.element_at("_e", 2 * pct + 2)).alias("_hi"))
    inside = (cands.join(F.broadcast(stats), "scenario").where(F.col("_prio") >= F.col("_lo"))  # one row per scenario
              .groupBy("scenario", "_k", F.when(F.col("_prio") <= F.col("_hi"), F.col("_prio")).alias("_cut"))
              .agg(F.count("*").alias("_c")))
    upto = (Window.partitionBy("scenario").orderBy(F.col("_cut").desc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = (inside.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_before", F.col("_upto") - F.col("_c"))
           .where((F.col("_upto") >= F.col("_k")) & (F.col("_before") < F.col("_k"))))
    rows = cut.select("scenario", "_cut", (F.col("_k") - F.col("_before")).alias("_m"), "_c").collect()
    if any(r["_cut"] is None for r in rows):
        raise AssertionError("the bracket missed the cut")
    tied = [r for r in rows if r["_m"] < r["_c"]]
    last: dict[str, object] = {}
    if tied:
        at_cut = F.lit(False)
        take = F.lit(0)
        for r in tied:
            own = F.col("scenario") == r["scenario"]
            at_cut = at_cut | (own & (F.col("_prio") == F.lit(r["_cut"])))
            take = F.when(own, F.lit(r["_m"])).otherwise(take)
        ties = cands.where(at_cut).select("scenario", key)
        if max(r["_c"] for r in tied) <= FEW_TIES:
            ranked = ties.withColumn("_rk", F.row_number().over(Window.partitionBy("scenario").orderBy(key)))
        else:
            ranked = rank_within_groups(ties, "scenario", [F.col(key)], "_rk")
        last = {r["scenario"]: r[key] for r in ranked.where(F.col("_rk") == take).select("scenario", key).collect()}
    return [(r["scenario"], r["_cut"], last.get(r["scenario"])) for r in rows]


def select_top_pct(fan: DataFrame, candidate: Column, pct_col: str, out_col: str = "_chosen",
                   key: str = "customer_id") -> DataFrame:
    """Per scenario, flag the top ``ceil(n * pct / 100)`` candidates by
    priority (desc), ties by ``key``. The cuts are found first (small jobs); the
    flag itself is a projection."""
    cand = F.coalesce(candidate, F.lit(False)) & (F.col(pct_col) > 0) & ~F.col("is_base")
    prio = priority_score(set(fan.columns))
    chosen = F.lit(False)
    for scenario, cut, last in top_cuts(fan.where(cand).select("scenario", pct_col, key, prio.alias("_prio")), pct_col, key):
        at = (prio == F.lit(cut)) if last is None else (prio == F.lit(cut)) & (F.col(key) <= F.lit(last))
        chosen = chosen | ((F.col("scenario") == scenario) & ((prio > F.lit(cut)) | at))
    return fan.withColumn(out_col, cand & chosen)


def apply_scenarios(df: DataFrame, scenarios: DataFrame, decrement_price_increases: bool = True,
                    active: Sequence[Scenario] | None = None, key: str = "customer_id",
                    carry: Sequence[str] | None = None) -> DataFrame:
    """Population x scenarios with N2-N8 applied in order. Original values
    are kept as ``orig_<col>`` so before/after comparisons need no join (J1).
    ``active`` (the scenario literal) lets plan-time skip all-zero steps.
    ``carry``: extra columns to keep; ``None`` keeps every input column (joined
    back once on the key at the end), a list keeps just those (no join)."""
    present = [c for c in SIM_COLUMNS if c in df.columns]
    # Only the columns the steps read travel through the ranking shuffles; the
    # rest joins back once at the end on the (unique) key, unless not wanted.
    needed = set(SIM_COLUMNS) | {"multi_policy_flag", "customer_tenure_months", key} | set(carry or ())
    rest = [c for c in df.columns if c not in needed]
    narrow = df.select(*[c for c in df.columns if c in needed])
    fan = narrow.withColumns({f"orig_{c}": F.col(c) for c in present}).crossJoin(F.broadcast(scenarios))
    base = F.col("is_base")

    def used(param: str) -> bool:
        return active is None or any(getattr(s, param) > 0 for s in active if not s.is_base)

    if "premium_change_pct" in present:
        r = F.col("price_relief_pct")
        fan = fan.withColumn("premium_change_pct", F.when(~base & (r > 0), F.col("premium_change_pct")
                                                          * (F.lit(1.0) - r / F.lit(100.0)))
                             .otherwise(F.col("premium_change_pct")))
        if used("reduce_price_jump_pct"):
            fan = select_top_pct(fan, F.col("premium_change_pct") >= 0.12, "reduce_price_jump_pct", key=key)
            fan = fan.withColumn("premium_change_pct",
                                 F.when(F.col("_chosen"), F.lit(JUMP_CAP)).otherwise(F.col("premium_change_pct")))
            fan = fan.drop("_chosen")
    if "num_price_increases_last_3y" in present and decrement_price_increases:
        inc = F.col("num_price_increases_last_3y")
        fan = fan.withColumn("num_price_increases_last_3y",
                             F.when(~base & inc.isNotNull(), F.greatest(inc - 1, F.lit(0))).otherwise(inc))
    steps = [
        ("late_payment_count_12m", F.col("late_payment_count_12m") >= 2, "reduce_late_pct",
         {"late_payment_count_12m": 1, "missed_payment_flag": 0}),
        ("complaint_flag", F.col("complaint_flag") == 1, "reduce_complaint_pct", {"complaint_flag": 0}),
        ("quote_requested_flag", F.col("quote_requested_flag") == 1, "reduce_quote_pct", {"quote_requested_flag": 0}),
        ("coverage_downgrade_flag", F.col("coverage_downgrade_flag") == 1, "reduce_downgrade_pct",
         {"coverage_downgrade_flag": 0}),
    ]
    for col, cand, param, sets in steps:
        if col not in present or not used(param):
            continue
        fan = select_top_pct(fan, cand, param, key=key)
        fan = fan.withColumns({c: F.when(F.col("_chosen"), F.lit(v)).otherwise(F.col(c))
                               for c, v in sets.items() if c in present})
        fan = fan.drop("_chosen")
    if rest and carry is None:
        fan = fan.join(df.select(key, *rest), key)
    return fan


def linear_probability(cols: dict[str, str] | None = None) -> Column:
    """Deterministic scorer for checks: the fixture's generating formula applied
    to the (possibly changed) columns, rounded to 6 places."""
    c = {k: k for k in ["premium_change_pct", "late_payment_count_12m", "complaint_flag", "quote_requested_flag",
                        "coverage_downgrade_flag", "multi_policy_flag", "customer_tenure_months"]}
    c.update(cols or {})
    z = (F.lit(-2.3)
         + F.lit(2.0) * F.greatest(F.coalesce(F.col(c["premium_change_pct"]), F.lit(0.0)), F.lit(0.0))
         + F.lit(0.35) * F.col(c["late_payment_count_12m"])
         + F.lit(0.7) * F.col(c["complaint_flag"])
         + F.lit(0.6) * F.col(c["quote_requested_flag"])
         + F.lit(0.6) * F.col(c["coverage_downgrade_flag"])
         - F.lit(0.6) * F.col(c["multi_policy_flag"])
         + F.lit(0.7) * (F.col(c["customer_tenure_months"]) <= 24).cast("int"))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)


def scenario_summary(scored: DataFrame, threshold: float, prob_col: str = "sim_probability") -> DataFrame:
    """N10 per scenario: churn rate %, mean probability %, churn count (one
    groupBy over the fan-out; partial aggregation keeps it balanced)."""
    pred = (F.col(prob_col) >= F.lit(float(threshold))).cast("int")
    return scored.groupBy("scenario", "policy_ko", "is_base", "is_single").agg(
        F.round(F.avg(pred) * 100, 6).alias("churn_rate_pct"),
        F.round(F.avg(prob_col) * 100, 9).alias("avg_prob_pct"),
        F.sum(pred).cast("long").alias("churn_count"))


def compare_to_base(summary: DataFrame) -> DataFrame:
    """Each non-base scenario against base: mean-probability drop,
    churn-rate drop (improvement), saved customers. Base is one row: broadcast."""
    b = summary.where(F.col("is_base")).select(F.col("avg_prob_pct").alias("b_prob"),
                                               F.col("churn_rate_pct").alias("b_rate"),
                                               F.col("churn_count").alias("b_count"))
    return (summary.where(~F.col("is_base")).crossJoin(F.broadcast(b))
            .select("scenario", "policy_ko", "is_single",
                    F.round(F.col("b_prob") - F.col("avg_prob_pct"), 6).alias("avg_prob_drop"),
                    F.round(F.col("b_rate") - F.col("churn_rate_pct"), 6).alias("churn_rate_drop"),
                    (F.col("b_count") - F.col("churn_count")).alias("saved_customers")))


def best_policy(effects: DataFrame) -> DataFrame:
    """The single policy with the largest mean-probability drop (ties: name)."""
    singles = effects.where(F.col("is_single"))
    return singles.agg(F.max_by("policy_ko", F.struct(F.col("avg_prob_drop"), F.col("scenario"))).alias("best_policy"),
                       F.max("avg_prob_drop").alias("avg_prob_drop"))


def raw_means(fan: DataFrame, scenario: str, cols: Sequence[str] = RAW_CHECK_COLUMNS) -> DataFrame:
    """N14 + N15 for one scenario: mean before/after/diff and changed-row count
    (null-safe, B7) per column, from one aggregate (before values ride along)."""
    one = fan.where(F.col("scenario") == scenario)
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(f"orig_{c}")).alias(f"{c}|b"), F.avg(F.col(c)).alias(f"{c}|a"),
                 F.count_if(~F.col(f"orig_{c}").eqNullSafe(F.col(c))).alias(f"{c}|n")]
    wide = one.agg(*aggs)
    rows = ", ".join(f"'{c}', cast(`{c}|b` as double), cast(`{c}|a` as double), `{c}|n`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {rows}) as (`column`, before_mean, after_mean, rows_changed)")
    return long.select("column", F.round("before_mean", 9).alias("before_mean"),
                       F.round("after_mean", 9).alias("after_mean"),
                       F.round(F.col("after_mean") - F.col("before_mean"), 9).alias("diff"), "rows_changed")


def engineered_means(fan: DataFrame, scenario: str, cols: Sequence[str] = ENGINEERED_CHECK_COLUMNS) -> DataFrame:
    """F1 on the before and after versions of the same rows, means and diff."""
    one = fan.where(F.col("scenario") == scenario)
    exprs = fx.engineered_feature_exprs()
    names = [c for c in one.columns if not c.startswith("orig_")]
    # Both versions of a row come out of one scan: an array of two structs, exploded.
    versions = F.explode(F.array(
        F.struct(*[F.col(f"orig_{c}" if f"orig_{c}" in one.columns else c).alias(c) for c in names], F.lit(True).alias("_before")),
        F.struct(*[F.col(c).alias(c) for c in names], F.lit(False).alias("_before"))))
    wide = one.select(versions.alias("v")).select("v.*").agg(
        *[F.avg(F.when(F.col("_before") == side, exprs[c])).alias(f"{c}|{tag}")
          for c in cols for side, tag in ((True, "b"), (False, "a"))])
    rows = ", ".join(f"'{c}', cast(`{c}|b` as double), cast(`{c}|a` as double)" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {rows}) as (feature, before_mean, after_mean)")
    return long.select(
        "feature", F.round("before_mean", 9).alias("before_mean"), F.round("after_mean", 9).alias("after_mean"),
        F.round(F.col("after_mean") - F.col("before_mean"), 9).alias("diff"))


def prediction_comparison(summary: DataFrame, scenario: str) -> DataFrame:
    """Base vs one scenario: mean probability %, churn rate %, churn count."""
    two = summary.where(F.col("is_base") | (F.col("scenario") == scenario))
    return two.select(F.when(F.col("is_base"), "base").otherwise(F.col("scenario")).alias("version"),
                      "avg_prob_pct", "churn_rate_pct", "churn_count")


# Summary sentence of the scenario page.
SUMMARY_TEMPLATE = ("현재 시나리오에서는 예상 이탈 고객이 {base}명에서 {sim}명으로 감소하여 약 {saved}명의 고객 이탈을 "
                    "방어할 수 있습니다. 예상 방어 매출은 {value}원이며, 단일 정책 기준으로는 '{best}'의 효과가 가장 크게 "
                    "나타났습니다.")


def summary_sentence(summary: DataFrame, effects: DataFrame, customer_value: DataFrame, scenario: str) -> DataFrame:
    """N19 (with N12 saved value = saved customers x customer value)."""
    base = summary.where(F.col("is_base")).select(F.col("churn_count").alias("base_count"))
    sim = summary.where(F.col("scenario") == scenario).select(F.col("churn_count").alias("sim_count"))
    best = best_policy(effects).select("best_policy")
    row = base.crossJoin(sim).crossJoin(best).crossJoin(customer_value)
    saved = F.col("base_count") - F.col("sim_count")
    value = saved * F.col("customer_value")
    text = F.lit(SUMMARY_TEMPLATE)
    for k, v in (("{base}", F.format_number("base_count", 0)), ("{sim}", F.format_number("sim_count", 0)),
                 ("{saved}", F.format_number(saved, 0)), ("{value}", F.format_number(value, 0)),
                 ("{best}", F.col("best_policy"))):
        text = F.replace(text, F.lit(k), v)
    return row.select("base_count", "sim_count", saved.alias("saved_customers"), value.alias("saved_value"),
                      "best_policy", text.alias("summary"))


def older_scenario(df: DataFrame, complaint_reduction_pct: int, premium_limit_pct: int, seed: int = 42,
                   key: str = "customer_id") -> DataFrame:
    """Resolve ``int(n * r / 100)`` complaints, chosen in a seeded md5 order
    (B8), then cap the premium change at ``limit / 100`` (C7, nulls kept)."""
    cand = F.coalesce(F.col("complaint_flag") == 1, F.lit(False))
    x = df.withColumn("_cand", cand.cast("int")).withColumn("_h", F.md5(F.concat(F.col(key), F.lit(str(seed)))))
    numbered = global_row_number(x, [F.col("_cand").desc(), F.col("_h"), F.col(key)], "_gid")
    n = numbered.agg(F.sum("_cand").alias("_n"))
    k = F.floor(F.col("_n") * (F.lit(complaint_reduction_pct) / F.lit(100.0)))
    chosen = (F.col("_cand") == 1) & (F.col("_gid") <= k)
    out = (numbered.crossJoin(F.broadcast(n))
           .withColumn("complaint_flag", F.when(chosen, F.lit(0)).otherwise(F.col("complaint_flag")))
           .withColumn("premium_change_pct", fx.clip_upper(F.col("premium_change_pct"), premium_limit_pct / 100)))
    return out.drop("_cand", "_h", "_gid", "_n")
