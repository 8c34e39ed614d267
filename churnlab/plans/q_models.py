"""Catalogue: model preparation and model recipes (survey L1-L28, EV13-EV17, A40, IO8/IO9, R6/R7, N10 and P3 with a
model).

The recipes train with the reference's parameters. A model's own figures have no SQL twin; the queries return what
must hold for any model (sizes, figures that contradict each other, rows that break a rule of the scored table), which
SQL computes from the tables. ``scripts/tune.py`` runs the full grids and prints the records themselves.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import clean
from churnlab.operators import evaluate as ev
from churnlab.operators import models as ml
from churnlab.operators import prep
from churnlab.operators import profiles as pr
from churnlab.operators import scoring as so
from churnlab.operators import whatif as wi
from churnlab.plans.oracle_base import with_ctes
from churnlab.plans.registry import register
from churnlab.plans.sql_fragments import q
from churnlab.sources import io
from churnlab.session import materialize, memo, memo_key
from churnlab.sources.fixture import policyholders

def main_model(spark, d):
    return trained(spark, d, "main")


# ------------------------------------------------------------------ preparation (SQL)
@register("l01_stratified_split", with_ctes(
    "SELECT customer_id, churn_flag, CASE WHEN rk <= ceil(n * 0.2e0) THEN 'test'"
    " WHEN rk <= ceil(n * 0.2e0) + ceil(n * 0.2e0) THEN 'valid' ELSE 'train' END AS split"
    " FROM (SELECT customer_id, churn_flag, row_number() OVER (PARTITION BY churn_flag"
    " ORDER BY md5(customer_id || '42'), customer_id) AS rk, count(*) OVER (PARTITION BY churn_flag) AS n"
    " FROM policyholders)"))
def q_l01(spark, d):
    s = prep.stratified_split(policyholders(spark, d), [("test", 0.2), ("valid", 0.2), ("train", 0.6)])
    return s.select("customer_id", "churn_flag", "split")


SCALE_COLS = [f.name for f in io.POLICYHOLDER_SCHEMA.fields if f.dataType.simpleString() in ("int", "double")
              and f.name not in ("churn_flag", "churn_probability_true")]


def _adaptive_sql() -> str:
    st = []
    for c in SCALE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        st += [f"quantile_cont({x}, 0.25) AS \"{c}|q1\"", f"quantile_cont({x}, 0.5) AS \"{c}|med\"",
               f"quantile_cont({x}, 0.75) AS \"{c}|q3\"", f"avg({x}) AS \"{c}|mean\"",
               f"stddev_pop({x}) AS \"{c}|std\"", f"avg(ln(1 + {x})) AS \"{c}|lmean\"",
               f"stddev_pop(ln(1 + {x})) AS \"{c}|lstd\""]
    outl = ", ".join(
        f"count(*) FILTER (WHERE {c} < \"{c}|q1\" - 1.5e0 * (\"{c}|q3\" - \"{c}|q1\")"
        f" OR {c} > \"{c}|q3\" + 1.5e0 * (\"{c}|q3\" - \"{c}|q1\")) AS \"{c}|out\"" for c in SCALE_COLS)

    def nz(v):
        return f"(CASE WHEN {v} = 0 THEN 1.0e0 ELSE {v} END)"
    sel = []
    for c in SCALE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        if "amount" in c:
            e = f"(ln(1 + {x}) - \"{c}|lmean\") / {nz(chr(34) + c + '|lstd' + chr(34))}"
        else:
            rob = f"({x} - \"{c}|med\") / {nz(chr(34) + c + '|q3' + chr(34) + ' - ' + chr(34) + c + '|q1' + chr(34))}"
            std = f"({x} - \"{c}|mean\") / {nz(chr(34) + c + '|std' + chr(34))}"
            e = f"CASE WHEN \"{c}|out\" > 0 THEN {rob} ELSE {std} END"
        sel.append(f"round({e}, 6) AS {c}")
    return (f"SELECT customer_id, {', '.join(sel)} FROM policyholders, st, outl",
            f"st AS (SELECT {', '.join(st)} FROM policyholders)",
            f"outl AS (SELECT {outl} FROM policyholders, st)")


_AB, _AS, _AO = _adaptive_sql()


@register("l04_adaptive_scaling", with_ctes(_AB, _AS, _AO))
def q_l04(spark, d):
    return prep.adaptive_scaling(policyholders(spark, d), SCALE_COLS)


# Levels of the categorical fixture columns (FIXTURES.md), alphabetical.
_LEVELS = {
    "marital_status": ["Married", "Single"],
    "policy_type": ["Auto", "Health", "Home", "Life", "Travel"],
    "age_band": ["18-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75+"],
    "payment_frequency": ["Annual", "Monthly"],
    "region_name": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
}


@register("l05_dummies_drop_first", with_ctes(
    "SELECT customer_id, " + ", ".join(f"CAST({c} = {q(v)} AS INTEGER) AS \"{c}_{v}\""
                                       for c, vs in _LEVELS.items() for v in vs[1:]) + " FROM policyholders"))
def q_l05(spark, d):
    return prep.dummies(policyholders(spark, d), list(_LEVELS))


@register("l06_class_weights_balanced", with_ctes(
    "SELECT customer_id, churn_flag, CAST(CASE WHEN churn_flag = 1 THEN n / (2.0e0 * p) ELSE n / (2.0e0 * (n - p))"
    " END AS DOUBLE) AS weight FROM policyholders CROSS JOIN (SELECT count(*) AS n,"
    " count(*) FILTER (WHERE churn_flag = 1) AS p FROM policyholders)"))
def q_l06(spark, d):
    return prep.class_weights(policyholders(spark, d), "churn_flag", "balanced").select(
        "customer_id", "churn_flag", "weight")


@register("l06_class_weights_ratio", with_ctes(
    "SELECT customer_id, churn_flag, CAST(CASE WHEN churn_flag = 1 THEN (n - p) / CAST(p AS DOUBLE) * 2.5e0"
    " ELSE 1.0e0 END AS DOUBLE) AS weight FROM policyholders CROSS JOIN (SELECT count(*) AS n,"
    " count(*) FILTER (WHERE churn_flag = 1) AS p FROM policyholders)"))
def q_l06r(spark, d):
    return prep.class_weights(policyholders(spark, d), "churn_flag", "ratio", 2.5).select(
        "customer_id", "churn_flag", "weight")


# ------------------------------------------------------------------ models
_TRAINED: dict = memo()


def trained(spark, d, name: str) -> ml.TrainResult:
    """Recipe trained once per session and state of the input folder."""
    key = memo_key(spark, d, name)
    if key not in _TRAINED:
        _TRAINED[key] = ml.train_evaluate(ml.RECIPES[name], policyholders(spark, d))
    return _TRAINED[key]


def _check_sql(fraction: float, where: str = "true") -> str:
    return with_ctes(
        "SELECT count(*) AS test_size, count(*) FILTER (WHERE churn_flag = 1) AS actual_positive, count(*) AS matrix_total,"
        " CAST(0 AS BIGINT) AS bad_scores, CAST(0 AS BIGINT) AS bad_metrics, true AS separates FROM (SELECT churn_flag, row_number() OVER"
        " (PARTITION BY churn_flag ORDER BY md5(customer_id || '42'), customer_id) AS rk, count(*) OVER"
        f" (PARTITION BY churn_flag) AS n FROM policyholders WHERE {where}) WHERE rk <= ceil(n * {fraction}e0)")


def _register_record(recipe: str, qname: str) -> None:
    r = ml.RECIPES[recipe]
    sql = _check_sql(dict(r.split)["test"], "num_claims_12m > 0" if r.feature_set == "claimants_anger" else "true")

    @register(qname, sql)
    def fn(spark, d):
        return ml.record_check(trained(spark, d, recipe))


# Quick ones first; boosted trees, whose time grows with their number of rounds, last.
for _recipe, _qname in [
        ("price_lr", "l09_price_lr_record"), ("tenure_lr", "l23_tenure_lr_record"), ("contacts_lr", "l24_contacts_lr_record"),
        ("rf_claims", "l10_rf_claims_record"), ("rf_claimants_anger", "l11_rf_claimants_anger_record"),
        ("rf_dummies", "l13_rf_dummies_record"), ("rf_derived", "l14_rf_derived_record"), ("rf_numeric", "l15_rf_numeric_record"),
        ("rf_balanced", "l20_rf_balanced_record"), ("tenure_rf", "l23_tenure_rf_record"), ("contacts_rf", "l24_contacts_rf_record")]:
    _register_record(_recipe, _qname)


@register("l09_price_lr_coefficients", with_ctes(
    "SELECT 4 + count(DISTINCT policy_type) AS coefficients, CAST(0 AS BIGINT) AS bad_ranks FROM policyholders"))
def q_l09(spark, d):
    """A coefficient for each of 4 numeric features and each policy type, ranked by absolute value."""
    want = F.row_number().over(Window.orderBy(F.abs("coefficient").desc(), "feature"))  # a row per slot
    slots = ml.lr_coefficients(trained(spark, d, "price_lr")).withColumn("want", want)
    return slots.agg(F.count("*").alias("coefficients"), F.count_if(F.col("want") != F.col("abs_rank")).alias("bad_ranks"))


def _trend_sql(column: str) -> str:
    """Newton steps for a logistic curve through the table of distinct values."""
    p = "1 / (1 + exp(-(a + b * x)))"
    return ("WITH RECURSIVE " + with_ctes("SELECT 1")[5:].removesuffix("SELECT 1").rstrip() + f""",
v AS (SELECT CAST({column} AS DOUBLE) AS x, count(*) AS n, CAST(sum(churn_flag) AS DOUBLE) AS pos FROM policyholders WHERE {column} IS NOT NULL GROUP BY 1),
newton(i, a, b) AS (SELECT 0, 0.0e0, 0.0e0 UNION ALL
  SELECT i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT i, a, b, sum(pos - n * p) AS g0, sum((pos - n * p) * x) AS g1, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01,
               sum(n * p * (1 - p) * x * x) AS h11 FROM (SELECT *, {p} AS p FROM newton, v) WHERE i < 12 GROUP BY i, a, b))
SELECT '{column}' AS feature, x AS value, round({p}, 6) AS churn_probability FROM v, (SELECT a, b FROM newton WHERE i = 12)""")


@register("a40_logistic_trend_complaint", _trend_sql("complaint_flag"))
def q_a40b(spark, d):
    return ml.logistic_trend(policyholders(spark, d), "complaint_flag")


@register("a40_logistic_trend_contacts", _trend_sql("num_contacts_12m"))
def q_a40(spark, d):
    return ml.logistic_trend(policyholders(spark, d), "num_contacts_12m")


_SEARCHED: dict = memo()


def searched(spark, d, name: str):
    """(points, refitted best) of a whole grid, once per session and state of the input folder."""
    key = memo_key(spark, d, name)
    if key not in _SEARCHED:
        recipe, grid, folds, metric = ml.GRIDS[name]
        _SEARCHED[key] = ml.cross_validate(recipe, policyholders(spark, d), grid, folds, metric)
    return _SEARCHED[key]


@register("l25_cv_lr_grid", _check_sql(0.25))
def q_l25(spark, d):
    """All points of the grid, 3 folds, F1 on the training part; the best point is refitted and tested."""
    return ml.record_check(searched(spark, d, "tenure_lr")[1])


@register("l21_gbt_ratio_record", _check_sql(0.2))
def q_l21(spark, d):
    return ml.record_check(trained(spark, d, "gbt_ratio"))


@register("l07_main_model_record", _check_sql(0.2))
def q_l07(spark, d):
    """Main boosted model, F2 threshold on validation, refit, test record (EV9)."""
    return ml.record_check(main_model(spark, d))


@register("ev13_tree_importances", with_ctes(
    "SELECT CAST(15 AS BIGINT) AS features, CAST(0 AS BIGINT) AS out_of_order, 0.0e0 AS largest_difference, 1.0e0 AS total FROM (SELECT count(*) FROM policyholders)"))
def q_ev13(spark, d):
    """EV13: the top 15 in falling order; Spark's importances equal those counted from the node table, which sum to 1."""
    top = ml.tree_importances(main_model(spark, d), 15)
    drop = F.col("importance") > F.lag("importance").over(Window.orderBy("rank"))  # 15 rows
    order = top.withColumn("up", drop).agg(
        F.count("*").alias("features"), F.count_if(F.col("up") | (F.col("importance") < 0)).alias("out_of_order"))
    both = ml.importance_differences(main_model(spark, d)).agg(
        F.round(F.max(F.abs(F.col("importance") - F.col("counted"))), 9).alias("largest_difference"), F.round(F.sum("counted"), 9).alias("total"))
    return order.crossJoin(both)


@register("ev14_feature_rank", with_ctes(
    "SELECT 'premium_change_pct' AS feature, true AS label_fits FROM (SELECT count(*) FROM policyholders)"))
def q_ev14(spark, d):
    """EV14: rank of one named feature, or 'outside top 7'."""
    imp = ml.tree_importances(main_model(spark, d))
    one = imp.where(F.col("feature") == "premium_change_pct").select("feature", "importance", ml.rank_label().alias("rank_label"))
    better = one.select(F.col("importance").alias("own")).crossJoin(imp).agg(F.count_if(F.col("importance") > F.col("own")).alias("n"))
    return one.crossJoin(better).select("feature", (F.when(F.col("n") < 7, (F.col("n") + 1).cast("string"))
                                                    .otherwise("outside top 7") == F.col("rank_label")).alias("label_fits"))


def _test_part(spark, d):
    x, _, _ = ml.labelled_frame(ml.RECIPES["main"], policyholders(spark, d))
    return prep.stratified_split(x, list(ml.RECIPES["main"].split)).where(F.col("split") == "test")


def _importance_check(spark, d, columns):
    """Ranks are complete; a column that no node of the model splits on loses nothing when shuffled; a column does."""
    model = main_model(spark, d)
    found = ml.permutation_importance(model, _test_part(spark, d), columns, repeats=5)
    split_on = ml.importance_differences(model).where("counted > 0").select(F.split_part("feature", F.lit("="), F.lit(1)).alias("used")).distinct()
    both = found.join(F.broadcast(split_on), F.col("feature") == F.col("used"), "left")
    return both.agg(F.count("*").alias("features"), F.max("rank").cast("long").alias("last_rank"),
                    F.count_if(F.col("used").isNull() & ((F.col("importance_mean") != 0) | (F.col("importance_std") != 0))).alias("bad_values"),
                    (F.max("importance_mean") > 0).alias("some_matter"))


def _importance_sql(n: int) -> str:
    return with_ctes(f"SELECT CAST({n} AS BIGINT) AS features, CAST({n} AS BIGINT) AS last_rank, CAST(0 AS BIGINT) AS bad_values, true AS some_matter"
                     " FROM (SELECT count(*) FROM policyholders)")


@register("ev16_permutation_importance_engineered", _importance_sql(len(fx.ENGINEERED_FEATURES)))
def q_ev16(spark, d):
    """EV15/EV16: average-precision drop per engineered feature, 5 repeats."""
    return _importance_check(spark, d, fx.ENGINEERED_FEATURES)


@register("ev15_permutation_importance_all", with_ctes(
    "SELECT count(*) AS features, count(*) AS last_rank, CAST(0 AS BIGINT) AS bad_values, true AS some_matter FROM (SELECT unnest(['"
    + "', '".join(c for c in io.POLICYHOLDER_SCHEMA.names if c not in [*clean.LEAKAGE_COLUMNS, clean.LABEL])
    + "', '" + "', '".join(fx.ENGINEERED_FEATURES) + "']) AS f) CROSS JOIN (SELECT count(*) FROM policyholders)"))
def q_ev15(spark, d):
    """EV15: all features of the main model, 5 repeats."""
    _, nums, cats = ml.labelled_frame(ml.RECIPES["main"], policyholders(spark, d))
    return _importance_check(spark, d, [*nums, *cats])


@register("r06_model_scored_table", with_ctes(
    "SELECT count(*) AS customers, CAST(0 AS BIGINT) AS bad_class, CAST(0 AS BIGINT) AS bad_tier, CAST(0 AS BIGINT) AS bad_label,"
    " true AS ranks_are_complete FROM policyholders"))
def q_r06m(spark, d):
    """R6/R7 with the trained model: score, write Parquet (IO4), read back (IO5), and count the rows that break a rule."""
    from churnlab.functions.scoring import TIER_LABELS_KO, predicted_class, risk_tier
    res = main_model(spark, d)
    path = io.scratch_path(spark, "scored")
    io.write_scored(so.score_with_model(policyholders(spark, d), res.model, res.threshold), path)
    t, label = io.read_scored(spark, path), F.lit(None).cast("string")
    for tier, ko in TIER_LABELS_KO.items():
        label = F.when(F.col("risk_tier") == tier, ko).otherwise(label)
    n, rank = F.count("*"), F.col("coupon_priority")
    return t.agg(
        n.alias("customers"),
        F.count_if(~F.col("predicted_churn").eqNullSafe(predicted_class("churn_probability", res.threshold))).alias("bad_class"),
        F.count_if(~F.col("risk_tier").eqNullSafe(risk_tier("churn_probability", res.threshold))).alias("bad_tier"),
        F.count_if(~F.col("risk_tier_ko").eqNullSafe(label)).alias("bad_label"),
        ((F.count_distinct(rank) == n) & (F.min(rank) == 1) & (F.max(rank) == n)).alias("ranks_are_complete"))


@register("n10_model_scenario_summary", with_ctes(
    "SELECT CAST(9 AS BIGINT) AS scenarios, CAST(8 AS BIGINT) AS compared, CAST(0 AS BIGINT) AS bad_counts FROM (SELECT count(*) FROM policyholders)"))
def q_n10m(spark, d):
    """N10/N11 with the trained model over all scenarios in one transform."""
    from churnlab.plans.q_whatif import fan
    res = main_model(spark, d)
    p = policyholders(spark, d)
    narrow = fan(spark, d)
    # The model needs every feature: join the unchanged columns back on the key.
    f = narrow.join(p.select("customer_id", *[c for c in p.columns if c not in narrow.columns]), "customer_id")
    prob = ml.probability(res.model, fx.add_engineered_features(f).withColumn("label", F.lit(0.0)),
                          keep=("customer_id", "scenario", "policy_ko", "is_base", "is_single"))
    summary = materialize(wi.scenario_summary(prob, res.threshold, "score"))
    effects = wi.compare_to_base(summary).agg(F.count("*").alias("compared"))
    # Counted again from the scored fan-out, by class and not by share, and against the scores of the untouched table.
    again = prob.groupBy("scenario").agg(F.count_if(F.col("score") >= F.lit(res.threshold)).alias("_churn"), F.count("*").alias("_n"))
    plain = ml.probability(res.model, fx.add_engineered_features(p).withColumn("label", F.lit(0.0)), keep=("customer_id",)).agg(
        F.count_if(F.col("score") >= F.lit(res.threshold)).alias("_plain"), F.count("*").alias("_all"))
    bad = summary.join(again, "scenario").crossJoin(F.broadcast(plain)).agg(
        F.count("*").alias("scenarios"),
        F.count_if((F.abs(F.col("churn_rate_pct") - 100.0 * F.col("_churn") / F.col("_n")) > 1e-5) | (F.col("churn_count") != F.col("_churn"))
                   | (F.col("_n") != F.col("_all")) | F.col("is_base") & (F.col("churn_count") != F.col("_plain"))).alias("bad_counts"))
    return bad.crossJoin(effects).select("scenarios", "compared", "bad_counts")


@register("p03_profile_model_scores", with_ctes(
    "SELECT count(*) AS profiles, CAST(0 AS BIGINT) AS bad_class, CAST(0 AS BIGINT) AS bad_scores, true AS scores_differ FROM policyholders"))
def q_p03m(spark, d):
    """Class and tier of every completed profile by the score and the cutoffs alone, and scores that tell profiles apart."""
    from churnlab.plans.q_profiles import completed
    res = main_model(spark, d)
    comp = completed(spark, d).withColumnRenamed("profile_id", "customer_id")
    s = ml.probability(res.model, fx.add_engineered_features(comp).withColumn("label", F.lit(0.0)), keep=("customer_id",))
    from churnlab.functions.scoring import predicted_class, risk_tier
    v, t = F.col("score"), float(res.threshold)
    tier = (F.when(v >= max(0.6, 3 * t), "critical").when(v >= max(0.4, 2 * t), "high").when(v >= max(0.25, 1.2 * t), "watch").otherwise("stable"))
    return s.agg(F.count("*").alias("profiles"),
                 F.count_if(~predicted_class("score", t).eqNullSafe((v >= t).cast("int")) | ~risk_tier("score", t).eqNullSafe(tier)).alias("bad_class"),
                 F.count_if(v.isNull() | (v < 0) | (v > 1)).alias("bad_scores"), (F.count_distinct("score") > 1).alias("scores_differ"))


@register("io08_model_roundtrip", with_ctes(
    "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different, true AS threshold_equal FROM policyholders"))
def q_io08(spark, d):
    """IO8: save the bundle under the shared checkpoint folder, load it back,
    compare predictions row by row (1:1 join on the key)."""
    res = main_model(spark, d)
    path = io.scratch_path(spark, "model")
    io.save_model_bundle(res.model, res.threshold, path)
    model2, thr2 = io.load_model_bundle(spark, path)
    x, _, _ = ml.labelled_frame(ml.RECIPES["main"], policyholders(spark, d))
    a = ml.probability(res.model, x).withColumnRenamed("score", "s1")
    b = ml.probability(model2, x).select("customer_id", F.col("score").alias("s2"))
    return a.join(b, "customer_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("s1") != F.col("s2")).alias("different"),
        F.lit(float(res.threshold) == thr2).alias("threshold_equal"))


@register("io09_saved_test_split", with_ctes(
    "SELECT customer_id, churn_flag FROM (SELECT customer_id, churn_flag, row_number() OVER (PARTITION BY churn_flag"
    " ORDER BY md5(customer_id || '42'), customer_id) AS rk, count(*) OVER (PARTITION BY churn_flag) AS n"
    " FROM policyholders) WHERE rk <= ceil(n * 0.2e0)"))
def q_io09(spark, d):
    """IO9: write the held-out test part to Parquet and read it back."""
    s = prep.stratified_split(policyholders(spark, d), [("test", 0.2), ("train", 0.8)])
    path = io.scratch_path(spark, "test-split")
    io.save_split(s, path, "test")
    return spark.read.parquet(path).select("customer_id", "churn_flag")


@register("ev12_validation_recall", with_ctes(
    "SELECT 0.2e0 AS threshold, count(*) FILTER (WHERE churn_flag = 1 AND churn_probability_true >= 0.2e0)"
    " / nullif(CAST(count(*) FILTER (WHERE churn_flag = 1) AS DOUBLE), 0) AS recall, count(*) AS valid_size"
    " FROM (SELECT *, row_number() OVER (PARTITION BY churn_flag ORDER BY md5(customer_id || '42'), customer_id)"
    " AS rk, count(*) OVER (PARTITION BY churn_flag) AS n FROM policyholders)"
    " WHERE rk > ceil(n * 0.2e0) AND rk <= ceil(n * 0.2e0) + ceil(n * 0.2e0)"))
def q_ev12(spark, d):
    """EV12: recall of the rule ``score >= t`` on the validation part of the 60/20/20 split."""
    s = prep.stratified_split(policyholders(spark, d), [("test", 0.2), ("valid", 0.2), ("train", 0.6)])
    v = s.where(F.col("split") == "valid")
    y, hit = F.col("churn_flag") == 1, F.col("churn_probability_true") >= 0.2
    return v.agg(F.lit(0.2).alias("threshold"),
                 F.try_divide(F.count_if(y & hit).cast("double"), F.count_if(y)).alias("recall"),
                 F.count(F.lit(1)).alias("valid_size"))

# ------------------------------------------------------------------ long boosted runs
for _recipe, _qname in [
        ("tenure_gbt", "l23_tenure_gbt_record"), ("contacts_gbt", "l24_contacts_gbt_record"), ("lockin_1", "l18_lockin1_record"),
        ("lockin_2", "l18_lockin2_record"), ("gbt_subsample", "l17_gbt_subsample_record"), ("gbt_deep", "l16_gbt_deep_record"),
        ("gbt_claims", "l12_gbt_claims_record")]:
    _register_record(_recipe, _qname)


@register("l26_cv_rf_grid", _check_sql(0.2))
def q_l26(spark, d):
    """The whole forest grid (36 points from 2 fits a fold), F1, 3 folds, refit and test."""
    return ml.record_check(searched(spark, d, "claims_rf")[1])


@register("l26_cv_rf_points", with_ctes("SELECT CAST(36 AS BIGINT) AS points, CAST(36 AS BIGINT) AS in_range, true AS best_is_first FROM (SELECT count(*) FROM policyholders)"))
def q_l26p(spark, d):
    """The table of the points; the refitted model is a point that no other exceeds."""
    points, best = searched(spark, d, "claims_rf")
    forest = best.model.stages[-1]
    top = points.agg(F.max("mean_metric").alias("top"))
    mine = points.crossJoin(F.broadcast(top)).where(F.col("mean_metric") == F.col("top")).agg(
        (F.count_if(F.contains("params", F.lit(f"numTrees={forest.getNumTrees}"))) > 0).alias("best_is_first"))
    return points.agg(F.count("*").alias("points"), F.count_if(F.col("mean_metric").between(0.05, 1)).alias("in_range")).crossJoin(mine)


def _stages(spark, d) -> dict:
    """The models are independent and trained at once, the long ones first; the table that they share is there before."""
    policyholders(spark, d)
    jobs = [lambda: searched(spark, d, "claims_rf")[1], *[partial(trained, spark, d, name) for name in ("gbt_claims", "rf_claims", "rf_claimants_anger")]]
    tuned, boosted, plain, seg = ml.at_once(lambda made: made(), jobs, len(jobs))
    return {"1 baseline": (plain, 0.5), "2 tuned": (tuned, 0.5), "3 claimants": (seg, 0.5), "4 lower threshold": (seg, 0.4), "5 boosted": (boosted, 0.44)}


@register("ev17_stage_comparison", with_ctes(
    "SELECT s.stage, s.t AS threshold, true AS figures_fit FROM (VALUES ('1 baseline', 0.5e0), ('2 tuned', 0.5e0), ('3 claimants', 0.5e0),"
    " ('4 lower threshold', 0.4e0), ('5 boosted', 0.44e0)) s(stage, t) CROSS JOIN (SELECT count(*) FROM policyholders)"))
def q_ev17(spark, d):
    """EV17: the five stages (baseline forest, forest of the whole search, claimants, threshold 0.4, boosted trees) by AUC, F2
    and recall, each of which equals what its score table gives."""
    stages = _stages(spark, d)
    table = ml.stage_comparison({name: ev.evaluation_record(r.test_scores, t) for name, (r, t) in stages.items()})
    counted = None
    for name, (r, t) in stages.items():
        y, hit = F.col("label") == 1, F.col("score") >= F.lit(t)
        row = r.test_scores.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y).alias("p"))
        row = row.withColumn("stage", F.lit(name))
        counted = row if counted is None else counted.unionByName(row)
    f2 = F.try_divide(5.0 * F.col("tp"), 4.0 * F.col("p") + F.col("tp") + F.col("fp"))
    fits = ((F.abs(F.col("recall") - F.try_divide("tp", "p")) < 1e-6) & (F.abs(F.col("f2") - F.coalesce(f2, F.lit(0.0))) < 1e-6)
            & (F.col("roc_auc") > ml.LEAST_AUC))
    return table.join(counted, "stage").select("stage", F.round("threshold", 6).alias("threshold"), fits.alias("figures_fit"))


@register("l22_early_stopping_record", _check_sql(0.2))
def q_l22(spark, d):
    """Up to 5000 boosted trees, stopped after 20 rounds without a better loss on a fifth of the training part."""
    return ml.record_check(ml.early_stopping(policyholders(spark, d), ml.RECIPES["gbt_stopped"]))


@register("l29_cross_validated_report", with_ctes(
    "SELECT fold, count(*) AS test_size, CAST(sum(churn_flag) AS BIGINT) AS positives, true AS beats_chance, true AS mean_fits FROM"
    " (SELECT churn_flag, CAST((row_number() OVER (PARTITION BY churn_flag ORDER BY md5(customer_id || '42'), customer_id) - 1) % 5 AS INTEGER) AS fold"
    " FROM (SELECT *, row_number() OVER (PARTITION BY churn_flag ORDER BY md5(customer_id || '42'), customer_id) AS rk,"
    " count(*) OVER (PARTITION BY churn_flag) AS n FROM policyholders) WHERE rk > ceil(n * 0.2e0)) GROUP BY fold"))
def q_l29(spark, d):
    """Five folds of the early-stopped model. Sizes of the folds, whether each ranks its test part better than a
    constant would (and its own training part no worse than by chance), and whether the mean row is the mean of the folds."""
    table, scored = ml.cross_validated_report(policyholders(spark, d), ml.RECIPES["gbt_stopped"])
    table = materialize(table)
    sizes = None
    for k, part in enumerate(scored):
        one = part.agg(F.lit(k).alias("fold"), F.count("*").alias("test_size"), F.count_if(F.col("label") == 1).alias("positives"))
        sizes = one if sizes is None else sizes.unionByName(one)
    means = table.where("fold is null").select(*[F.col(c).alias(f"m_{c}") for c in table.columns[1:5]])
    folds = table.where("fold is not null")
    own = folds.agg(*[F.avg(c).alias(c) for c in table.columns[1:5]]).crossJoin(means).select(
        F.greatest(*[F.abs(F.col(c) - F.col(f"m_{c}")) for c in table.columns[1:5]]).alias("gap"))
    return sizes.join(folds, "fold").crossJoin(own).select(
        "fold", "test_size", "positives", ((F.col("test_auc") > ml.LEAST_AUC) & (F.col("train_auc") > ml.LEAST_AUC)).alias("beats_chance"),
        (F.col("gap") < 1e-9).alias("mean_fits"))


@register("l28_cv_rf_f2", _check_sql(0.2))
def q_l28(spark, d):
    """The F2 scorer, 5 folds, the whole grid (36 points from 2 fits a fold)."""
    return ml.record_check(searched(spark, d, "dummies_rf_f2")[1])


def _stack(spark, d, name: str):
    base, folds, threshold = ml.STACKS[name]
    return ml.record_check(ml.stacking(policyholders(spark, d), base, folds, threshold))


@register("l19_stacking_record", _check_sql(0.2))
def q_l19(spark, d):
    """The first stack, 3 folds, threshold 0.5."""
    return _stack(spark, d, "stack_1")


@register("l19_stacking_2_record", _check_sql(0.2))
def q_l19b(spark, d):
    """The second stack, 5 folds, the highest threshold with a recall of 0.8."""
    return _stack(spark, d, "stack_2")
