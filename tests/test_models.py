"""Model recipes: rows-only checks plus sanity (AUC range, probabilities in
[0, 1], persistence round trip) on the smallest folder with few iterations."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab.operators import models as ml
from churnlab.operators import prep
from churnlab.sources import io


def _metrics(rec):
    return {r.metric: r.value for r in rec.collect()}


def test_main_recipe_trains_and_scores(ph):
    r = ml.RECIPES["main"]
    res = ml.train_evaluate(r, ph, {"maxIter": 5})
    m = _metrics(res.record)
    assert 0.0 <= m["roc_auc"] <= 1.0
    assert m["test_size"] == m["tn"] + m["fp"] + m["fn"] + m["tp"]
    s = res.test_scores.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= s[0] <= s[1] <= 1.0
    assert len(res.feature_names) > 20


def test_model_bundle_roundtrip(ph):
    spark = ph.sparkSession
    r = ml.RECIPES["tenure_lr"]
    res = ml.train_evaluate(r, ph, {"maxIter": 20})
    path = io.scratch_path(spark, "test-model")
    io.save_model_bundle(res.model, res.threshold, path)
    model2, thr = io.load_model_bundle(spark, path)
    x, _, _ = ml.model_frame(ph, "tenure")
    x = x.withColumn("label", F.col("churn_flag").cast("double"))
    a = ml.probability(res.model, x).withColumnRenamed("score", "a")
    b = ml.probability(model2, x).select("customer_id", F.col("score").alias("b"))
    assert a.join(b, "customer_id").where(F.col("a") != F.col("b")).count() == 0
    assert thr == res.threshold


def test_stratified_split_proportions(ph):
    s = prep.stratified_split(ph, [("test", 0.2), ("train", 0.8)])
    counts = {(r.churn_flag, r.split): r["count"] for r in s.groupBy("churn_flag", "split").count().collect()}
    for y in (0, 1):
        n = counts.get((y, "test"), 0) + counts.get((y, "train"), 0)
        assert counts[(y, "test")] == -(-n * 2 // 10)


def test_preprocessor_unknown_category_is_all_zero(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", None)], "c string, x double")
    pre = prep.fit_preprocessor(train, ["x"], ["c"])
    test = spark.createDataFrame([("zzz", 2.0)], "c string, x double")
    v = pre.transform(test).select("features").first()[0].toArray().tolist()
    assert v == [2.0, 0.0, 0.0]


def test_cross_validate_refits_the_best_point(ph):
    table, best = ml.cross_validate(ml.RECIPES["tenure_lr"], ph, {"regParam": [0.0, 0.1]}, folds=2, overrides={"maxIter": 10})
    rows = table.collect()
    assert [r.params for r in rows] == ["regParam=0.0", "regParam=0.1"] and all(0 <= r.mean_metric <= 1 for r in rows)
    check = ml.record_check(best).first()
    assert check.bad_scores == check.bad_metrics == 0 and check.test_size == check.matrix_total > 0


def test_cross_validation_never_sees_the_test_part(ph, monkeypatch):
    """The label of every test row is broken; the fold scores don't move."""
    recipe = ml.RECIPES["tenure_lr"]
    plain, _ = ml.cross_validate(recipe, ph, {"regParam": [0.1]}, folds=2, overrides={"maxIter": 5})
    real = ml.stratified_split
    monkeypatch.setattr(ml, "stratified_split", lambda *a, **k: real(*a, **k).withColumn(
        "label", F.when(F.col("split") == "test", 1 - F.col("label")).otherwise(F.col("label"))))
    moved, _ = ml.cross_validate(recipe, ph, {"regParam": [0.1]}, folds=2, overrides={"maxIter": 5})
    assert plain.collect() == moved.collect()


def test_permutation_importance_in_one_pass(ph):
    """A column that the model doesn't use has no importance; grouped average precision equals the plain one."""
    from churnlab.operators import evaluate as ev
    res = ml.train_evaluate(ml.RECIPES["tenure_lr"], ph, {"maxIter": 20})
    x, _, _ = ml.labelled_frame(ml.RECIPES["tenure_lr"], ph)
    got = {r.feature: r for r in ml.permutation_importance(res, x, ["late_payment_count_12m", "autopay_enabled", "region_name"], 3).collect()}
    assert got["autopay_enabled"].importance_mean == got["region_name"].importance_mean == 0.0
    assert got["late_payment_count_12m"].importance_mean > 0 and got["late_payment_count_12m"].rank == 1
    assert abs(ml.average_precision(res, x) - ev.auc_scores(ml.probability(res.model, x)).first().pr_auc) < 1e-6


def test_the_order_of_sums_is_no_importance(ph, monkeypatch):
    """Equal precisions that were added up in another order differ in the last bits: an unused column still loses nothing."""
    res = ml.train_evaluate(ml.RECIPES["tenure_lr"], ph, {"maxIter": 5})
    x, _, _ = ml.labelled_frame(ml.RECIPES["tenure_lr"], ph)
    made = ml.average_precision
    monkeypatch.setattr(ml, "average_precision", lambda *a: made(*a) + 4e-16)
    unused = ml.permutation_importance(res, x, ["autopay_enabled"], 2).first()
    assert unused.importance_mean == 0.0 and unused.importance_std == 0.0


def test_early_stopping_keeps_the_best_round(ph):
    res = ml.early_stopping(ph, ml.RECIPES["gbt_stopped"], most=12, patience=3)
    assert 2 <= res.model.stages[-1].getNumTrees <= 13  # the constant first tree and the rounds
    assert ml.record_check(res).first().bad_metrics == 0


def test_stack_of_two_models(ph):
    base, folds, threshold = ml.STACKS["stack_1"]
    from dataclasses import replace
    small = [replace(r, params={**r.params, **({"maxIter": 3} if r.estimator == "gbt" else {"numTrees": 5})}) for r in base]
    assert ml.record_check(ml.stacking(ph, small, 2, threshold)).first().bad_scores == 0


def test_threshold_rules_never_fall_back_silently(spark, ph):
    import pytest
    scores = spark.createDataFrame([(0, 0.2), (0, 0.9)], "label int, score double")
    with pytest.raises(ValueError, match="no threshold"):
        ml.choose_threshold(ml.Recipe("x", "lr", "tenure", threshold=("recall", 0.8)), scores)
    with pytest.raises(ValueError, match="validation part"):
        ml.train_evaluate(ml.Recipe("x", "lr", "tenure", {"maxIter": 2}, threshold=("recall", 0.8)), ph)


def test_null_labels_raise_and_null_groups_rank(spark):
    import pytest
    from churnlab.operators import ranking
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 0)], "customer_id string, churn_flag int")
    with pytest.raises(Exception, match="needs a label"):
        prep.stratified_split(df, [("test", 0.5), ("train", 0.5)]).collect()
    ranked = ranking.rank_within_groups(df, "churn_flag", ["customer_id"], "rk").collect()
    assert sorted((r.customer_id, r.rk) for r in ranked) == [("a", 1), ("b", 1), ("c", 1)]


def test_recipes_hold_the_reference_parameters():
    """The values of the reference's training cells, as far as Spark has the parameter."""
    want = {
        "main": ("newton", 400, None, None, 0.05), "price_lr": ("lr", 2000, None, None, None), "rf_claims": ("rf", 100, 10, 3.0, None),
        "rf_claimants_anger": ("rf", 100, 10, 3.0, None), "gbt_claims": ("gbt", 500, 6, 3.0, 0.01),
        "rf_dummies": ("rf", 100, 30, 3.0, None), "rf_derived": ("rf", 200, 12, 5.0, None), "rf_numeric": ("rf", 300, 12, 4.0, None),
        "gbt_deep": ("newton", 200, 10, 4.0, 0.1), "gbt_subsample": ("newton", 300, 6, 1.5, 0.05), "lockin_1": ("gbt", 200, 6, 2.5, 0.05),
        "lockin_2": ("gbt", 300, 5, 2.5, 0.03), "rf_balanced": ("rf", 100, 10, None, None), "gbt_ratio": ("gbt", 100, 6, 1.0, 0.1),
        "gbt_stopped": ("newton", 5000, None, None, 0.1),
        "tenure_lr": ("lr", 5000, None, None, None), "tenure_rf": ("rf", 200, 30, None, None), "tenure_gbt": ("newton", 200, 5, None, 0.05),
        "contacts_lr": ("lr", 5000, None, None, None), "contacts_rf": ("rf", 200, 30, None, None),
        "contacts_gbt": ("newton", 200, 5, None, 0.05)}
    got = {n: (r.estimator, r.params.get("maxIter", r.params.get("numTrees")), r.params.get("maxDepth"),
               r.weight[1] if r.weight and len(r.weight) > 1 else None, r.params.get("stepSize")) for n, r in ml.RECIPES.items()}
    assert got == want
    # leaves, rows of a leaf, L2 term, columns per tree
    assert {n: tuple(r.params.get(k) for k in ("maxLeaves", "minInstancesPerNode", "l2", "columnsPerTree")) for n, r in ml.RECIPES.items()
            if r.estimator == "newton"} == {"main": (31, 20, 0.0, None), "gbt_stopped": (31, 20, 0.0, None), "gbt_deep": (31, 20, 1.5, None),
                                            "gbt_subsample": (None, 1, 1.0, 0.8), "tenure_gbt": (None, 1, 1.0, 0.8), "contacts_gbt": (None, 1, 1.0, 0.8)}
    assert {n: r.threshold[1] for n, r in ml.RECIPES.items() if r.threshold[0] == "fixed" and r.threshold[1] != 0.5} == {
        "rf_claimants_anger": 0.4, "gbt_claims": 0.44, "rf_numeric": 0.45, "gbt_deep": 0.45, "gbt_subsample": 0.45}


def test_a_constant_score_fails_the_record_check(ph):
    """What every model query compares with SQL turns red if a model gives everybody the same score."""
    from dataclasses import replace
    from churnlab.operators import evaluate as ev
    res = ml.train_evaluate(ml.RECIPES["tenure_lr"], ph, {"maxIter": 20})
    flat = res.test_scores.withColumn("score", F.lit(0.5))
    assert ml.record_check(res).first().separates is True
    assert ml.record_check(replace(res, test_scores=flat, record=ev.evaluation_record(flat, 0.5))).first().separates is False
    assert ml.record_check(replace(res, test_scores=flat)).first().separates is False  # another model's record


def test_trend_equals_the_two_rates_and_handles_edges(spark):
    rows = [(0, 0)] * 30 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 15 + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "x int, churn_flag int")
    assert {r.value: r.churn_probability for r in ml.logistic_trend(df, "x").collect()} == {0.0: 0.25, 1.0: 0.75}
    one = spark.createDataFrame([(3, 1), (3, 0), (3, 0), (3, 0)], "x int, churn_flag int")
    assert [tuple(r) for r in ml.logistic_trend(one, "x").collect()] == [("x", 3.0, 0.25)]
    apart = {r.value: r.churn_probability for r in ml.logistic_trend(spark.createDataFrame([(0, 0), (1, 1)] * 9, "x int, churn_flag int"), "x").collect()}
    assert apart[0.0] < 1e-4 and apart[1.0] > 1 - 1e-4
    assert ml.logistic_trend(spark.createDataFrame([], "x int, churn_flag int"), "x").collect() == []


def test_preprocessor_values(spark):
    """L2, L3: medians between the middle values, population scaling, the mode with the smallest name, one-hot slots by name."""
    train = spark.createDataFrame([("b", 1.0), ("a", 4.0), ("b", None), (None, 2.0), ("a", 9.0)], "c string, x double")
    rows = lambda scale: [r[0].toArray().tolist() for r in prep.fit_preprocessor(train, ["x"], ["c"], scale=scale).transform(train).select("features").collect()]
    assert rows(False) == [[1.0, 0.0, 1.0], [4.0, 1.0, 0.0], [3.0, 0.0, 1.0], [2.0, 1.0, 0.0], [9.0, 1.0, 0.0]]
    x = [1.0, 4.0, 3.0, 2.0, 9.0]
    mean = sum(x) / 5
    std = (sum((v - mean) ** 2 for v in x) / 5) ** 0.5
    assert all(abs(r[0] - (v - mean) / std) < 1e-12 for r, v in zip(rows(True), x))


def test_columns_that_a_table_may_lack(ph):
    """An optional column makes its feature, a missing one is tolerated."""
    from churnlab.functions import features as fx
    from churnlab.operators import clean
    with_six = ph.withColumn("num_claims_6m", F.lit(2))
    got = fx.recent_activity_ratio(with_six).select("recent_activity_ratio", (F.lit(2) / (F.col("num_claims_12m") / 2 + 0.1)).alias("want")).collect()
    assert all(a is None and b is None or abs(a - b) < 1e-12 for a, b in got) and "recent_activity_ratio" not in fx.recent_activity_ratio(ph).columns
    _, nums, _ = ml.model_frame(with_six, "derived")
    assert "recent_activity_ratio" in nums
    few = ph.drop("as_of_date", "avg_claim_amount")
    for drop in (clean.drop_unused, clean.drop_redundant):
        assert drop(few).columns == [c for c in drop(ph).columns if c in few.columns]


def test_any_beta_has_its_own_threshold(spark):
    from churnlab.operators import evaluate as ev
    import random
    rng = random.Random(4)
    rows = [(int(rng.random() < s), s) for s in (rng.random() for _ in range(400))]
    df = spark.createDataFrame(rows, "label int, score double")
    cuts = [ev.choose_threshold_fbeta(df, b).first().threshold for b in (0.25, 0.5, 1.0, 2.0, 4.0)]
    assert cuts == sorted(cuts, reverse=True) and len(set(cuts)) > 2


def test_shuffled_copies_are_scored_in_several_tasks(ph, monkeypatch):
    """A test part of one file: its copies don't all go through the task that reads it."""
    res = ml.train_evaluate(ml.RECIPES["tenure_lr"], ph)
    x, nums, _ = ml.labelled_frame(ml.RECIPES["tenure_lr"], ph)
    made, tasks = ml.probability, []

    def counted(model, df, keep=("customer_id", "label")):
        if "_c" in df.columns:
            tasks.append(df.rdd.getNumPartitions())
        return made(model, df, keep)

    monkeypatch.setattr(ml, "probability", counted)
    monkeypatch.setattr(ml, "COPIES", 100, raising=False)
    found = ml.permutation_importance(res, x.limit(60), nums[:4], 3).count()
    assert found == 4 and tasks == [7]
    assert ml.copy_tasks(50, 8) == 1 and ml.copy_tasks(10 ** 9, 8) == -(-10 ** 9 // ml.MOST_COPIES)


def test_stages_are_trained_at_once(spark, monkeypatch):
    """EV17: each of the four trainings waits until the others have begun."""
    from threading import Barrier

    from churnlab.plans import q_models
    met = Barrier(4, timeout=20)
    monkeypatch.setattr(q_models, "policyholders", lambda *a: None)
    monkeypatch.setattr(q_models, "searched", lambda spark, d, name: met.wait() >= 0 and (None, name))
    monkeypatch.setattr(q_models, "trained", lambda spark, d, name: met.wait() >= 0 and name)
    assert q_models._stages(spark, "x") == {"1 baseline": ("rf_claims", 0.5), "2 tuned": ("claims_rf", 0.5), "3 claimants": ("rf_claimants_anger", 0.5),
                                            "4 lower threshold": ("rf_claimants_anger", 0.4), "5 boosted": ("gbt_claims", 0.44)}
