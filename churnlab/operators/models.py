"""Model recipes, training flow, tuning, stacking and importances
(survey L7-L28, EV13-EV17, A40, IO8).

Estimators are Spark ML (distributed tree/LR training). A recipe names a
feature set, an estimator with parameters, a class-weight rule and a threshold
rule; ``train_evaluate`` runs split -> fit -> choose threshold on validation
-> refit on train+validation -> evaluate on test. The recipes hold the
reference's parameters, and the registered queries train with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from churnlab.functions import features as fx
from churnlab.operators import boosting
from churnlab.operators import evaluate as ev
from churnlab.operators import forests
from churnlab.operators import newton
from churnlab.operators import trees
from churnlab.session import materialize
from churnlab.operators.clean import LEAKAGE_COLUMNS
from churnlab.operators.clean import inf_to_zero
from churnlab.operators.prep import class_weights, dummy_levels, feature_names, fit_preprocessor, stratified_split

LABEL = "churn_flag"
STRING_COLUMNS = ["region_name", "age_band", "marital_status", "policy_type", "payment_frequency"]

# Feature lists of the reference's hypothesis models.
TENURE_FEATURES = ["customer_tenure_months", "age", "num_policies", "multi_policy_flag", "current_premium",
                   "premium_change_pct", "premium_last_year", "late_payment_count_12m", "missed_payment_flag",
                   "complaint_flag", "quote_requested_flag", "coverage_downgrade_flag", "renewal_month"]
CONTACT_FEATURES = ["num_contacts_12m"] + TENURE_FEATURES
LOCKIN_1 = ["multi_policy_flag", "num_policies", "policy_type", "is_auto", "is_home"]
LOCKIN_2 = ["multi_policy_flag", "policy_type", "customer_tenure_months", "premium_change_pct",
            "late_payment_count_12m", "quote_requested_flag", "complaint_flag", "payout_ratio_12m"]
DUMMIES_DROP = ["customer_id", "as_of_date", "age_band", "churn_flag", "churn_type", "churn_probability_true",
                "num_approved_claims_12m", "num_pending_claims_12m", "current_premium", "premium_last_year"]
NUMERIC_DROP = ["churn_flag", "churn_type", "churn_probability_true", "total_payout_amount_12m", "premium_last_year",
                "customer_id"]
PRICE_FEATURES = ["current_premium", "premium_last_year", "premium_change_pct", "num_price_increases_last_3y",
                  "policy_type"]


def model_frame(df: DataFrame, feature_set: str) -> tuple[DataFrame, list[str], list[str]]:
    """(frame with label + key, numeric feature columns, string feature columns)."""
    a = fx.analysis_feature_exprs()
    base = df
    if feature_set == "main":
        x = fx.add_engineered_features(df)
        cols = [c for c in x.columns if c not in LEAKAGE_COLUMNS + [LABEL]]
    elif feature_set == "claims":
        x = df.withColumns({"is_rejected": a["is_rejected"], "unpaid_ratio": a["unpaid_ratio"]})
        cols = [c for c in x.columns if c not in LEAKAGE_COLUMNS + [LABEL]]
    elif feature_set == "claimants_anger":
        x = df.where(F.col("num_claims_12m") > 0).withColumns(
            {"is_rejected": a["is_rejected"], "anger_index": a["anger_index_binary"]})
        cols = [c for c in x.columns if c not in LEAKAGE_COLUMNS + [LABEL]]
    elif feature_set in ("dummies", "derived"):
        x, cols = _with_dummies(df, DUMMIES_DROP)
        if feature_set == "derived":
            x, cols = _with_derived(x, cols)
            x = fx.recent_activity_ratio(x)
            cols += [c for c in ("recent_activity_ratio",) if c in x.columns]
    elif feature_set in ("numeric", "numeric_derived"):
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != LABEL
                and f.name not in LEAKAGE_COLUMNS]
        x = df
        if feature_set == "numeric_derived":
            x, cols = _with_derived(df, [c for c in cols if c not in NUMERIC_DROP])
    elif feature_set in ("lockin_1", "lockin_2"):
        x = df.withColumns({"is_auto": a["is_auto"], "is_home": a["is_home"]})
        cols = LOCKIN_1 if feature_set == "lockin_1" else LOCKIN_2
    elif feature_set == "tenure":
        x, cols = base, TENURE_FEATURES
    elif feature_set == "contacts":
        x, cols = base, CONTACT_FEATURES
    elif feature_set == "price":
        x, cols = base, PRICE_FEATURES
    else:
        raise ValueError(f"unknown feature set {feature_set}")
    types = dict(x.dtypes)
    cats = [c for c in cols if types[c] == "string"]
    nums = [c for c in cols if c not in cats]
    return x, nums, cats


def _with_dummies(df: DataFrame, drop: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Drop-first dummies (L5) of the string columns that are left, next to the numeric ones."""
    kept = [f for f in df.schema.fields if f.name not in [*drop, LABEL]]
    strings = [f.name for f in kept if not isinstance(f.dataType, NumericType)]
    levels = dummy_levels(df, strings)
    made = {f"{c}_{v}": (F.col(c) == F.lit(v)).cast("int") for c in strings for v in levels[c][1:]}
    return df.withColumns(made), [f.name for f in kept if f.name not in strings] + list(made)


def _with_derived(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    a = fx.analysis_feature_exprs()
    made = {"anger_index": a["anger_index_count"], "claim_approval_rate": a["claim_approval_rate"],
            "loyalty_pain_score": a["loyalty_pain_score"]}
    return df.withColumns(made), cols + list(made)


@dataclass(frozen=True)
class Recipe:
    name: str
    estimator: str                      # gbt | newton (operators/newton.py) | rf | lr
    feature_set: str
    params: dict = field(default_factory=dict)
    weight: tuple | None = None         # ("fixed", w) | ("balanced",) | ("ratio", k)
    threshold: tuple = ("fixed", 0.5)   # ("fixed", t) | ("fbeta", beta, min_p, min_r) | ("recall", r) | ("accuracy",)
    split: tuple = (("test", 0.2), ("train", 0.8))
    scale: bool = False
    zero_fill: bool = False             # missing and infinite values become 0 before the split


# The recipes of the reference. A tree without a depth limit takes Spark's limit of 30; boosted trees stand
# in for the boosting libraries. ``minRowsToSplit`` is no parameter of Spark: the fitted trees are pruned to it.
NO_LIMIT = 30
MIN_SPLIT = "minRowsToSplit"
_QUARTER = (("test", 0.25), ("train", 0.75))
# Defaults of a learner that grows by depth: no limit of leaves, single rows as leaves, 256 bins, L2 term 1.
_BY_DEPTH = {"maxLeaves": None, "minInstancesPerNode": 1, "maxBins": 256, "l2": 1.0}
# Defaults of Spark's boosted classifier.
_SPARK_BOOSTED = {"maxLeaves": None, "minInstancesPerNode": 1, "maxBins": 32, "maxDepth": 5}
RECIPES = {r.name: r for r in [
    Recipe("main", "newton", "main", {"stepSize": 0.05, "maxIter": 400, "maxLeaves": 31, "minInstancesPerNode": 20, "maxBins": 255, "l2": 0.0},
           threshold=("fbeta", 2.0, 0.3, 0.85), split=(("test", 0.2), ("valid", 0.2), ("train", 0.6))),
    Recipe("price_lr", "lr", "price", {"maxIter": 2000}, scale=True),
    Recipe("rf_claims", "rf", "claims", {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 5}, weight=("fixed", 3.0)),
    Recipe("rf_claimants_anger", "rf", "claimants_anger", {"numTrees": 100, "maxDepth": 10}, weight=("fixed", 3.0),
           threshold=("fixed", 0.4)),
    Recipe("gbt_claims", "gbt", "claims", {"maxIter": 500, "stepSize": 0.01, "maxDepth": 6}, weight=("fixed", 3.0),
           threshold=("fixed", 0.44)),
    Recipe("rf_dummies", "rf", "dummies", {"numTrees": 100, "maxDepth": NO_LIMIT}, weight=("fixed", 3.0)),
    Recipe("rf_derived", "rf", "derived", {"numTrees": 200, "maxDepth": 12, MIN_SPLIT: 5}, weight=("fixed", 5.0)),
    Recipe("rf_numeric", "rf", "numeric_derived", {"numTrees": 300, "maxDepth": 12, MIN_SPLIT: 5}, weight=("fixed", 4.0),
           threshold=("fixed", 0.45), zero_fill=True),
    Recipe("gbt_deep", "newton", "numeric_derived", {"maxIter": 200, "stepSize": 0.1, "maxDepth": 10, "maxLeaves": 31, "minInstancesPerNode": 20,
                                                     "maxBins": 255, "l2": 1.5}, weight=("fixed", 4.0),
           threshold=("fixed", 0.45)),
    Recipe("gbt_subsample", "newton", "numeric_derived",
           {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, "columnsPerTree": 0.8, **_BY_DEPTH},
           weight=("ratio", 1.5), threshold=("fixed", 0.45)),
    Recipe("lockin_1", "gbt", "lockin_1", {"maxIter": 200, "stepSize": 0.05, "maxDepth": 6}, weight=("ratio", 2.5)),
    Recipe("lockin_2", "gbt", "lockin_2", {"maxIter": 300, "stepSize": 0.03, "maxDepth": 5}, weight=("ratio", 2.5)),
    Recipe("rf_balanced", "rf", "numeric", {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 30,
                                            "featureSubsetStrategy": "sqrt"}, weight=("balanced",)),
    Recipe("gbt_ratio", "gbt", "numeric", {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6}, weight=("ratio", 1.0)),
    # The learner of the early-stopped model has the defaults of the main model's.
    Recipe("gbt_stopped", "newton", "numeric", {"maxIter": 5000, "stepSize": 0.1, "maxLeaves": 31, "minInstancesPerNode": 20, "maxBins": 255, "l2": 0.0}),
    *[Recipe(f"{name}_{kind}", "newton" if kind == "gbt" else kind, name, params, split=_QUARTER)
      for name in ("tenure", "contacts")
      for kind, params in (("lr", {"maxIter": 5000}), ("rf", {"numTrees": 200, "maxDepth": NO_LIMIT}),
                           ("gbt", {"maxIter": 200, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, "columnsPerTree": 0.8, **_BY_DEPTH}))],
]}

# The two stacks of the reference (base learners, folds, threshold).
STACKS = {
    "stack_1": ((Recipe("s1_gbt", "gbt", "lockin_2", {"maxIter": 200, "stepSize": 0.03, "maxDepth": 5}, weight=("fixed", 3.47)),
                 Recipe("s1_rf", "rf", "lockin_2", {"numTrees": 200, "maxDepth": 8}, weight=("fixed", 5.0))),
                3, ("fixed", 0.5)),
    "stack_2": ((Recipe("s2_gbt", "gbt", "lockin_2", {"maxIter": 250, "stepSize": 0.02, "maxDepth": 6}, weight=("fixed", 4.0)),
                 Recipe("s2_rf", "rf", "lockin_2", {"numTrees": 250, "maxDepth": 10}, weight=("fixed", 7.0))),
                5, ("recall", 0.80)),
}


def make_estimator(recipe: Recipe, weighted: bool, overrides: dict | None = None):
    params = {k: v for k, v in {**recipe.params, **(overrides or {})}.items() if k != MIN_SPLIT}
    common = {"featuresCol": "features", "labelCol": "label"}
    if weighted:
        common["weightCol"] = "weight"
    if recipe.estimator == "gbt":
        return GBTClassifier(seed=42, **common, **params)
    if recipe.estimator == "rf":
        return RandomForestClassifier(seed=42, **common, **params)
    return LogisticRegression(**common, **params)


def _with_weights(df: DataFrame, recipe: Recipe) -> DataFrame:
    if recipe.weight is None:
        return df
    kind = recipe.weight[0]
    if kind == "fixed":
        return class_weights(df, "label", recipe.weight[1])
    if kind == "balanced":
        return class_weights(df, "label", "balanced")
    return class_weights(df, "label", "ratio", recipe.weight[1])


def fit(recipe: Recipe, train: DataFrame, nums: Sequence[str], cats: Sequence[str],
        overrides: dict | None = None) -> PipelineModel:
    """Preprocessor fitted on ``train`` only, then the estimator; one PipelineModel."""
    pre = fit_preprocessor(train, nums, cats, scale=recipe.scale)
    columns = ["features", "label", *(["weight"] if recipe.weight else [])]
    data = _with_weights(pre.transform(train), recipe).select(*columns).persist()  # read once per tree level
    params = {**recipe.params, **(overrides or {})}
    try:
        if recipe.estimator == "newton":
            est, _ = newton.newton_rounds(data, newton.growth_of(params), params["maxIter"])
        elif recipe.estimator == "gbt" and set(params) <= {"maxIter", "stepSize", "maxDepth"}:  # nothing is drawn at random
            est = newton.gradient_rounds(data, newton.growth_of({**_SPARK_BOOSTED, **params}), params["maxIter"])
        elif recipe.estimator == "rf":
            est = forests.fit_forest(data, forests.forest_of(params))
        else:
            est = make_estimator(recipe, recipe.weight is not None, overrides).fit(data)
    finally:
        data.unpersist()
    if recipe.estimator != "rf" and (least := params.get(MIN_SPLIT)):
        est = trees.reduced(est, train.sparkSession, min_split=least)
    return PipelineModel(stages=list(pre.stages) + [est])


def probability(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("customer_id", "label")) -> DataFrame:
    """(keep..., score) with score = P(class 1)."""
    out = model.transform(df)
    return out.select(*keep, vector_to_array(F.col("probability"))[1].alias("score"))


def choose_threshold(recipe: Recipe, scores: DataFrame) -> float:
    """EV11 rule of the recipe -> one scalar (from a one-row aggregate)."""
    rule = recipe.threshold
    if rule[0] == "fixed":
        return float(rule[1])
    if rule[0] == "fbeta":
        row = ev.choose_threshold_fbeta(scores, rule[1], rule[2], rule[3]).first()
    elif rule[0] == "recall":
        row = ev.choose_threshold_recall(scores, rule[1]).first()
    else:
        row = ev.choose_threshold_accuracy(scores).first()
    if row is None or row["threshold"] is None:
        raise ValueError(f"{recipe.name}: no threshold meets {rule}")
    return float(row["threshold"])


@dataclass
class TrainResult:
    model: PipelineModel
    threshold: float
    record: DataFrame
    test_scores: DataFrame
    feature_names: list[str]


def train_evaluate(recipe: Recipe, df: DataFrame, overrides: dict | None = None, seed: int = 42) -> TrainResult:
    """Split -> fit on train -> threshold on validation (if the split has
    one) -> refit on train + validation -> evaluation record on test (EV9)."""
    x, nums, cats = labelled_frame(recipe, df)
    parts = materialize(stratified_split(x, list(recipe.split), label=LABEL, seed=seed))
    train, test = (parts.where(F.col("split") == name) for name in ("train", "test"))
    whole = lambda: fit(recipe, parts.where(F.col("split") != "test"), nums, cats, overrides)
    if recipe.threshold[0] == "fixed":
        threshold, model = float(recipe.threshold[1]), whole()
    elif any(n == "valid" for n, _ in recipe.split):
        # The refit does not need the threshold: both fits run at once.
        first, model = at_once(lambda made: made(), [lambda: fit(recipe, train, nums, cats, overrides), whole], 2)
        threshold = choose_threshold(recipe, probability(first, parts.where(F.col("split") == "valid")))
    else:
        raise ValueError(f"{recipe.name}: a threshold rule needs a validation part")
    test_scores = materialize(probability(model, test))
    names = feature_names(model.transform(test.limit(1)))
    return TrainResult(model, threshold, ev.evaluation_record(test_scores, threshold), test_scores, names)


def labelled_frame(recipe: Recipe, df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    x, nums, cats = model_frame(df, recipe.feature_set)
    if recipe.zero_fill:
        x = inf_to_zero(x.withColumns({c: F.col(c).cast("double") for c in nums}), nums).fillna(0, nums)
    return x.withColumn("label", F.col(LABEL).cast("double")), nums, cats


#: A fitted model ranks churners better than this; a constant score has 0.5.
LEAST_AUC = 0.53


def record_check(result: TrainResult) -> DataFrame:
    """The record's sizes, and how many of its own figures contradict each other: what holds for any model.

    One row: test_size, actual_positive, matrix_total (cells of the confusion matrix), bad_scores (probabilities
    outside [0, 1] or missing), bad_metrics (accuracy, precision, recall, F1 and F2 that differ from the matrix by over
    1e-6, or an AUC outside [0, 1]), separates (the AUC of the scores, counted anew from the ranks, is the record's and
    lies above 0.5 by more than the ties of a constant or random score would give).
    """
    r = {m.metric: m.value for m in result.record.collect()}  # 15 rows
    tp, fp, tn, fn = (r[k] for k in ("tp", "fp", "tn", "fn"))
    share = lambda a, b: a / b if b else 0.0
    p, q = share(tp, tp + fp), share(tp, tp + fn)
    want = {"accuracy": share(tp + tn, tp + fp + tn + fn), "precision": p, "recall": q,
            "f1": share(2 * p * q, p + q), "f2": share(5 * p * q, 4 * p + q)}
    bad = sum(abs(r[k] - v) > 1e-6 for k, v in want.items()) + sum(not 0 <= r[k] <= 1 for k in ("roc_auc", "pr_auc"))
    s = F.col("score")
    auc = ev.auc_scores(result.test_scores).first()["roc_auc"]
    separates = auc is not None and abs(auc - r["roc_auc"]) <= 1e-6 and auc > LEAST_AUC
    return result.test_scores.agg(
        F.lit(bool(separates)).alias("separates"), F.count("*").alias("test_size"), F.count_if(F.col("label") == 1).alias("actual_positive"),
        F.lit(int(tp + fp + tn + fn)).cast("long").alias("matrix_total"),
        F.count_if(s.isNull() | F.isnan(s) | (s < 0) | (s > 1)).alias("bad_scores"),
        F.lit(int(bad)).cast("long").alias("bad_metrics"))


def tree_importances(result: TrainResult, k: int | None = None) -> DataFrame:
    """EV13: feature importances of a tree model by name, top k (EV14 filters it)."""
    est = result.model.stages[-1]
    imp = est.featureImportances.toArray().tolist()
    spark = result.test_scores.sparkSession
    df = spark.createDataFrame(list(zip(result.feature_names, [float(v) for v in imp])), "feature string, importance double")
    df = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))
    return df.where(F.col("rank") <= k) if k else df


def importance_differences(result: TrainResult) -> DataFrame:
    """EV13: (feature, importance, counted): Spark's importance next to the one counted from the node table."""
    spark = result.test_scores.sparkSession
    counted = trees.save_trees(result.model.stages[-1], spark).importances()
    given = result.model.stages[-1].featureImportances.toArray().tolist()
    slots = spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(zip(result.feature_names, given))], "slot int, feature string, importance double")
    return slots.join(counted.withColumnRenamed("importance", "counted"), "slot", "left").select(
        "feature", "importance", F.coalesce("counted", F.lit(0.0)).alias("counted"))


def rank_label(top: int = 7):
    """EV14: the rank as text, or that it lies outside the top."""
    return F.when(F.col("rank") <= top, F.col("rank").cast("string")).otherwise(F.lit(f"outside top {top}"))


def _stopped(recipe: Recipe, train: DataFrame, nums: Sequence[str], cats: Sequence[str], most: int, patience: int, valid: float,
             seed: int) -> PipelineModel:
    """Preprocessor and boosted trees on ``train``, a share of which only decides when to stop."""
    inner = materialize(stratified_split(train, [("valid", valid), ("fit", 1 - valid)], label=LABEL, seed=seed + 1))
    pre = fit_preprocessor(train, nums, cats)
    part = lambda name: pre.transform(inner.where(F.col("split") == name)).select("features", "label")
    if recipe.estimator == "newton":
        model, _ = newton.newton_rounds(part("fit"), newton.growth_of(recipe.params), most, part("valid"), patience, seed)
    else:
        params = {k: v for k, v in recipe.params.items() if k not in ("maxIter", "stepSize")}
        model = boosting.boost_until(part("fit"), part("valid"), most, patience, recipe.params["stepSize"], params, seed).model
    return PipelineModel(stages=list(pre.stages) + [model])


def early_stopping(df: DataFrame, recipe: Recipe, most: int = 5000, patience: int = 20, valid: float = 0.2,
                   seed: int = 42) -> TrainResult:
    """Boosting that stops after ``patience`` rounds without a better loss on a fifth of the training part, and keeps
    the rounds up to the best one."""
    x, nums, cats = labelled_frame(recipe, df)
    parts = materialize(stratified_split(x, [("test", 0.2), ("train", 0.8)], label=LABEL, seed=seed))
    train, test = (parts.where(F.col("split") == name).drop("split") for name in ("train", "test"))
    whole = _stopped(recipe, train, nums, cats, most, patience, valid, seed)
    scores = materialize(probability(whole, test))
    return TrainResult(whole, 0.5, ev.evaluation_record(scores, 0.5), scores, feature_names(whole.transform(test.limit(1))))


def stratified_folds(df: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: the rows of each class are dealt out in turn, in the order of a seeded hash."""
    from churnlab.operators.ranking import rank_within_groups
    h = F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(str(seed))))
    ranked = rank_within_groups(df.withColumn("_h", h), LABEL, [F.col("_h"), F.col("customer_id")], "_rk")
    return ranked.withColumn("fold", ((F.col("_rk") - 1) % folds).cast("int")).drop("_h", "_rk")


def cross_validated_report(df: DataFrame, recipe: Recipe, folds: int = 5, most: int = 5000, patience: int = 20, valid: float = 0.2,
                           seed: int = 42, parallelism: int = 5) -> tuple[DataFrame, list[DataFrame]]:
    """F1 (at 0.5) and ROC-AUC of the early-stopped model on the training and the test part of each fold of the
    training part, and their means (fold null); the scored test parts come with it.

    The folds are independent fits, submitted together; each holds out a fifth of its own rows to know when to stop.
    """
    x, nums, cats = labelled_frame(recipe, df)
    train = stratified_split(x, [("test", 0.2), ("train", 0.8)], label=LABEL, seed=seed).where(F.col("split") == "train").drop("split")
    dealt = materialize(stratified_folds(train, folds, seed))

    def one(k: int) -> tuple[tuple, DataFrame]:
        inner, outer = dealt.where(F.col("fold") != k).drop("fold"), dealt.where(F.col("fold") == k).drop("fold")
        model, out, scored = _stopped(recipe, inner, nums, cats, most, patience, valid, seed), [], None
        for part in (inner, outer):
            scored = materialize(probability(model, part))
            row = scored.transform(lambda s: ev.threshold_metrics(s, 0.5)).crossJoin(ev.auc_scores(scored)).first()
            out += [row["f1"], row["roc_auc"]]
        return (k, *map(float, out), model.stages[-1].getNumTrees), scored

    done = at_once(one, range(folds), parallelism)
    table = df.sparkSession.createDataFrame(
        [row for row, _ in done], "fold int, train_f1 double, train_auc double, test_f1 double, test_auc double, rounds int")
    means = table.agg(F.lit(None).cast("int").alias("fold"), *[F.avg(c).alias(c) for c in table.columns[1:5]], F.lit(None).cast("int").alias("rounds"))
    return table.unionByName(means), [scored for _, scored in done]


def lr_coefficients(result: TrainResult) -> DataFrame:
    """Coefficient per feature with its absolute value rank."""
    est = result.model.stages[-1]
    coefs = est.coefficients.toArray().tolist()
    spark = result.test_scores.sparkSession
    df = spark.createDataFrame(list(zip(result.feature_names, [float(v) for v in coefs])), "feature string, coefficient double")
    return df.withColumn("abs_rank", F.row_number().over(Window.orderBy(F.abs("coefficient").desc(), "feature")))


#: Grid keys that a fit with the largest value serves for all values, and how a smaller value is cut out of it.
_FAMILY = {"rf": {"numTrees": "trees", "maxDepth": "max_depth", MIN_SPLIT: "min_split"}, "gbt": {"maxIter": "trees"}, "lr": {}}


def families(estimator: str, grid: dict[str, list]) -> list[tuple[dict, list[tuple[dict, dict]]]]:
    """Fits that a grid needs: (parameters of the fit, [(grid point, limits that cut it out of the fit)]).

    The first trees of a boosted fit are the fit with fewer rounds. The trees of a forest are grown independently of each
    other, and a split depends on the rows of its node: a forest with fewer trees, a smaller depth or more rows to split is
    a part of the largest one. Weights are fitted one by one.
    """
    names = [k for k in grid if k != "weight"]
    derived = {k: limit for k, limit in _FAMILY[estimator].items() if k in grid}
    largest = {k: max(grid[k]) for k in derived if k != MIN_SPLIT}
    fits: dict[tuple, tuple[dict, list]] = {}
    for values in product(*[grid[k] for k in names]):
        point = dict(zip(names, values))
        own = {k: v for k, v in point.items() if k not in derived}
        limits = {limit: point[k] for k, limit in derived.items() if k == MIN_SPLIT and point[k] > 2 or k != MIN_SPLIT and point[k] != largest[k]}
        fits.setdefault(tuple(own.values()), ({**own, **largest}, []))[1].append((point, limits))
    return list(fits.values())


def cross_validate(recipe: Recipe, df: DataFrame, grid: dict[str, list], folds: int = 3, metric: str = "f1",
                   overrides: dict | None = None, seed: int = 42, parallelism: int = 8) -> tuple[DataFrame, TrainResult]:
    """Grid search on the training part alone; (params, mean metric per point; refit of the best point).

    The preprocessor is fitted inside each fold. A grid key is a Spark parameter, ``C``, ``weight`` (rules as in
    ``Recipe``) or ``minRowsToSplit``. ``metric``: ``f1`` or ``f2`` of class 1 at 0.5, or ``auc``. Points that differ only
    in what can be cut out of one fitted ensemble share it (``families``). The first of the best points is fitted to the
    whole training part and evaluated on the test part.
    """
    x, nums, cats = labelled_frame(recipe, df)
    parts = materialize(stratified_split(x, list(recipe.split), label=LABEL, seed=seed))
    train = parts.where(F.col("split") != "test").withColumn(
        "fold", F.pmod(F.xxhash64("customer_id", F.lit(seed)), F.lit(folds)).cast("int"))
    rules = grid.get("weight", [recipe.weight])
    fits = [(w, *family) for w in range(len(rules)) for family in families(recipe.estimator, {k: v for k, v in grid.items() if k != "weight"})]
    if metric == "auc":
        evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC")
    else:
        evaluator = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", beta=float(metric[1:]), metricLabel=1.0)

    def prepared(k: int) -> tuple[list[DataFrame], DataFrame, int, int]:
        inner = train.where(F.col("fold") != k)
        pre = fit_preprocessor(inner, nums, cats, scale=recipe.scale)
        vectors = materialize(pre.transform(inner).select("features", "label"))
        held = pre.transform(train.where(F.col("fold") == k)).select("features", "label").persist()
        weighted = [_with_weights(vectors, replace(recipe, weight=rule)) for rule in rules]
        if recipe.estimator != "rf":  # a forest reads its rows once
            weighted = [frame.persist() for frame in weighted]
        return weighted, held, vectors.count(), max(1, held.count() // forests.FEWEST)

    data = at_once(prepared, range(folds), folds)

    def values(job: tuple) -> list[tuple[int, dict, float]]:
        k, (w, params, points) = job
        weighted, held, n, tasks = data[k]
        if recipe.estimator == "rf":
            forest = forests.fit_forest(weighted[w], forests.forest_of({**recipe.params, **(overrides or {}), **params}))
            if metric == "auc":
                return [(w, point, evaluator.evaluate(forest.limited(**limits).transform(held))) for point, limits in points]
            measured = forest_f_measures(forest, held.coalesce(tasks), [limits for _, limits in points], float(metric[1:]))
            return [(w, point, value) for (point, _), value in zip(points, measured)]
        est = make_estimator(replace(recipe, weight=rules[w]), rules[w] is not None, {**(overrides or {}), **_spark_params(params, n)})
        fitted = est.fit(weighted[w])
        cut = [limits for _, limits in points if limits]
        made = iter(trees.save_trees(fitted, df.sparkSession).reduced_each(cut) if cut else [])
        return [(w, point, evaluator.evaluate((next(made).load() if limits else fitted).transform(held))) for point, limits in points]

    found: dict[tuple, float] = {}
    # The fits of a forest hold no rows, so those of all folds go together; others keep the rows of one fold in memory.
    for some in [range(folds)] if recipe.estimator == "rf" else [[k] for k in range(folds)]:
        for part in at_once(values, [(k, f) for k in some for f in fits], parallelism):
            for w, point, value in part:
                key = (w, tuple(point.items()))
                found[key] = found.get(key, 0.0) + value / folds
        for k in some:
            for frame in (*data[k][0], data[k][1]):
                frame.unpersist()
    order = {key: i for i, key in enumerate((w, tuple(zip([n for n in grid if n != "weight"], v))) for w in range(len(rules))
                                            for v in product(*[v for n, v in grid.items() if n != "weight"]))}
    described = lambda w, point: ", ".join(f"{k}={v}" for k, v in sorted(
        {**dict(point), **({"weight": rules[w]} if "weight" in grid else {})}.items()))
    table = df.sparkSession.createDataFrame([(described(*key), found[key]) for key in order], "params string, mean_metric double")
    w, point = max(found, key=lambda key: (found[key], -order[key]))
    params = _spark_params(dict(point), train.count())
    tuned = replace(recipe, weight=rules[w], params={**recipe.params, **(overrides or {}), **params})
    return table, train_evaluate(tuned, df, seed=seed)


def forest_f_measures(forest: forests.ForestModel, held: DataFrame, limits: list[dict], beta: float) -> list[float]:
    """F measure of class 1 by each limited forest, from one job over (features, label): the driver plans and follows one
    query for all points of a grid that share a fit."""
    scored = held.select("label", forest.shares(held.sparkSession, limits).alias("p"))
    hits = [F.col("p")[i] > 0.5 for i in range(len(limits))]
    positive, *counted = scored.agg(F.count_if(F.col("label") == 1), *[F.count_if(h) for h in hits],
                                    *[F.count_if(h & (F.col("label") == 1)) for h in hits]).first()
    out = []
    for hit, right in zip(counted[:len(hits)], counted[len(hits):]):
        p, r = right / hit if hit else 0.0, right / positive if positive else 0.0
        out.append((1 + beta * beta) * p * r / (beta * beta * p + r) if p + r else 0.0)
    return out


def _spark_params(point: dict, rows: int) -> dict:
    """Parameters of a grid point; ``C`` (weight of the summed loss) becomes ``regParam`` (weight of the penalty next to
    the mean loss)."""
    return {k: v for k, v in point.items() if k != "C"} | ({"regParam": 1.0 / (point["C"] * rows)} if "C" in point else {})


# The search grids of the reference (base estimator, grid, folds, metric). Solvers that reach the same optimum
# are left out.
_LR_GRID = {"C": [0.01, 0.1, 1.0, 10.0], "weight": [None, ("fixed", 2.0), ("fixed", 3.0)]}
_RF_GRID = {"numTrees": [100, 200], "maxDepth": [10, 15, NO_LIMIT], MIN_SPLIT: [2, 5, 10], "featureSubsetStrategy": ["sqrt", "log2"]}
_GBT_GRID = {"maxIter": [100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.05, 0.1], "subsamplingRate": [0.8, 1.0],
             "featureSubsetStrategy": ["0.8", "all"]}
_FOREST = {name: Recipe(f"grid_{name}_rf", "rf", name, weight=("fixed", 3.0), split=split) for name, split in
           (("claims", (("test", 0.2), ("train", 0.8))), ("tenure", _QUARTER), ("contacts", _QUARTER))}
GRIDS = {
    "tenure_lr": (RECIPES["tenure_lr"], _LR_GRID, 3, "f1"), "contacts_lr": (RECIPES["contacts_lr"], _LR_GRID, 3, "f1"),
    "claims_rf": (_FOREST["claims"], _RF_GRID, 3, "f1"), "tenure_rf": (_FOREST["tenure"], _RF_GRID, 3, "f1"),
    "contacts_rf": (_FOREST["contacts"], _RF_GRID, 3, "f1"),
    "balanced_rf": (RECIPES["rf_balanced"], {"numTrees": [100, 150, 200, 250, 300, 350, 400], "maxDepth": [10, 15, 20],
                                             "minInstancesPerNode": [10, 20, 30], "featureSubsetStrategy": ["sqrt", "log2"]}, 5, "f1"),
    "dummies_rf_f2": (Recipe("grid_dummies_rf", "rf", "dummies"),
                      {"numTrees": [100, 200], "maxDepth": [10, 15, NO_LIMIT], MIN_SPLIT: [2, 5, 10],
                       "weight": [("fixed", 3.0), ("fixed", 5.0)]}, 5, "f2"),
    "lockin_gbt": (RECIPES["lockin_2"], {"maxIter": [200, 300], "stepSize": [0.03, 0.05], "maxDepth": [4, 5, 6],
                                         "weight": [("ratio", 1.5), ("ratio", 2.0), ("ratio", 2.5)]}, 3, "f1"),
    "tenure_gbt": (Recipe("grid_tenure_gbt", "gbt", "tenure", split=_QUARTER), _GBT_GRID, 3, "f1"),
    "contacts_gbt": (Recipe("grid_contacts_gbt", "gbt", "contacts", split=_QUARTER), _GBT_GRID, 3, "f1"),
}


def at_once(fn, jobs: Sequence, parallelism: int) -> list:
    """Results of independent Spark jobs that are submitted from several threads, in order."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(fn, jobs))


def stacking(df: DataFrame, base: Sequence[Recipe], folds: int = 3, threshold: tuple = ("fixed", 0.5),
             seed: int = 42, parallelism: int = 4) -> TrainResult:
    """Out-of-fold probabilities of the base models (fold = hash of the key), then a balanced logistic meta-model on
    them, evaluated on the held-out test part. As in the reference, a recall threshold is read off the test scores."""
    x, nums, cats = labelled_frame(base[0], df)
    parts = materialize(stratified_split(x, [("test", 0.2), ("train", 0.8)], label=LABEL, seed=seed))
    train = parts.where(F.col("split") == "train").withColumn(
        "fold", F.pmod(F.xxhash64(F.col("customer_id"), F.lit(seed)), F.lit(folds)))
    test = parts.where(F.col("split") == "test")

    # One fit per fold and base model, and one per base model on the whole training part: independent, so several at once.
    parts_of = [(train.where(F.col("fold") != i), train.where(F.col("fold") == i)) for i in range(folds)] + [(train, test)]

    def scores(job: tuple[int, Recipe]) -> DataFrame:
        fit_on, on = parts_of[job[0]]
        return materialize(probability(fit(job[1], fit_on, nums, cats), on).withColumnRenamed("score", f"p_{job[1].estimator}"))

    jobs = [(k, r) for k in range(len(parts_of)) for r in base]
    done = dict(zip([(k, r.name) for k, r in jobs], at_once(scores, jobs, parallelism)))
    joined = []
    for k in range(len(parts_of)):
        out = done[k, base[0].name]
        for r in base[1:]:
            out = out.join(done[k, r.name].drop("label"), "customer_id")
        joined.append(out)
    *folded, test_scores = joined
    oof = folded[0]
    for part in folded[1:]:
        oof = oof.unionByName(part)
    assembler = VectorAssembler(inputCols=[f"p_{r.estimator}" for r in base], outputCol="features")
    meta_train = class_weights(assembler.transform(oof), "label", "balanced")
    meta = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(meta_train)
    scored = materialize(meta.transform(assembler.transform(test_scores)).select(
        "customer_id", "label", vector_to_array(F.col("probability"))[1].alias("score")))
    at = choose_threshold(Recipe("stack", "lr", base[0].feature_set, threshold=threshold), scored)
    return TrainResult(PipelineModel(stages=[assembler, meta]), at, ev.evaluation_record(scored, at), scored,
                       [f"p_{r.estimator}" for r in base])


#: Copies of rows that are worth a task of their own, and most copies of a task.
COPIES, MOST_COPIES = 10_000, 1 << 20


def copy_tasks(copies: int, cores: int) -> int:
    """Tasks that score the shuffled copies: up to four a core, more where they would hold more than ``MOST_COPIES``."""
    return max(1, min(copies // COPIES, 4 * cores), -(-copies // MOST_COPIES))


def permutation_importance(result: TrainResult, test: DataFrame, columns: Sequence[str], repeats: int = 5,
                           seed: int = 42) -> DataFrame:
    """EV15/EV16: mean drop of average precision when one column is shuffled, and its spread over the repeats.

    Rows are numbered once in a seeded hash order (range-partitioned numbering,
    no single-task window). A shuffle is the bijection r -> (a*r + b) mod n with
    gcd(a, n) = 1, so every value moves to exactly one other row by an equi-join
    on the row number; each (column, repeat) uses its own (a, b). All shuffles
    go through one join, one transform and one grouped average precision: the
    test part times the list of shuffles, whose length is fixed by the arguments.
    A small test part is one task's file; its copies are dealt out before they are scored. Drops count to 12 places:
    below, they are the order of the sums.
    """
    import math
    import random

    from churnlab.operators.ranking import global_row_number

    h = F.md5(F.concat(F.col("customer_id"), F.lit(f"|{seed}")))
    numbered = materialize(global_row_number(test.withColumn("_h", h), [F.col("_h"), F.col("customer_id")], "_r").drop("_h"))
    n = numbered.count()
    rng, plans = random.Random(seed), []
    for c in columns:
        for _ in range(repeats):
            a = rng.randrange(1, max(n, 2))
            while math.gcd(a, n) != 1:
                a = rng.randrange(1, max(n, 2))
            plans.append((len(plans), c, a, rng.randrange(0, max(n, 1))))
    spark = test.sparkSession
    shuffles = spark.createDataFrame(plans, "_g int, _c string, _a long, _b long")
    # Decimal product: a * r exceeds a long beyond some three billion rows.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    target = ((wide("_a") * (wide("_r") - 1) + wide("_b")) % F.lit(n)).cast("long") + 1
    # Only (row number, column, one value) is shuffled for each copy of a row; the rows themselves are shuffled once.
    kind = {c: numbered.schema[c].dataType for c in columns}
    text = [c for c in columns if not isinstance(kind[c], NumericType)]
    cell = lambda c: F.struct(F.lit(c).alias("c"), (F.lit(None) if c in text else F.col(c)).cast("double").alias("d"),
                              (F.col(c) if c in text else F.lit(None)).cast("string").alias("s"))
    values = numbered.select(F.col("_r").alias("_t"), F.explode(F.array(*[cell(c) for c in columns])).alias("v")).select("_t", "v.*")
    asked = numbered.select("_r").crossJoin(F.broadcast(shuffles)).select("_r", "_g", "_c", target.alias("_t"))
    moved = asked.join(values, (asked["_t"] == values["_t"]) & (asked["_c"] == values["c"])).select("_r", "_g", "_c", "d", "s")
    moved = moved.repartition(copy_tasks(n * len(plans), spark.sparkContext.defaultParallelism), "_r")
    fan = numbered.join(moved, "_r").withColumns(
        {c: F.when(F.col("_c") == c, F.col("s" if c in text else "d").cast(kind[c])).otherwise(F.col(c)) for c in columns})
    ap = grouped_average_precision(probability(result.model, fan, keep=("_g", "label")), "_g")
    base = average_precision(result, numbered)
    drop = F.round(F.lit(base) - F.col("ap"), 12)
    drops = shuffles.join(ap, "_g").groupBy(F.col("_c").alias("feature")).agg(
        F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
    return drops.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance_mean").desc(), "feature")))


def average_precision(result: TrainResult, rows: DataFrame) -> float:
    scored = probability(result.model, rows).withColumn("_g", F.lit(0))
    return float(grouped_average_precision(scored, "_g").first()["ap"])


def grouped_average_precision(scored: DataFrame, group: str) -> DataFrame:
    """(group, ap) from (group, label, score): sum over scores of (pos / P) * tp / (tp + fp).

    Positives and negatives are counted per (group, score), and one range-partitioned running sum over all groups gives
    the cumulative counts; what the groups before a group hold (one row per group) is taken off."""
    from churnlab.operators.ranking import prefix_sums

    counts = scored.groupBy(group, "score").agg(F.sum("label").cast("long").alias("pos"), F.count("*").alias("n"))
    running = prefix_sums(counts, [F.col(group), F.col("score").desc()], ["pos", "n"])
    totals = running.groupBy(group).agg(F.sum("pos").alias("P"), F.min(F.col("cum_pos") - F.col("pos")).alias("pos0"),
                                        F.min(F.col("cum_n") - F.col("n")).alias("n0"))
    term = F.col("pos") / F.col("P") * ((F.col("cum_pos") - F.col("pos0")) / (F.col("cum_n") - F.col("n0")))
    return running.join(F.broadcast(totals), group).groupBy(group).agg(F.sum(term).alias("ap"))


#: Newton steps of the one-feature fit: from zero it is at rest long before.
TREND_STEPS = 25


def logistic_trend(df: DataFrame, column: str, label: str = LABEL) -> DataFrame:
    """One-feature logistic fit of the label with intercept, at the distinct values of the feature (a curve table).

    The rows are read once: (value, rows, positives) are sufficient for the fit. Weighted Newton steps run over that
    table, each an aggregate of five sums; a step stops the fit where the curvature or the change has vanished (one value
    only, or groups that the label separates).
    """
    x, y = F.col(column).cast("double"), F.col(label).cast("double")
    held = materialize(df.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("value")).agg(F.count("*").alias("n"), F.sum(y).alias("pos")))
    a = b = 0.0
    curve = lambda: 1.0 / (1.0 + F.exp(-(F.lit(a) + F.lit(b) * F.col("value"))))
    for _ in range(TREND_STEPS):
        p, v = curve(), F.col("value")
        off, weight = F.col("pos") - F.col("n") * p, F.col("n") * p * (1.0 - p)
        g0, g1, h00, h01, h11 = held.agg(F.sum(off), F.sum(off * v), F.sum(weight), F.sum(weight * v), F.sum(weight * v * v)).first()
        det = (h00 or 0.0) * (h11 or 0.0) - (h01 or 0.0) ** 2
        if not det > 1e-9 * (h00 or 0.0) * (h11 or 0.0):
            if b != 0.0 or not h00 or abs(g0 / h00) < 1e-12:
                break
            a += g0 / h00  # one value: its rate
            continue
        step = ((h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det)
        a, b = a + step[0], b + step[1]
        if max(map(abs, step)) < 1e-12:
            break
    return held.select(F.lit(column).alias("feature"), "value", F.round(curve(), 6).alias("churn_probability"))


def stage_comparison(records: dict[str, DataFrame], metrics: Sequence[str] = ("roc_auc", "f2", "recall", "threshold")) -> DataFrame:
    """EV17: stage name x selected metrics from several evaluation records."""
    out = None
    for stage, rec in records.items():
        part = rec.where(F.col("metric").isin(*metrics)).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("stage").pivot("metric", list(metrics)).agg(F.first("value"))

