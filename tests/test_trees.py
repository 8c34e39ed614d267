"""Node tables: pruned, cut and assembled ensembles against Spark's own fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession, functions as F

from churnlab.operators import boosting, models as ml, trees
from churnlab.operators.prep import fit_preprocessor


@pytest.fixture(scope="module")
def rows(ph):
    x, nums, cats = ml.labelled_frame(ml.RECIPES["tenure_gbt"], ph)
    big = x.unionByName(x.withColumn("age", F.col("age") + 3)).unionByName(x.withColumn("label", 1 - F.col("label")).limit(40))
    return fit_preprocessor(big, nums, cats).transform(big).select("features", "label").withColumn(
        "weight", F.when(F.col("label") == 1, 3.0).otherwise(1.0)).coalesce(1).persist()


def save(model):
    return trees.save_trees(model, SparkSession.getActiveSession())


def table(saved: trees.SavedTrees, *more):
    return [tuple(r) for r in saved.nodes().select("tree", "id", "prediction", "impurity", "rawCount", "leftChild", "rightChild", "split", *more)
            .orderBy("tree", "id").collect()]


def probabilities(model, rows):
    return np.array([r[0] for r in model.transform(rows).select(vector_to_array("probability")[1]).collect()])


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_a_tree_cut_at_a_depth_is_the_fit_with_that_depth(rows, depth):
    """Without random draws a fit with a smaller depth has the same splits; siblings of one class are one leaf in both."""
    whole = dict(numTrees=1, bootstrap=False, featureSubsetStrategy="all", seed=1, weightCol="weight")
    deep = save(RandomForestClassifier(maxDepth=12, **whole).fit(rows))
    direct = RandomForestClassifier(maxDepth=depth, **whole).fit(rows)
    cut = deep.reduced(max_depth=depth)
    assert table(cut) == table(save(direct))
    assert (probabilities(cut.load(), rows) == probabilities(direct, rows)).all()


def test_rows_to_split(rows):
    saved = save(RandomForestClassifier(numTrees=6, maxDepth=20, seed=3, weightCol="weight").fit(rows))
    before = {(r.tree, str(r.split), r.rawCount, r.gain) for r in saved.nodes().where("leftChild >= 0").collect()}
    for least in (5, 30, 10 ** 6):
        cut = saved.reduced(min_split=least)
        inner = cut.nodes().where("leftChild >= 0").collect()
        assert all(r.rawCount >= least for r in inner) and {(r.tree, str(r.split), r.rawCount, r.gain) for r in inner} <= before
        model = cut.load()
        assert model.getNumTrees == 6 and model.totalNumNodes == cut.nodes().count()
        scores = probabilities(model, rows)
        assert ((scores >= 0) & (scores <= 1)).all()
    assert cut.nodes().count() == 6  # nothing splits: a root for each tree


def test_first_trees_of_a_forest_and_of_a_boosted_fit(rows):
    forest = save(RandomForestClassifier(numTrees=5, maxDepth=4, seed=3).fit(rows))
    assert table(forest.reduced(trees=2)) == [r for r in table(forest) if r[0] < 2] and forest.reduced(trees=2).load().getNumTrees == 2
    for more in ({}, {"subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}):
        fits = {m: GBTClassifier(maxIter=m, maxDepth=3, seed=5, weightCol="weight", stepSize=0.2, **more).fit(rows) for m in (2, 6)}
        cut = save(fits[6]).reduced(trees=2).load()
        assert cut.treeWeights == fits[2].treeWeights and (probabilities(cut, rows) == probabilities(fits[2], rows)).all()


def brute_best_first(nodes, leaves):
    """Leaves of the tree that splits the frontier node of the largest gain, again and again."""
    by_id, front = {r.id: r for r in nodes}, [0]
    while len(front) < leaves:
        open_ = [i for i in front if by_id[i].leftChild >= 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (by_id[i].gain * by_id[i].rawCount, -i))
        front.remove(best)
        front += [by_id[best].leftChild, by_id[best].rightChild]
    return sorted((by_id[i].prediction, by_id[i].rawCount) for i in front)


def test_best_first_growth(rows):
    saved = save(GBTClassifier(maxIter=3, maxDepth=8, seed=5).fit(rows))
    for leaves in (1, 2, 7, 31, 10 ** 4):
        cut = saved.reduced(max_leaves=leaves).nodes()
        for t in range(3):
            got = sorted((r.prediction, r.rawCount) for r in cut.where(f"tree = {t} and leftChild < 0").collect())
            assert got == brute_best_first(saved.nodes().where(f"tree = {t}").collect(), leaves) and len(got) <= leaves


@pytest.mark.parametrize("kind, params", [(RandomForestClassifier, {"numTrees": 7, "maxDepth": 6}), (GBTClassifier, {"maxIter": 5, "maxDepth": 4})])
def test_importances_equal_sparks(rows, kind, params):
    model = kind(seed=3, weightCol="weight", **params).fit(rows)
    got = {r.slot: r.importance for r in save(model).importances().collect()}
    want = model.featureImportances.toArray()
    assert all(abs(got.get(i, 0.0) - v) < 1e-9 for i, v in enumerate(want)) and abs(sum(got.values()) - 1) < 1e-9


def test_boosting_round_by_round_is_the_boosted_fit(rows, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 3)
    parts = rows.select("features", "label").randomSplit([0.7, 0.3], 4)
    train, valid = (p.coalesce(1).persist() for p in parts)
    got = boosting.boost_until(train, valid, most=14, patience=4, step=0.3, tree_params={"maxDepth": 3}, seed=9)
    whole = GBTClassifier(maxIter=len(got.losses), maxDepth=3, stepSize=0.3, seed=9).fit(train)
    assert np.allclose(got.losses, whole.evaluateEachIteration(valid), rtol=1e-9)
    best = int(np.argmin(got.losses))
    assert got.model.getNumTrees == best + 1 and (len(got.losses) == 14 or len(got.losses) - 1 - best == 4)
    assert np.allclose(probabilities(got.model, valid), probabilities(save(whole).reduced(trees=best + 1).load(), valid))
    saved = save(got.model)  # an assembled model is saved and loaded like any other
    assert np.allclose(probabilities(saved.load(), valid), probabilities(got.model, valid))


def test_families_of_the_grids():
    counts = {name: (len(points), len(fits)) for name, (recipe, grid, _, _) in ml.GRIDS.items()
              for fits in [ml.families(recipe.estimator, {k: v for k, v in grid.items() if k != "weight"})] for points in [[p for _, ps in fits for p in ps]]}
    assert counts == {"tenure_lr": (4, 4), "contacts_lr": (4, 4), "claims_rf": (36, 2), "tenure_rf": (36, 2), "contacts_rf": (36, 2),
                      "balanced_rf": (126, 6), "dummies_rf_f2": (18, 1), "lockin_gbt": (12, 6), "tenure_gbt": (72, 36), "contacts_gbt": (72, 36)}


def test_a_search_by_prefixes_equals_separate_fits(ph):
    recipe = ml.GRIDS["tenure_gbt"][0]
    grid = {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.3], "subsamplingRate": [0.8]}
    whole, best = ml.cross_validate(recipe, ph, grid, folds=2)
    apart = [ml.cross_validate(recipe, ph, {**grid, "maxIter": [m]}, folds=2)[0] for m in grid["maxIter"]]
    assert {r.params: r.mean_metric for r in whole.collect()} == {r.params: r.mean_metric for t in apart for r in t.collect()}
    assert best.model.stages[-1].getNumTrees in (2, 4)


def test_a_forest_search_by_pruning(ph):
    recipe, grid, _, _ = ml.GRIDS["claims_rf"]
    small = {**grid, "numTrees": [3, 6], "maxDepth": [2, 8], "featureSubsetStrategy": ["sqrt"]}
    points, best = ml.cross_validate(recipe, ph, small, folds=2)
    assert points.count() == 12 and ml.record_check(best).first().bad_metrics == 0
    least = best.model.stages[-1]
    chosen = max(points.collect(), key=lambda r: r.mean_metric).params
    assert f"numTrees={least.getNumTrees}" in chosen
    want = int(chosen.split("minRowsToSplit=")[1].split(",")[0])
    assert save(least).nodes().where(f"leftChild >= 0 and rawCount < {want}").count() == 0


def test_report_of_the_early_stopped_model(ph):
    table, scored = ml.cross_validated_report(ph, ml.RECIPES["gbt_stopped"], folds=2, most=4, patience=2, parallelism=2)
    *folds, mean = sorted(table.collect(), key=lambda r: (r.fold is None, r.fold))
    assert [r.fold for r in folds] == [0, 1] and mean.fold is None and all(2 <= r.rounds <= 5 for r in folds)
    assert abs(mean.test_auc - sum(r.test_auc for r in folds) / 2) < 1e-12
    ids = [r[0] for s in scored for r in s.select("customer_id").collect()]
    assert len(ids) == len(set(ids)) == ph.count() - -(-ph.where("churn_flag = 1").count() // 5) - -(-ph.where("churn_flag = 0").count() // 5)
