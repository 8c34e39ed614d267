"""Forests on binned rows: trees against Spark's, both ways to find splits, tops against whole trees, limits, storage."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from churnlab.operators import forests
from churnlab.operators import models as ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for i in range(900):
        x = [rng.randrange(6), rng.randrange(12), rng.randrange(2), rng.randrange(20), rng.randrange(3)]
        label = float(rng.random() < 0.15 + 0.1 * (x[0] > 3) + 0.4 * (x[1] > 8) * x[2] + 0.2 * (x[3] > 15))
        out.append((i, Vectors.dense(x), label, 3.0 if label else 1.0))
    return spark.createDataFrame(out, ["id", "features", "label", "weight"]).coalesce(2).cache()


def arrays(rows):
    got = rows.orderBy("id").collect()
    x = np.array([r.features.toArray() for r in got])
    edges = [np.unique(c)[:-1] + 0.5 for c in x.T]
    bins = np.array([np.searchsorted(e, c) for e, c in zip(edges, x.T)], np.uint8).T.copy()
    return x, bins, np.array([r.label for r in got], np.uint8), np.array([r.weight for r in got]), edges


def scores(model, rows):
    return {r.id: r.p for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}


@pytest.mark.parametrize("least", [1, 7])
def test_a_tree_on_all_rows_is_sparks(rows, least):
    x, bins, label, weight, edges = arrays(rows)
    how = forests.Forest(1, 6, least, columns="all")
    tree = forests.grow(bins, label, weight, np.ones(len(x), np.uint8), how, edges, np.random.default_rng(0))
    mine = tree.p[tree.find(tree.cut(None, 0), x)]
    spark_tree = DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=least, weightCol="weight").fit(rows)
    want = scores(spark_tree, rows)
    # Splits that remove the same may be picked in another order.
    assert np.mean([abs(mine[i] - p) < 1e-9 for i, p in want.items()]) > 0.97
    assert abs(int((tree.cut(None, 0) >= 0).sum()) - (spark_tree.numNodes - 1) // 2) <= 40


@pytest.mark.parametrize("weighted", ["by class", "by row"])
def test_sorted_and_counted_splits_agree(rows, monkeypatch, weighted):
    x, bins, label, weight, edges = arrays(rows)
    if weighted == "by row":
        weight = weight * (1 + np.arange(len(weight)) % 3)
    drawn = forests._POISSON[np.random.default_rng(1).integers(0, 1 << 16, len(x), np.uint16)]
    assert abs(drawn.mean() - 1) < 0.15
    made = []
    for large in (1, 1 << 30):
        monkeypatch.setattr(forests, "LARGE", large)
        made.append(forests.grow(bins, label, weight, drawn, forests.Forest(2, 30, 1, columns="sqrt"), edges, np.random.default_rng(3)))
    assert len(made[0].feature) > 200
    for f in forests._FIELDS:
        assert np.allclose(getattr(made[0], f), getattr(made[1], f)), f


def test_tops_and_parts_are_the_whole_trees(rows, monkeypatch):
    """No node table on the driver but the tops: they and the parts below score as trees grown whole."""
    how = forests.Forest(6, 30, 2, columns="all", seed=3)
    whole = forests.fit_forest(rows, how)
    assert not whole.tops
    monkeypatch.setattr(forests, "WHOLE", 150)
    split = forests.fit_forest(rows, how)
    assert len(split.tops) == 6 and all(5 < len(t.feature) < 60 for t in split.tops.values())
    for limits in ({}, {"max_depth": 3}, {"trees": 3, "min_split": 40}):
        a, b = scores(whole.limited(**limits), rows), scores(split.limited(**limits), rows)
        assert max(abs(a[i] - b[i]) for i in a) < 1e-9, limits
    assert np.allclose(whole.featureImportances.toArray(), split.featureImportances.toArray())
    assert abs(whole.featureImportances.toArray().sum() - 1) < 1e-9


def test_limits_are_the_fits_with_them(rows):
    full = forests.fit_forest(rows, forests.Forest(8, 30, columns="all"))
    for limits, how in (({"max_depth": 4}, forests.Forest(8, 4, columns="all")), ({"min_split": 30}, forests.Forest(8, 30, min_split=30, columns="all")),
                        ({"trees": 5}, forests.Forest(5, 30, columns="all"))):
        a, b = scores(full.limited(**limits), rows), scores(forests.fit_forest(rows, how), rows)
        assert max(abs(a[i] - b[i]) for i in a) < 1e-9, limits


def test_a_saved_forest_scores_the_same(rows, tmp_path, monkeypatch):
    monkeypatch.setattr(forests, "WHOLE", 400)
    model = forests.fit_forest(rows, forests.Forest(4, 9)).limited(max_depth=7)
    PipelineModel(stages=[model]).write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    assert scores(again, rows) == scores(model, rows)


def test_one_class_and_few_rows(spark, rows):
    one = forests.fit_forest(rows.where("label = 0"), forests.Forest(3, 5))
    assert set(scores(one, rows).values()) == {0.0}
    assert one.featureImportances.toArray().sum() == 0
    assert set(scores(forests.fit_forest(rows.limit(1), forests.Forest(3, 5)), rows).values()) <= {0.0, 1 / 3, 2 / 3, 1.0}


def test_recipes_of_forests_leave_no_node_on_the_driver(ph):
    done = ml.train_evaluate(ml.RECIPES["rf_derived"], ph, {"numTrees": 12})
    forest = done.model.stages[-1]
    assert isinstance(forest, forests.ForestModel) and not forest.tops and forest.getNumTrees == 12
    s = done.test_scores.agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= s[0] < s[1] <= 1.0
    importances = ml.tree_importances(done).collect()
    assert len(importances) == len(done.feature_names) and abs(sum(r.importance for r in importances) - 1) < 1e-9


def test_points_of_one_fit_are_measured_in_one_job(spark, rows):
    """F measures of all limited forests are those of the evaluator, and take one job on the held-out rows."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    limits = [{}, {"max_depth": 1}, {"trees": 3, "min_split": 20}, {"max_depth": 3, "min_split": 5}]
    held = rows.select("features", "label").limit(150).persist()
    for whole in (1 << 22, 30):
        old, forests.WHOLE = forests.WHOLE, whole
        try:
            forest = forests.fit_forest(rows, forests.Forest(6, 6))
        finally:
            forests.WHOLE = old
        for beta in (1.0, 2.0):
            evaluator = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", beta=beta, metricLabel=1.0)
            want = [evaluator.evaluate(forest.limited(**some).transform(held)) for some in limits]
            assert ml.forest_f_measures(forest, held, limits, beta) == want


def test_a_row_goes_down_a_tree_once_for_all_limits(rows):
    """Where a row stops under a limit is a node of its way down the least limited tree."""
    x, bins, label, weight, edges = arrays(rows)
    part = forests.grow(bins, label, weight, np.ones(len(x), np.uint8), forests.Forest(1, 9, columns="all"), edges, np.random.default_rng(0))
    for limits in ([(None, 0), (3, 0), (None, 40), (5, 9)], [(3, 0), (2, 60)], [(0, 0)]):
        cuts = [part.cut(*some) for some in limits]
        loosest, stops = part.stops(cuts)
        ends = part.find(loosest, x)
        assert len({*ends.tolist()}) > (8 if (None, 0) in limits else 0)
        for cut, stop in zip(cuts, stops):
            assert (stop[ends] == part.find(cut, x)).all()


def test_memory_of_a_growing_tree_is_small(rows):
    """Of a drawn row its number, class and draws take one number and its node another: less than 60 bytes a row at the peak."""
    import tracemalloc
    rng, n = np.random.default_rng(0), 60_000
    bins = rng.integers(0, 32, (n, 9)).astype(np.uint8)
    label = (rng.random(n) < 0.1 + 0.5 * (bins[:, 0] > 20)).astype(np.uint8)
    drawn, weight = forests._drawn(forests.Forest(), 0, (0, 0), n), np.where(label == 1, 3.0, 1.0)
    tracemalloc.start()
    try:
        tree = forests.grow(bins, label, weight, drawn, forests.Forest(2, 30, columns="sqrt"), [np.arange(31) + 0.5] * 9, rng)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(tree.feature) > n // 6 and peak < 60 * n
