"""Newton rounds: against a direct implementation, node tables and limits."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from churnlab.operators import histograms, models as ml, newton, trees
from churnlab.operators.prep import fit_preprocessor


@pytest.fixture(scope="module")
def rows(ph):
    x, nums, cats = ml.labelled_frame(ml.RECIPES["tenure_lr"], ph)
    big = x.unionByName(x.withColumn("age", F.col("age") + 3)).unionByName(x.withColumn("label", 1 - F.col("label")).limit(40))
    return fit_preprocessor(big, nums, cats).transform(big).select("features", "label").withColumn(
        "weight", F.when(F.col("label") == 1, 3.0).otherwise(1.0)).coalesce(1).persist()


def arrays(rows):
    got = rows.select(vector_to_array("features").alias("x"), "label", "weight").collect()
    return np.array([r.x for r in got]), np.array([r.label for r in got]), np.array([r.weight for r in got])


def margins(model, rows):
    p = np.array([r[0] for r in model.transform(rows).select(vector_to_array("probability")[1]).collect()])
    return np.log(p / (1 - p))


def table(model, spark):
    by_tree = {}
    for r in trees.save_trees(model, spark).nodes().orderBy("tree", "id").collect():
        by_tree.setdefault(r.tree, []).append(r)
    return by_tree


def leaf(nodes, x):
    i = 0
    while nodes[i].leftChild >= 0:
        i = nodes[i].leftChild if x[nodes[i].split.featureIndex] <= nodes[i].split.leftCategoriesOrThreshold[0] else nodes[i].rightChild
    return i


@pytest.mark.parametrize("l2", [0.0, 1.5])
def test_leaf_values_are_newton_steps(spark, rows, l2):
    """Values recounted from the rows: -G / (H + lambda) in every leaf of every round, from the margins before it."""
    model, _ = newton.newton_rounds(rows, newton.Growth(step=0.3, leaves=6, l2=l2, least_rows=5), 4)
    x, label, w = arrays(rows)
    rate = (w * label).sum() / w.sum()
    f = np.full(len(x), math.log(rate / (1 - rate)))
    for number, nodes in table(model, spark).items():
        if number == 0:
            assert abs(nodes[0].prediction * 2 - f[0]) < 1e-12 and len(nodes) == 1
            continue
        at = np.array([leaf(nodes, v) for v in x])
        p = 1 / (1 + np.exp(-f))
        for i in set(at):
            here = at == i
            value = (w * (label - p))[here].sum() / ((w * p * (1 - p))[here].sum() + l2)
            assert abs(nodes[i].prediction - value) < 1e-7 and here.sum() == nodes[i].rawCount >= 5
            f[here] += 0.3 * value
        assert sum(n.leftChild < 0 for n in nodes) <= 6
    assert np.allclose(margins(model, rows), f, atol=1e-6)


def test_splits_have_the_largest_newton_gain(spark, rows):
    """The first split of the first round is the best of all thresholds by brute force."""
    model, _ = newton.newton_rounds(rows, newton.Growth(leaves=2, least_rows=20), 1)
    x, label, w = arrays(rows)
    rate = (w * label).sum() / w.sum()
    g, h = w * (label - rate), w * rate * (1 - rate)

    def gain(left):
        return sum(g[s].sum() ** 2 / h[s].sum() for s in (left, ~left))

    best = max((gain(x[:, j] <= t) for j in range(x.shape[1]) for t in np.unique(x[:, j])[:-1]
                if min((x[:, j] <= t).sum(), (x[:, j] > t).sum()) >= 20), default=0)
    split = table(model, spark)[1][0].split
    assert gain(x[:, split.featureIndex] <= split.leftCategoriesOrThreshold[0]) >= best * (1 - 1e-9)


def test_depth_is_free_and_leaves_are_bounded(spark, rows, monkeypatch):
    """Starting shallow and going deeper only where needed gives the trees of a deep start."""
    growth = newton.Growth(step=0.3, leaves=12, least_rows=3)
    monkeypatch.setattr(newton, "FIRST_DEPTH", 20)
    deep = table(newton.newton_rounds(rows, growth, 2)[0], spark)
    monkeypatch.setattr(newton, "FIRST_DEPTH", 2)
    monkeypatch.setattr(newton, "DEEPER", 2)
    lazy = table(newton.newton_rounds(rows, growth, 2)[0], spark)
    shape = lambda t: [[(n.prediction, n.rawCount, n.split) for n in nodes] for nodes in t.values()]
    assert shape(lazy) == shape(deep)
    assert max(sum(n.leftChild < 0 for n in nodes) for nodes in deep.values()) == 12


def test_columns_are_drawn_per_tree_and_reruns_agree(spark, rows):
    growth = newton.Growth(leaves=None, depth=4, least_rows=1, columns=0.4, rows=0.7, l2=1.0)
    model, _ = newton.newton_rounds(rows, growth, 5, seed=3)
    width = rows.first().features.size
    used = [{n.split.featureIndex for n in nodes if n.leftChild >= 0} for t, nodes in table(model, spark).items() if t]
    assert all(len(u) <= max(1, int(0.4 * width)) for u in used) and len(set.union(*used)) > max(map(len, used))
    again, _ = newton.newton_rounds(rows, growth, 5, seed=3)
    assert (margins(again, rows) == margins(model, rows)).all()
    roots = [nodes[0].rawCount for t, nodes in table(model, spark).items() if t]
    assert all(0.3 < n / rows.count() < 0.95 for n in roots) and len(set(roots)) > 1


def test_rounds_end_when_they_no_longer_help(rows, monkeypatch):
    from churnlab.operators import boosting
    monkeypatch.setattr(newton, "WRITE_EVERY", 2)
    assert boosting.WRITE_EVERY > 2
    train, valid = rows.randomSplit([0.7, 0.3], 4)
    model, losses = newton.newton_rounds(train, newton.Growth(step=0.8, least_rows=2), 30, valid, patience=2)
    best = int(np.argmin(losses))
    assert model.getNumTrees == best + 2 and (len(losses) == 30 or len(losses) - 1 - best == 2)
    f = margins(model, valid)
    y = arrays(valid)[1] * 2 - 1
    assert abs(2 * np.log1p(np.exp(-y * f)).mean() - losses[best]) < 1e-9


def test_one_class_and_constant_columns(spark, rows):
    for label in (0.0, 1.0):
        model, _ = newton.newton_rounds(rows.withColumn("label", F.lit(label)), newton.Growth(), 2)
        f = margins(model, rows)
        assert np.isfinite(f).all() and (np.sign(f) == (1 if label else -1)).all()


def test_recipes_that_grow_by_newton_rounds(ph):
    for name, most in (("main", 3), ("gbt_deep", 3), ("gbt_subsample", 3), ("tenure_gbt", 3)):
        recipe = ml.RECIPES[name]
        x, nums, cats = ml.labelled_frame(recipe, ph)
        model = ml.fit(recipe, x, nums, cats, {"maxIter": most}).stages[-1]
        assert model.getNumTrees == most + 1
        assert all(t.numNodes <= 2 * (recipe.params["maxLeaves"] or 1 << 20) - 1 for t in model.trees)
        assert all(t.depth <= recipe.params.get("maxDepth", newton.DEEPEST) for t in model.trees)


def test_rows_are_binned_once_for_all_rounds(rows, monkeypatch):
    """Rounds pass over cached bins: Spark's tree fit, which looks for thresholds and bins all rows anew, isn't called per round."""
    fits, fit = [], newton.DecisionTreeRegressor.fit
    monkeypatch.setattr(newton.DecisionTreeRegressor, "fit", lambda self, *a, **k: fits.append(self.getMaxDepth()) or fit(self, *a, **k))
    model, _ = newton.newton_rounds(rows, newton.Growth(leaves=4), 3)
    assert model.getNumTrees == 4 and fits == [0]


def test_gradient_rounds_are_the_boosted_fit(rows):
    """The rounds on bins score all rows as Spark's classifier does."""
    from pyspark.ml.classification import GBTClassifier
    spark_fit = GBTClassifier(weightCol="weight", maxIter=4, maxDepth=3, stepSize=0.3, maxBins=512).fit(rows)
    growth = newton.Growth(step=0.3, leaves=None, depth=3, least_rows=1, bins=512)
    assert np.allclose(margins(newton.gradient_rounds(rows, growth, 4), rows), margins(spark_fit, rows), atol=1e-6)


def test_thresholds_are_spread_over_the_rows():
    from churnlab.operators import histograms
    few = histograms.thresholds(np.array([1.0, 2.0, 4.0]), np.array([5, 1, 1]), 255)
    assert few.tolist() == [1.5, 3.0]
    many = histograms.thresholds(np.arange(1000.0), np.ones(1000, int), 10)
    assert len(many) == 9 and max(np.diff(many)) < 110
    parts = [[histograms._shorter(*np.unique(np.random.default_rng(k).normal(size=9000), return_counts=True))] for k in range(3)]
    values, counts = histograms._merged(histograms._merged(parts[0], parts[1]), parts[2])[0]
    assert counts.sum() == 27000 and len(values) <= histograms.SUMMARY and abs(np.interp(13500, np.cumsum(counts), values)) < 0.05


def test_rounds_of_one_partition_run_in_its_task(spark, monkeypatch):
    """Few rows: no job per pass. The trees are those that the driver grows pass by pass."""
    rng = random.Random(8)
    rows = [(Vectors.dense([x := rng.randrange(9), y := rng.randrange(5)]), float(rng.random() < 0.2 + 0.5 * (x > 5) * (y > 1))) for _ in range(400)]
    train = spark.createDataFrame(rows, ["features", "label"])
    grown = newton.Growth(leaves=6, least_rows=5, rows=0.8)
    near = newton.newton_rounds(train, grown, 6, train.limit(100))
    made = histograms.Rounds.count
    passes = []
    monkeypatch.setattr(histograms.Rounds, "count", lambda self, *a, **k: passes.append(1) or made(self, *a, **k))
    newton.newton_rounds(train, grown, 6)
    assert not passes
    monkeypatch.setattr(histograms, "TASK", 50)
    far = newton.newton_rounds(train, grown, 6, train.limit(100))
    assert len(passes) > 6
    assert all(abs(a - b) < 1e-9 for a, b in zip(near[1], far[1])) and len(near[1]) == len(far[1])
    assert near[0].toDebugString.splitlines()[1:] == far[0].toDebugString.splitlines()[1:] or near[0].totalNumNodes == far[0].totalNumNodes


def test_rows_of_a_task_go_on_from_their_nodes(monkeypatch):
    """A pass inside a task doesn't walk all rows down from the root again, and finds the nodes that it would find there."""
    rng, began, made = np.random.default_rng(3), [], histograms.Grown.node
    bins = rng.integers(0, 8, (3, 500)).astype(np.uint8)
    label = (rng.random(500) < 0.2 + 0.5 * (bins[0] > 4) * (bins[1] > 2)).astype(float)
    block = histograms.Block(bins, label, np.ones(500), np.zeros(500, np.int64), np.zeros(500, bool), np.zeros(500))

    def node(self, bins, *start):
        began.append(bool(start) and start[0] is not None)
        out = made(self, bins, *start)
        assert (out == made(self, bins)).all()
        return out

    monkeypatch.setattr(histograms.Grown, "node", node)
    work = histograms.InTask([block], [np.arange(7) + 0.5] * 3, newton.Growth(leaves=8, least_rows=5), True, 42, 10)
    fitted, _ = newton._loop(work, 3, 3, False, 20, (1, 1, 30))
    assert len(fitted) == 3 and all(len(nodes) > 3 for nodes in fitted) and sum(began) > 3


def test_rows_of_some_partitions_are_grown_in_one_task(spark, monkeypatch):
    """25,000 rows fill more than one partition while they are binned; no pass over them is a job."""
    x, y = F.pmod(F.xxhash64("id"), F.lit(50)).cast("double"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)).cast("double")
    label = ((F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10)) < F.when((x > 30) & (y < 4), 7).otherwise(2))).cast("double")
    train = spark.range(25_000).select(array_to_vector(F.array(x, y)).alias("features"), label.alias("label"))
    passes, made = [], histograms.Rounds.count
    monkeypatch.setattr(histograms.Rounds, "count", lambda self, *a, **k: passes.append(1) or made(self, *a, **k))
    model, _ = newton.newton_rounds(train, newton.Growth(leaves=4), 3)
    assert not passes and model.getNumTrees == 4
    root = model.trees[1].toDebugString
    assert "feature 0 <= 30.5" in root and "feature 1 <= 3.5" in root


@pytest.mark.parametrize("by_newton", [True, False])
def test_columns_counted_together_are_those_counted_alone(by_newton):
    """Counts, sums and squares per node and bin, of drawn rows and columns, against sums over the rows."""
    rng, sizes, n = np.random.default_rng(1), [2, 2, 300, 5, 2, 7], 6000
    bins = np.array([rng.integers(0, k, n) for k in sizes], np.uint16)
    label = (rng.random(n) < 0.3).astype(float)
    assert sum(len(some) for some in histograms.together(sizes)) == 5
    tree = histograms.Grown(np.array([0, -1, -1]), np.zeros(3, int), np.array([1, -1, -1]), np.array([2, -1, -1]))
    for weight in (np.where(label == 1, 3.0, 1.0), 1 + rng.random(n)):
        b = histograms.Block(bins, label, weight, np.arange(n), rng.random(n) < 0.2, rng.normal(size=n), histograms._cells(bins, sizes))
        for columns in (tuple(range(6)), (1, 2, 5)):
            about = histograms.Round(3, by_newton, 42, 0.7, columns, True)
            a, w = about.statistics(b)
            for on, asked in ((histograms.Grown(*(np.array([v]) for v in (-1, 0, -1, -1))), [0]), (tree, [2])):
                out, squares, held = histograms._count(b, on, np.array(asked), sizes, about, True)
                rows = about.drawn(b) & (on.node(b.bins) == asked[0])
                want = [[v[rows & (bins[j] == k)].sum() for j in columns for k in range(sizes[j])] for v in (np.ones(n), a, w, a * a / w)]
                assert np.allclose(out[:, 0], want) and np.isclose(squares[0], (a * a / w)[rows].sum()) and held[1] == b.held.sum()


def test_squares_of_the_last_level_are_those_of_its_rows():
    """A depth ends growth: leaves that no pass counted still have the impurity of their rows."""
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 8, (3, 700)).astype(np.uint8)
    label = (rng.random(700) < 0.2 + 0.5 * (bins[0] > 4) * (bins[1] > 2)).astype(float)
    block = histograms.Block(bins, label, np.ones(700), np.zeros(700, np.int64), np.zeros(700, bool), np.zeros(700))
    work = histograms.InTask([block], [np.arange(7) + 0.5] * 3, newton.Growth(leaves=None, depth=2, least_rows=1), False, 42, 10)
    (nodes,), _ = newton._loop(work, 3, 1, False, 20, (1, 1, 30))
    leaves = [r for r in nodes if r[6] < 0]
    assert len(leaves) == 4 and sum(r[3][2] for r in leaves) == 700.0 and all(r[3][2] == r[4] for r in leaves)
