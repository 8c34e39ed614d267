"""Boosted trees by Newton rounds (survey L7, L16, L17, L22-L24, L29).

Spark's boosted classifier fits every tree to the first derivative of its loss,
grows by depth and draws columns per node. The reference's learners take second
derivatives, grow best-first to a number of leaves, draw columns once per tree and
shrink leaf values by an L2 term. A round here is a weighted regression tree
(``histograms``): with target -g / h and weight h (g and h are the derivatives of
the logistic loss at the row's margin) the variance that a split removes is the
loss that a Newton step on either side removes, and the mean of a node is its
Newton value -G / H. From there

* best-first growth picks splits by that gain, one by one; only children of picked
  nodes are counted, so the depth is free;
* the L2 term turns the value of a leaf into -G / (H + lambda);
* columns are drawn once per tree, rows anew in every round.

Splits are chosen without the L2 term. The margin of a row is moved by the leaf
that the tree gives the row. The result is one of Spark's own boosted models,
written as node tables and loaded. ``gradient_rounds`` grows the trees of Spark's
boosted classifier in the same way.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, replace
from math import log

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.operators import histograms, trees
from churnlab.operators.boosting import WRITE_EVERY, assemble

#: Levels to which a tree is first searched where the depth is free, levels by which the search then goes on while best-first
#: growth picks leaves there, and Spark's limit.
FIRST_DEPTH, DEEPER, DEEPEST = 8, 3, 30


@dataclass(frozen=True)
class Growth:
    """How a tree grows. Without ``depth`` it is free up to Spark's limit; without ``leaves`` the depth alone limits it."""

    step: float = 0.1
    leaves: int | None = 31
    depth: int | None = None
    least_rows: int = 20
    bins: int = 255
    l2: float = 0.0
    columns: float = 1.0
    rows: float = 1.0


def newton_rounds(train: DataFrame, growth: Growth, most: int, valid: DataFrame | None = None, patience: int = 20,
                  seed: int = 42) -> tuple[GBTClassificationModel, list[float]]:
    """(boosted model, mean validation loss after each round) from ``train`` (features, label 0 or 1, optional weight).

    The first margin is the log-odds of the weighted labels; a training part of one class or without rows has the margin of
    half a row of each. With ``valid``, rounds end after ``patience`` of them without a lower loss and the model holds
    those up to the best; otherwise all ``most`` are fitted. Every ``WRITE_EVERY`` rounds the margins go to the shared
    folder. Rows drawn for a round depend on a seeded hash of their features, label and the round: reruns agree, and equal
    rows are drawn together.
    """
    if most < 1:
        raise ValueError("at least one round is fitted")
    weight = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    total, pos, n = train.select(weight.alias("w"), "label").agg(
        F.sum("w"), F.sum(F.col("w") * F.col("label")), F.count("*")).first()
    total, pos = total or 0.0, pos or 0.0
    rate = pos / total if 0 < pos < total else (pos + 0.5) / (total + 1.0)
    start = log(rate / (1.0 - rate))
    fitted, losses = _rounds(train, weight, n, growth, most, valid, patience, seed, start, True)
    return _model(train, start, fitted, growth.step), losses


def gradient_rounds(train: DataFrame, growth: Growth, most: int, seed: int = 42) -> GBTClassificationModel:
    """The fit of Spark's boosted classifier (first derivatives, a first tree of weight 1 on the labels as -1 and 1) on rows
    that are binned once."""
    if most < 1:
        raise ValueError("at least one round is fitted")
    weight = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    fitted, _ = _rounds(train, weight, train.count(), growth, most, None, most, seed, 0.0, False)
    return _model(train, None, fitted, growth.step)


def _rounds(train: DataFrame, weight, n: int, growth: Growth, most: int, valid: DataFrame | None, patience: int, seed: int, start: float,
            newton: bool) -> tuple[list[list[tuple]], list[float]]:
    """(node rows of the rounds that are kept, loss after every round)."""
    key = F.xxhash64(F.col("features").cast("string"), "label") if growth.rows < 1 else F.lit(0).cast("long")

    def frame(part: DataFrame, w, held: bool) -> DataFrame:
        return part.select("features", "label", w.alias("weight"), key.alias("key"), F.lit(held).alias("held"))

    rows = frame(train, weight, False)
    if valid is not None:
        rows, n = rows.unionByName(frame(valid, F.lit(1.0), True)), n + valid.count()
    width = train.select("features").first()[0].size
    work = histograms.Rounds.over(rows, n, width, growth, start, newton, seed, WRITE_EVERY)
    about = dict(width=width, most=most, stops=valid is not None, patience=patience, depths=(FIRST_DEPTH, DEEPER, DEEPEST))
    try:
        if n > histograms.TASK:
            return _loop(work, **about)
        edges = work.edges

        def run(blocks):
            return [_loop(histograms.InTask(list(blocks), edges, growth, newton, seed, WRITE_EVERY), **about)]

        return work.state.coalesce(1).mapPartitions(run).collect()[0]
    finally:
        work.close()


def _loop(work: histograms.Rounds, width: int, most: int, stops: bool, patience: int, depths: tuple[int, int, int]) -> tuple[list[list[tuple]], list[float]]:
    """The rounds; with ``stops`` the loss of the held rows ends them."""
    growth, rng, fitted, losses, best = work.growth, random.Random(work.seed), [], [], 0
    while stops or len(fitted) < most:
        columns = tuple(sorted(rng.sample(range(width), max(1, int(growth.columns * width))))) if growth.columns < 1 else tuple(range(width))
        about, counted = work.root(columns)
        if fitted and stops:
            lost, held = counted[2]
            losses.append(float(lost / held) if held else None)
            m = len(losses) - 1
            if losses[m] is None or m == 0 or losses[m] < losses[best]:
                best = m
            if m - best >= patience or len(fitted) == most:
                break
        nodes, picked = work.grow(about, counted, *depths)
        tree, value, out = histograms.finished(nodes, picked, work.edges, growth.l2)
        fitted.append(out)
        work.move(tree, (growth.step if work.newton or about.number else 1.0) * value)
    return fitted[: best + 1] if stops else fitted, losses


_NODE = ("tree int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, "
         "rightChild int, split struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>")


def _model(train: DataFrame, start: float | None, fitted: list[list[tuple]], step: float) -> GBTClassificationModel:
    """Spark's boosted model of the rounds. With ``start``, margins are log-odds that begin there: a constant first tree
    holds the start and, since the model's probability is that of twice its margin, all values are halved."""
    spark = train.sparkSession
    plain = F.col("features").alias("features", metadata={})  # every column by thresholds, whatever its attributes say
    stump = DecisionTreeRegressor(labelCol="label", predictionCol="value", maxDepth=0).fit(train.select(plain, "label").limit(1))
    shell = trees.save_trees(assemble([stump], [1.0], train), spark)
    scales = [1.0] + [step] * (len(fitted) - 1)
    if start is not None:
        root = fitted[0][0]
        fitted = [[(0, start / 2.0, 0.0, root[3], root[4], -1.0, -1, -1, (-1, [], -1))], *fitted]
        scales = [1.0] + [step / 2.0] * (len(fitted) - 1)
    rows = [(t, *node) for t, nodes in enumerate(fitted) for node in nodes]
    about, count = shell.metadata, len(fitted)
    about["numTrees"] = about["paramMap"]["maxIter"] = count
    described = shell.weights().first()["metadata"]
    weights = [(t, described, scale) for t, scale in enumerate(scales)]
    nodes = spark.createDataFrame(rows, _NODE).withColumn("variant", F.lit(0))
    table = spark.createDataFrame(weights, "tree int, metadata string, weight double").withColumn("variant", F.lit(0))
    return trees.write_trees(spark, "GBTClassificationModel", [json.dumps(about)], nodes, table)[0].load()


def growth_of(params: dict, **changes) -> Growth:
    """Growth from the parameters of a recipe, which are named as Spark's where Spark has them."""
    names = {"stepSize": "step", "maxLeaves": "leaves", "maxDepth": "depth", "minInstancesPerNode": "least_rows", "maxBins": "bins",
             "l2": "l2", "columnsPerTree": "columns", "subsamplingRate": "rows"}
    given = {names[k]: v for k, v in params.items() if k in names}
    return replace(Growth(**given), **changes)
