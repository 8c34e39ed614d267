"""Boosted trees that go on from where they are (survey L22, L29).

Spark's boosted classifier fits a fixed number of rounds, or stops at the first
round that is no better. Here a round is one tree on the residuals of the
logistic loss, fitted by Spark's tree regressor, and the margin of every row is a
column: a fit can look at the validation loss after each round, go on as long as
that pays, and stop after any number of rounds without a better one. Rounds,
seeds, residuals and weights are those of the boosted classifier, so the trees of
m rounds equal its first m trees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.session import materialize

#: Rounds after which the margins are written, so that neither a plan nor what a lost executor costs grows with the rounds.
WRITE_EVERY = 10


@dataclass
class Boosted:
    model: GBTClassificationModel   # the rounds up to the best one
    losses: list[float]             # validation loss after every round that was fitted


def log_loss(margin, sign):
    """2 log(1 + exp(-2 y F)) without overflow; y is -1 or 1."""
    z = -2.0 * margin * sign
    return 2.0 * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def boost_until(train: DataFrame, valid: DataFrame, most: int, patience: int, step: float, tree_params: dict, seed: int = 42) -> Boosted:
    """Boost on ``train`` (features, label 0 or 1) until ``patience`` rounds in turn have not lowered the mean loss on
    ``valid``, or ``most`` rounds.

    The plan of a round reads one cached frame per part; every ``WRITE_EVERY`` rounds the margins are written to the
    shared folder. Without validation rows all ``most`` rounds are fitted.
    """
    sign = F.col("label") * 2.0 - 1.0
    frames = [part.select("features", sign.alias("sign"), F.lit(0.0).alias("margin")).persist() for part in (train, valid)]
    fitted, weights, losses, best = [], [], [], 0
    while len(fitted) < most:
        m, y, f = len(fitted), F.col("sign"), F.col("margin")
        target = 4.0 * y / (1.0 + F.exp(2.0 * y * f)) if m else y
        tree = DecisionTreeRegressor(labelCol="target", predictionCol="value", seed=seed + m, **tree_params).fit(frames[0].withColumn("target", target))
        fitted.append(tree)
        weights.append(step if m else 1.0)
        moved = [tree.transform(part).select("features", "sign", (f + F.lit(weights[-1]) * F.col("value")).alias("margin")) for part in frames]
        moved = [materialize(part).persist() if (m + 1) % WRITE_EVERY == 0 else part.persist() for part in moved]
        losses.append(moved[1].agg(F.avg(log_loss(f, y))).first()[0])
        moved[0].count()  # filled before the frame that it reads goes
        for part in frames:
            part.unpersist()
        frames = moved
        if losses[-1] is None:
            best = m
        elif m == 0 or losses[-1] < losses[best]:
            best = m
        if m - best >= patience:
            break
    for part in frames:
        part.unpersist()
    return Boosted(assemble(fitted[: best + 1], weights[: best + 1], train), losses)


def assemble(fitted: list, weights: list[float], rows: DataFrame) -> GBTClassificationModel:
    """One boosted classifier from regression trees and their weights."""
    context = rows.sparkSession.sparkContext
    jvm = context._jvm
    made = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(fitted))
    scale = context._gateway.new_array(jvm.double, len(fitted))
    for i, (tree, weight) in enumerate(zip(fitted, weights)):
        made[i], scale[i] = tree._java_obj, float(weight)
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(fitted[0].uid, made, scale))
