"""Fitted tree ensembles as node tables (survey L7, L14, L15, L22, L26-L29, EV13).

A saved forest or boosted model is a table with one row per node. On that table
this module does what Spark's estimators have no parameter for:

* pruning: nodes that hold fewer rows than a minimum to split, or that lie
  deeper than a limit, become leaves. The splits above are those that a fit with
  the limit chooses, since a split depends on the rows of its node alone;
* best-first growth: of a deep tree only as many leaves as the splits of the
  largest gain make, picked one by one;
* prefixes: the first trees of an ensemble. The first m trees of a boosted fit
  are the fit with m rounds, and the first m trees of a forest, each grown from
  a sample and column draws of its own, are a forest of m trees;
* assembly of one boosted model from trees that were fitted one by one;
* importances as an aggregate over nodes.

One fit thus serves all points of a search grid that differ in the number of
trees, the depth or the rows to split. A reduced model is written below the
shared folder and loaded again, so Spark scores it like any other. Tables here
are as large as a model; a task holds the nodes of one tree.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.session import scratch_folder

_KINDS = {"GBTClassificationModel": GBTClassificationModel, "RandomForestClassificationModel": RandomForestClassificationModel}


def reduced_tree(left: np.ndarray, right: np.ndarray, rows: np.ndarray, gain: np.ndarray, prediction: np.ndarray, max_depth: int | None = None,
                 min_split: int = 0, max_leaves: int | None = None, merge: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(nodes that stay, in preorder; whether each still splits) of a tree whose nodes are numbered in preorder.

    ``merge``: siblings that are leaves of one prediction become one leaf, as in a fitted classification tree.
    """
    n = len(left)
    depth = np.zeros(n, np.int64)
    for i in range(n):  # a child comes after its parent
        if left[i] >= 0:
            depth[left[i]] = depth[right[i]] = depth[i] + 1
    splits = (left >= 0) & (rows >= min_split)
    if max_depth is not None:
        splits &= depth < max_depth
    if max_leaves is not None:
        chosen, front, leaves = np.zeros(n, bool), [], 1
        if splits[0]:
            front.append((-gain[0] * rows[0], 0))
        while front and leaves < max_leaves:
            _, i = heapq.heappop(front)
            chosen[i], leaves = True, leaves + 1
            for child in (left[i], right[i]):
                if splits[child]:
                    heapq.heappush(front, (-gain[child] * rows[child], int(child)))
        splits = chosen
    reached = np.zeros(n, bool)
    reached[0] = True
    for i in range(n):
        if reached[i] and splits[i]:
            reached[left[i]] = reached[right[i]] = True
    splits &= reached
    if merge:
        for i in range(n - 1, -1, -1):
            if splits[i] and not splits[left[i]] and not splits[right[i]] and prediction[left[i]] == prediction[right[i]]:
                splits[i] = reached[left[i]] = reached[right[i]] = False
    return np.flatnonzero(reached), splits


@dataclass(frozen=True)
class SavedTrees:
    """An ensemble in Spark's saved form: a metadata line, a table of trees and a table of nodes."""

    spark: SparkSession
    path: str
    kind: str

    @property
    def metadata(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/metadata").first()[0])

    def nodes(self) -> DataFrame:
        """One row per node: tree, id (preorder), prediction, impurity, impurityStats, rawCount, gain, leftChild, rightChild, split."""
        return self.spark.read.parquet(f"{self.path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")

    def weights(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/treesMetadata").toDF("tree", "metadata", "weight")

    def load(self):
        return _KINDS[self.kind].load(self.path)

    def reduced(self, **limits) -> "SavedTrees":
        """The ensemble with the first ``trees`` trees, each pruned to ``max_depth``, ``min_split`` and ``max_leaves``."""
        return self.reduced_each([limits])[0]

    def reduced_each(self, limits: list[dict]) -> list["SavedTrees"]:
        """One reduced ensemble for each set of limits, from one pass over the nodes: tasks get the shape of a tree and
        return which nodes stay in which variant, and one write per table puts each variant into a folder of its own."""
        nodes, n = self.nodes(), self.metadata["numTrees"]
        merge, cut = self.kind == "RandomForestClassificationModel", [{k: v for k, v in some.items() if k != "trees"} for some in limits]
        counts = [min(some.get("trees") or n, n) for some in limits]

        def prune(tree: pd.DataFrame) -> pd.DataFrame:
            tree = tree.sort_values("id")
            shape = [tree[c].to_numpy() for c in ("leftChild", "rightChild", "rawCount", "gain", "prediction")]
            number, out = int(tree["tree"].iloc[0]), []
            for variant, some in enumerate(cut):
                if number >= counts[variant]:
                    continue
                kept, splits = reduced_tree(*shape, merge=merge, **some) if some else (np.arange(len(tree)), shape[0] >= 0)
                new = np.full(len(tree), -1)
                new[kept] = np.arange(len(kept))
                left, right = (np.where(splits[kept], new[child[kept]], -1) for child in shape[:2])
                out.append(pd.DataFrame({"variant": variant, "tree": number, "id": kept, "new": new[kept], "l": left, "r": right}))
            return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int32") for c in ("variant", "tree", "id", "new", "l", "r")})

        shapes = nodes.select("tree", "id", "leftChild", "rightChild", "rawCount", "gain", "prediction")
        stays = shapes.groupBy("tree").applyInPandas(prune, "variant int, tree int, id int, new int, l int, r int")
        leaf, no_split = F.col("l") < 0, F.expr("named_struct('featureIndex', -1, 'leftCategoriesOrThreshold', cast(array() as array<double>), 'numCategories', -1)")
        kept = stays.join(nodes, ["tree", "id"]).select(
            "variant", "tree", F.col("new").alias("id"), "prediction", "impurity", "impurityStats", "rawCount",
            F.when(leaf, -1.0).otherwise(F.col("gain")).alias("gain"), F.col("l").alias("leftChild"), F.col("r").alias("rightChild"),
            F.when(leaf, no_split).otherwise(F.col("split")).alias("split"))
        wanted = self.spark.createDataFrame(list(enumerate(counts)), "variant int, n int")
        weights = self.weights().crossJoin(F.broadcast(wanted)).where("tree < n").drop("n")
        lines = []
        for count in counts:
            metadata = self.metadata if not lines else json.loads(lines[0])
            metadata["numTrees"] = metadata["paramMap"]["maxIter" if self.kind == "GBTClassificationModel" else "numTrees"] = count
            lines.append(json.dumps(metadata))
        return write_trees(self.spark, self.kind, lines, kept, weights)

    def importances(self) -> DataFrame:
        """EV13: (slot, importance): the impurity that the splits on a feature remove, times their rows, as a share of all.
        The trees of a forest count alike; those of a boosted model count by what they remove."""
        rows = F.aggregate("impurityStats", F.lit(0.0), lambda held, v: held + v) if self.kind == "RandomForestClassificationModel" \
            else F.col("impurityStats")[0]
        removed = self.nodes().where("leftChild >= 0").groupBy("tree", F.col("split.featureIndex").alias("slot")).agg(F.sum(F.col("gain") * rows).alias("v"))
        if self.kind == "RandomForestClassificationModel":
            whole = removed.groupBy("tree").agg(F.sum("v").alias("tree_sum"))
            removed = removed.join(whole, "tree").where("tree_sum > 0").withColumn("v", F.col("v") / F.col("tree_sum"))
        by_slot = removed.groupBy("slot").agg(F.sum("v").alias("v"))
        return by_slot.crossJoin(by_slot.agg(F.sum("v").alias("all"))).select("slot", F.try_divide("v", "all").alias("importance"))


def save_trees(model, spark: SparkSession) -> SavedTrees:
    """Write a fitted forest or boosted classifier below the shared folder."""
    path = scratch_folder(spark, "trees")
    model.write().overwrite().save(path)
    return SavedTrees(spark, path, type(model).__name__)


def write_trees(spark: SparkSession, kind: str, metadata: list[str], nodes: DataFrame, weights: DataFrame) -> list[SavedTrees]:
    """A saved ensemble for each metadata line; ``nodes`` and ``weights`` name theirs in ``variant``."""
    root = scratch_folder(spark, "trees")
    node = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split")
    tables = {"data": nodes.select("variant", F.col("tree").alias("treeID"), node.alias("nodeData")),
              "treesMetadata": weights.select("variant", F.col("tree").alias("_1"), F.col("metadata").alias("_2"), F.col("weight").alias("_3")),
              "metadata": spark.createDataFrame(list(enumerate(metadata)), "variant int, value string")}
    for name, table in tables.items():
        out = table.repartition("variant").write.partitionBy("variant")
        (out.text if name == "metadata" else out.parquet)(f"{root}/all/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for i in range(len(metadata)):
        fs.mkdirs(path(f"{root}/{i}"))
        for name in tables:
            if not fs.rename(path(f"{root}/all/{name}/variant={i}"), path(f"{root}/{i}/{name}")):
                raise OSError(f"{name} of variant {i} can't be moved below {root}")
    return [SavedTrees(spark, f"{root}/{i}", kind) for i in range(len(metadata))]


def reduced(model, spark: SparkSession, **limits):
    """A fitted forest or boosted classifier after pruning (``SavedTrees.reduced``), loaded again."""
    return save_trees(model, spark).reduced(**limits).load()
