"""Connected components of a distributed link table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
components in MapReduce and beyond"). Each round re-hangs every node on the
smallest neighbour it knows, so long chains shrink geometrically. A hub that
holds a third of all links costs one partial aggregate (``min``) and one
joined row per link; no adjacency list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from churnlab.llm.common import remove_folder, shared_folder


def component_roots(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node reachable.

    Nodes may be of any orderable type; null ends and self links are ignored;
    repeated links count once; an empty table gives an empty result. Each round
    is written to the shared folder, so a lost executor costs one round.
    """
    spark = links.sparkSession
    kind = links.schema[a].dataType
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    edges, path, seen = _written(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        new, new_path, state = _written(_small_star(_large_star(edges)))
        remove_folder(spark, path)
        edges, path = new, new_path
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
            .select(F.col("node").cast(kind), F.col("root").cast(kind)))


def _written(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """Write the links once; the state tells whether a round changed anything."""
    spark, path = edges.sparkSession, shared_folder(edges.sparkSession, "links")
    edges.write.parquet(path)
    edges = spark.read.schema(edges.schema).parquet(path)
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges, path, tuple(state)


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node on the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # u > v in every stored link, so the larger neighbours of x are the u of the links (u, x).
    return (edges.join(least.withColumnRenamed("u", "v"), "v")
            .select("u", F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each smaller neighbour of a node, and the node, on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where(F.col("u") != F.col("v")).distinct()
