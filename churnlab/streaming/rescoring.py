"""Incremental form of the scored-table refresh (survey R7, W1).

The reference re-scores its whole table at every app start; it has no stream,
watermark or state. Where new policyholder files keep arriving, the same
refresh runs as a Structured Streaming job: each micro-batch of new rows gets
the stateless score columns (class, tier, label, reason) and is written next to
its score histogram (score, rows). Histograms merge by addition, so the global
``coupon_priority`` of any rows is a running sum over distinct scores plus a
place among the rows of the same score; what earlier batches hold is neither
sorted nor rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.functions.scoring import DEFAULT_THRESHOLD, add_score_columns
from churnlab.operators.ranking import prefix_sums, rank_within_groups
from churnlab.sources.io import POLICYHOLDER_SCHEMA

SCORE = "churn_probability"


def write_batch(df: DataFrame, batch: int, sink_dir: str, score_col: str = "churn_probability_true", threshold: float = DEFAULT_THRESHOLD) -> None:
    """Score one batch and write its rows and its histogram under its number: a batch that runs again writes the same."""
    spark, rows = df.sparkSession, f"{sink_dir}/rows/batch={batch}"
    add_score_columns(df, score_col, threshold).write.mode("overwrite").parquet(rows)
    spark.read.parquet(rows).groupBy(SCORE).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{sink_dir}/histogram/batch={batch}")


def rescoring_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                     score_col: str = "churn_probability_true", threshold: float = DEFAULT_THRESHOLD,
                     fmt: str = "parquet", available_now: bool = True, files_per_batch: int | None = None):
    """Start the stream and return the ``StreamingQuery``.

    ``checkpoint_dir`` must be on shared storage (offsets and commit logs, and batches that overwrite themselves, make
    the sink exactly-once across restarts and executor loss).
    """
    reader = spark.readStream.schema(POLICYHOLDER_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    src = reader.option("header", True).csv(source_dir) if fmt == "csv" else reader.parquet(source_dir)
    writer = (src.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, sink_dir, score_col, threshold))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def scored_rows(spark: SparkSession, sink_dir: str) -> DataFrame:
    """All scored rows with their ``batch``."""
    return spark.read.parquet(f"{sink_dir}/rows")


def priorities(spark: SparkSession, sink_dir: str, batch: int | None = None) -> DataFrame:
    """W1 from the histograms: the rows (of one batch, or all) with ``coupon_priority`` among all rows written so far.

    Rows with a higher score come from one running sum over the distinct scores. Only rows whose score occurs more than
    once (and, for one batch, occurs in it) are ordered by id; a score that a third of all rows share is many ranges.
    """
    merged = spark.read.parquet(f"{sink_dir}/histogram").groupBy(SCORE).agg(F.sum("n").alias("n"))
    above = prefix_sums(merged, [F.col(SCORE).desc()], ["n"], prefix="above_", inclusive=False).select(F.col(SCORE).alias("s"), "n", "above_n")
    rows = scored_rows(spark, sink_dir)
    asked = rows if batch is None else rows.where(F.col("batch") == batch)
    placed = asked.join(above, F.col(SCORE).eqNullSafe(F.col("s"))).drop("s")
    tied = above.where("n > 1").select(F.col("s").alias("t"))
    if batch is not None:
        tied = tied.join(asked.select(F.col(SCORE).alias("own")).distinct(), F.col("t").eqNullSafe(F.col("own"))).drop("own")
    equal = rows.select("customer_id", SCORE).join(tied, F.col(SCORE).eqNullSafe(F.col("t"))).drop("t")
    order = rank_within_groups(equal, SCORE, ["customer_id"], "place").select(F.col("customer_id").alias("i"), "place")
    out = placed.join(order, F.col("customer_id") == F.col("i"), "left").drop("i")
    return out.withColumn("coupon_priority", F.col("above_n") + F.coalesce("place", F.lit(1))).drop("n", "above_n", "place")
