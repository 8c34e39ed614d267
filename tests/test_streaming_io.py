"""Streaming re-scoring and the file sources/sinks round trips."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from churnlab.functions.scoring import DEFAULT_THRESHOLD, add_score_columns
from churnlab.sources import io
from churnlab.sources.lookups import COLUMN_DESCRIPTIONS
from churnlab.operators.scoring import add_coupon_priority
from churnlab.streaming import rescoring
from churnlab.streaming.rescoring import rescoring_stream


def test_stream_rescoring_matches_batch(ph):
    spark = ph.sparkSession
    src = io.scratch_path(spark, "stream-src")
    ph.repartition(3).write.parquet(src)
    sink = io.scratch_path(spark, "stream-sink")
    q = rescoring_stream(spark, src, sink, io.scratch_path(spark, "stream-ckpt"))
    q.awaitTermination(120)
    got = rescoring.scored_rows(spark, sink)
    exp = add_score_columns(ph, "churn_probability_true", DEFAULT_THRESHOLD)
    cols = ["customer_id", "predicted_churn", "risk_tier", "risk_tier_ko", "prediction_reason"]
    assert got.count() == ph.count()
    assert got.select(*cols).exceptAll(exp.select(*cols)).count() == 0


def test_priorities_after_three_batches_are_the_batch_ranking(ph):
    """Ties within a batch, over batches, and rows without a score; new rows alone are ranked among all."""
    spark = ph.sparkSession
    p = F.when(F.col("customer_id") < F.lit("C00000030"), 0.5).otherwise(F.round("churn_probability_true", 1))
    given = ph.withColumn("churn_probability_true", F.when(F.pmod(F.hash("customer_id"), F.lit(11)) > 0, p))
    src, sink = io.scratch_path(spark, "stream-src"), io.scratch_path(spark, "stream-sink")
    given.repartition(3, F.hash("customer_id")).write.parquet(src)
    rescoring_stream(spark, src, sink, io.scratch_path(spark, "stream-ckpt"), files_per_batch=1).awaitTermination(120)
    rows = rescoring.scored_rows(spark, sink)
    batches = sorted(r[0] for r in rows.select("batch").distinct().collect())
    assert len(batches) > 1
    want = {r.customer_id: r.coupon_priority for r in add_coupon_priority(rows).collect()}
    assert {r.customer_id: r.coupon_priority for r in rescoring.priorities(spark, sink).collect()} == want
    for b in batches:
        new = rescoring.priorities(spark, sink, b).collect()
        assert {r.batch for r in new} == {b} and all(want[r.customer_id] == r.coupon_priority for r in new)
    before = rows.count()
    rescoring.write_batch(rows.where(f"batch = {batches[-1]}").drop("batch").withColumn("churn_probability_true", F.col("churn_probability")), batches[-1] + 1, sink)
    rescoring.write_batch(given.limit(0), batches[-1] + 1, sink)  # the same number again: it replaces what was written
    assert rescoring.scored_rows(spark, sink).count() == before


def test_csv_roundtrip_and_levels(ph):
    spark = ph.sparkSession
    path = io.scratch_path(spark, "csv")
    io.write_policyholders_csv(ph, path)
    raw = io.load_policyholders(spark, path, level=2)
    assert raw.count() == ph.count()
    assert raw.select(*ph.columns).exceptAll(ph).count() == 0
    lvl0 = io.load_policyholders(spark, path)          # drop unused columns
    assert "customer_id" not in lvl0.columns and "churn_flag" in lvl0.columns
    lvl1 = io.load_policyholders(spark, path, level=1)  # + redundant dropped + encoded
    assert dict(lvl1.dtypes)["policy_type"] == "int"


def test_dictionary_csv(spark):
    path = io.scratch_path(spark, "dict")
    spark.createDataFrame(COLUMN_DESCRIPTIONS, "column string, description string").coalesce(1) \
         .write.option("header", True).csv(path)
    d = io.read_column_dictionary(spark, path)
    assert d.count() == 40


def test_scored_missing_raises(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        io.read_scored(spark, os.path.join(io.scratch_path(spark, "none"), "missing"))


def test_encoding_map_roundtrip(ph):
    from churnlab.operators.clean import encoding_table, label_encode
    spark = ph.sparkSession
    m = encoding_table(ph)
    path = io.scratch_path(spark, "enc")
    io.save_encoding_map(m, path)
    back = io.load_encoding_map(spark, path)
    enc = label_encode(ph.select("customer_id", "policy_type"), ["policy_type"])
    dec = io.decode(enc, back, "policy_type")
    assert dec.join(ph.select("customer_id", F.col("policy_type").alias("orig")), "customer_id") \
              .where(F.col("policy_type") != F.col("orig")).count() == 0
