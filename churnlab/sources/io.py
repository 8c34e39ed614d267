"""Sources and sinks (survey IO1-IO9).

Readers take an explicit schema (no inference pass over the data); writers
overwrite whole directories. Model artefacts and scratch tables go under the
session's checkpoint folder (the shared folder that the cluster configures; a
local scratch folder only with a local master).
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField, StructType)

from churnlab.operators.clean import load_level
from churnlab.session import scratch_folder
from churnlab.sources.fixture import POLICYHOLDER_COLUMNS

_STRING = {"customer_id", "as_of_date", "region_name", "age_band", "marital_status", "policy_type",
           "payment_frequency", "churn_type"}
_DOUBLE = {"current_premium", "premium_last_year", "premium_change_pct", "coverage_amount",
           "premium_to_coverage_ratio", "avg_claim_amount", "total_claim_amount_12m", "total_payout_amount_12m",
           "payout_ratio_12m", "avg_settlement_time_days", "churn_probability_true"}

POLICYHOLDER_SCHEMA = StructType([
    StructField(c, StringType() if c in _STRING else DoubleType() if c in _DOUBLE else IntegerType(), True)
    for c in POLICYHOLDER_COLUMNS])

DICTIONARY_SCHEMA = StructType([StructField("column", StringType(), True),
                                StructField("description", StringType(), True)])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return scratch_folder(spark, f"churnlab-{name}")


def read_policyholders_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO1: header CSV with the fixed 40-column schema (no inference pass)."""
    return spark.read.schema(POLICYHOLDER_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)


def load_policyholders(spark: SparkSession, path: str, level: int | None = None, fmt: str = "csv") -> DataFrame:
    """IO2: load with preprocessing level (None: drop unused; 1: + drop
    redundant + encode; anything else: raw)."""
    df = read_policyholders_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)
    return load_level(df, level) if level in (None, 1) else df


def write_policyholders_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_column_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """IO3."""
    return spark.read.schema(DICTIONARY_SCHEMA).option("header", True).option("quote", '"').csv(path)


def write_scored(df: DataFrame, path: str) -> None:
    """IO4: scored table as Parquet (overwrite)."""
    df.write.mode("overwrite").parquet(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """IO5: error if the scored table is missing."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise FileNotFoundError(f"Scored customer file not found: {path}")
    return spark.read.parquet(path)


def export_watchlist_csv(df: DataFrame, path: str) -> None:
    """IO6."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_encoding_map(df: DataFrame, path: str) -> None:
    """IO7: (column, code, label) as JSON lines."""
    df.write.mode("overwrite").json(path)


def load_encoding_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("column string, code int, label string").json(path)


def decode(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """IO7/J3: code -> label by a join with the map (one row per category)."""
    m = mapping.where(F.col("column") == column).select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    return (df.join(m, df[column] == F.col("_code"), "left")
              .withColumn(column, F.coalesce(F.col("_label"), F.col(column).cast("string")))
              .drop("_code", "_label"))


def save_model_bundle(model: PipelineModel, threshold: float, path: str) -> None:
    """IO8: Spark ML pipeline directory + one-row Parquet threshold table."""
    model.write().overwrite().save(os.path.join(path, "model"))
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(float(threshold),)], "threshold double").coalesce(1).write.mode("overwrite") \
         .parquet(os.path.join(path, "threshold"))


def load_model_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, float]:
    model = PipelineModel.load(os.path.join(path, "model"))
    threshold = spark.read.parquet(os.path.join(path, "threshold")).first()["threshold"]
    return model, float(threshold)


def save_split(df: DataFrame, path: str, part: str = "test") -> None:
    """IO9: persist one part of a split."""
    df.where(F.col("split") == part).write.mode("overwrite").parquet(path)
