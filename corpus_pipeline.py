"""Training-data pipeline over ``documents``: five stages, each written as Parquet and reread as the next one's input.

1. language ID: documents without a recognised language go;
2. SimHash near-dedup: one document of each group of near copies stays (the one with the smallest id);
3. substring dedup: passages that a document with a smaller id holds are cut out of the text;
4. benchmark decontamination: documents that share a passage with ``benchmark`` go;
5. best-fit packing of what is left into sequences of 1024 ids.

All stages but the last return the columns of ``documents``. Every decision is
taken over all rows that the stage is given, with the parameters of the
registered queries. Null ids stay what they are: each such row is a document of
its own that comes after all documents with ids. Rows that repeat an id are told
apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnlab.llm import decontaminate, langid, packing, simhash, substring
from churnlab.llm.common import held_out, materialize, read_table, row_keys

#: Least share of a text's n-grams that its language must contain.
MIN_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a predicted language; learned from the labelled ones outside the held-out third."""
    filters = langid.learn(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    given = docs.toDF(*[f"col{i}" for i in range(len(docs.columns))])  # whatever the extra columns are called
    id_col, text_col = (f"col{docs.columns.index(c)}" for c in ("doc_id", "text"))
    found = langid.predict(given, filters, id_col, text_col, keep=tuple(c for c in given.columns if c != id_col))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*given.columns).toDF(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked by fingerprints (rows that repeat an id and its text
    stay or go together); a row without an id stays where its group has no other before it."""
    key = "_".join(["key", *docs.columns])  # no column of the table has this name
    keyed = row_keys(docs, key)
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(key).alias("k"))  # null ids last
    found = simhash.near_duplicates(keyed.select(row.alias("row"), "text"), "row", words_per_shingle=3, max_bits=3)
    copies = found.where(F.col("component_id") != F.col("row")).select(F.col("row.id").alias(f"{key}_id"), F.col("row.k").alias(f"{key}_k"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{key}_id")) & (F.col(key) == F.col(f"{key}_k"))
    return keyed.join(copies, same, "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out; n_chars follows the new text. A document that loses its last word goes."""
    return substring.without_repeats(docs, null_ids=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that share a passage with a benchmark item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its place in the packed sequences."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but a filter by ids could be put into SQL (XXH64 fingerprints, gear-hash chunks, token ids):
#: ``tests/llm`` holds the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
