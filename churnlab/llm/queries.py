"""Registered queries of the corpus operators: thin contracts over the operators' general interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnlab.llm import decontaminate, embeddings, infill, langid, licenses, mixing, packing, records, simhash, substring, toxicity, warc, whitening
from churnlab.llm.common import held_out, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, words, first_doc_id: one row per passage of 25 words or more that goes because a document
    with a smaller id (first_doc_id) holds it."""
    found = substring.repeated_passages(read_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("first_id", "first_doc_id")


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; links at cosine 0.95 or more."""
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


ORACLE["op2_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
l AS (SELECT a, b FROM s WHERE NOT isnan(c) AND c >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, length, edits: one row per document and benchmark item with a shared passage."""
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from rows with crc32(doc_id) mod 3 other than 1.
    A row without an id is neither held out nor learned from."""
    docs = read_table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 3, 1)
    found = langid.predict(docs, langid.learn(docs.where(~held)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the record files by their offset index."""
    folder, index = records.write_token_files(read_table(spark, sf_dir, "documents"), end_id=0, any_ids=True)
    read = records.read_token_files(folder, records.with_global_start(index), keep=("start",))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from rows with crc32(doc_id) mod 4 other than 2.
    A row without an id is neither held out nor learned from."""
    docs = read_table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.learn(docs.where(~held), read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    folder, index = warc.write_archives(read_table(spark, sf_dir, "pages"), min_bytes=100, any_ids=True)
    read = warc.read_archives(folder, index)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM f
"""


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece: 1024 ids, end id 2."""
    return packing.pack(read_table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document: 3-word shingles, 3 bits."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words_per_shingle=3, max_bits=3)
    return found.select("doc_id", simhash.fingerprint_hex("fingerprint").alias("fingerprint"), "component_id")


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: 8 components of every usable vector."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)


@query
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, range-sorted by its first training position."""
    mix = mixing.assign(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), repeats=3, share=1.0)
    first = F.get("copies", F.lit(0))["position"]
    return mix.withColumn("first", first).repartitionByRange("first", "doc_id").sortWithinPartitions("first", "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken")


ORACLE["op12_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)) NULLS LAST, doc_id NULLS LAST, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM d GROUP BY source),
r AS (SELECT *, source_size * 3 AS most, (SELECT sum(source_size) FROM s) AS whole,
             coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3e0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(weight) OVER (ORDER BY source_size * 3e0 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
l AS (SELECT max(CAST(whole - used AS DOUBLE) / CAST(rest AS DOUBLE)) AS level FROM r WHERE most > weight * (CAST(whole - used AS DOUBLE) / CAST(rest AS DOUBLE))),
t AS (SELECT source, source_size, CASE WHEN most <= weight * coalesce(level, 'inf'::DOUBLE) THEN CAST(most AS DOUBLE) ELSE weight * level END AS target FROM r, l)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target + 0.5) - start)) + greatest(0, least(size, floor(target + 0.5) - start - source_size))
            + greatest(0, least(size, floor(target + 0.5) - start - 2 * source_size)) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    out = infill.transform(read_table(spark, sf_dir, "documents"), seed=42)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
             CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
