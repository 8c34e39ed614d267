"""The pipeline: each stage on its input against brute force, edge rows, entry points."""

from __future__ import annotations

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from churnlab.llm.common import materialize, read_table
from churnlab.llm.queries import ORACLE, QUERIES
from churnlab.llm.substring import MIN_WORDS
from churnlab.llm.tokens import tokenizer_path
from tests.llm.test_llm_decontaminate import plain
from tests.llm.test_llm_simhash import brute_classes, brute_fingerprint
from tests.llm.test_llm_substring import brute_passages
from tests.llm.test_llm_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read_table(spark, SF, "documents"), []
    for name, stage in pipeline.STAGES:
        after = materialize(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_entry_has_all_queries():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")}
    assert names["pipeline"] is pipeline.run and set(ORACLE) <= set(entry.oracle_sql()) and set(QUERIES) <= set(names)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]


def test_columns(spark, stages):
    columns = read_table(spark, SF, "documents").dtypes
    assert all(after.dtypes == columns for _, _, after in stages[:-1])


def test_language_id_keeps_every_text_with_letters(stages):
    _, before, after = stages[0]
    assert rows(after) == {i: t for i, t in rows(before).items() if t and any(map(str.isalpha, t))}


def test_simhash_keeps_one_of_each_group(stages):
    _, before, after = stages[1]
    texts = rows(before)
    ids = list(texts)
    classes = brute_classes(ids, [brute_fingerprint(texts[i]) for i in ids], 3)
    assert rows(after) == {i: texts[i] for i in ids if classes[i] == i}


def test_substring_cuts_repeated_passages(stages):
    _, before, after = stages[2]
    want = rows(before)
    for i, spans in brute_passages(list(want.items()), MIN_WORDS).items():
        raw = want[i].encode()
        for start, length, *_ in reversed(spans):
            raw = raw[:start] + raw[start + length:]
        want[i] = raw.decode()
    assert rows(after) == {i: t for i, t in want.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_decontamination_drops_documents_with_items(spark, stages):
    _, before, after = stages[3]
    items = [plain(r.text) for r in read_table(spark, SF, "benchmark").collect()]
    want = {i: t for i, t in rows(before).items() if not any(x in plain(t) for x in items)}
    assert rows(after) == want


def test_packing_holds_all_that_is_left(stages):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    direct = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    _, before, after = stages[4]
    check_packing(after.collect(), rows(before), direct, 1024, 2)


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(pipeline.run(spark, SF)) == key(stages[-1][2])


def test_edge_rows_pass_all_stages(spark):
    base = read_table(spark, SF, "documents").limit(40).selectExpr("*", "1 as score", "'x' as lang_pred", "2 as spans", "3 as fingerprint")
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "12 34 !!", "en", "s", 8), (None, "of the and to is", None, None, None),
           (1003, "the " * 50_000, "en", "s", 200_000), (1004, "the and of to is", "en", "s", 16), (1004, "the and of to is", "en", "s", 16)]
    odd = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in odd], base.schema)
    docs = materialize(base.unionByName(odd))
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF))
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert not ids & {1000, 1001, 1002} and {None, 1003, 1004} <= ids, name
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert docs.count() == 0


def test_batches_between_spark_and_python_are_small(spark):
    """Executors hold the buffers of a batch beside the heap, and their allocator keeps them: 2 MB and a row at most."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from churnlab.llm.common import map_arrow

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["size"])

    texts = spark.range(0, 160, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))  # 16 MB
    found = [r.size for r in map_arrow(texts, sizes, "size long").collect()]
    assert sum(found) >= 16_000_000 and max(found) <= (2 << 20) + 110_000
