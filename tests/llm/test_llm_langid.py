"""Language identification: held-out accuracy, filter behaviour, edge rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from churnlab.llm import langid
from churnlab.llm.common import read_table
from churnlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in read_table(spark, SF, "documents").select("doc_id", "lang").collect()}
    got = QUERIES["op5_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98


def test_edge_rows(spark):
    train = [(i, f"the cat and the dog number {i} of the house", "en") for i in range(30)] + [
        (100 + i, f"le chat et le chien numéro {i} de la maison", "fr") for i in range(30)] + [(200, "zz", None)]
    filters = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert filters.languages == ("en", "fr")
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the dog and the house"), (5, "la maison et le chien"), (6, "é"), (None, "the cat"),
            (7, "the house of the dog " * 60_000), (4, "the dog and the house")]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, lang string")
    got = langid.predict(docs, filters).select("doc_id", "lang_pred").collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by_id[1] == by_id[2] == by_id[3] == ["und"]
    assert by_id[4] == ["en", "en"] and by_id[5] == ["fr"] and by_id[None] == ["en"] and by_id[7] == ["en"]
    assert by_id[6][0] in ("en", "fr")
    assert langid.predict(docs.limit(0), filters).collect() == []
    nothing = langid.learn(docs.where("1 = 0"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_filter_answers_for_all_languages():
    rows = np.zeros(1 << 12, np.uint8)
    data, at = langid.padded(pa.array(["abc", None, "ABC abc"]))
    assert data[at[0]: at[1]].tobytes() == b" abc " and data[at[1]: at[2]].tobytes() == b"  "
    for k, text in enumerate((b" abc ", b" abd ")):
        for row in langid.filter_rows(langid.gram_codes(np.frombuffer(text, np.uint8), 3), 3, 12):
            rows[row] |= 1 << k
    filters = langid.Filters(("x", "y"), rows[:, None], np.zeros(2), 12, (3,))
    votes, grams = filters.votes(data, at)
    assert grams.tolist() == [3, 0, 7]
    assert votes[0].tolist() == [3, 1] and votes[1].tolist() == [0, 0]


def _words(k, n, seed=1):
    """Text of a made-up language: words over three letters of its own order."""
    rng = np.random.default_rng(seed * 1000 + k)
    letters = np.random.default_rng(k).permutation(list("abcdefghijklmnopqrstuvwxyz"))[:5]
    return " ".join("".join(rng.choice(letters, 6)) for _ in range(n))


def test_more_languages_than_a_word_has_bits(spark):
    languages = [f"l{k:02d}" for k in range(70)]
    train = [(100 * k + i, _words(k, 60, i + 2), lang) for k, lang in enumerate(languages) for i in range(6)]
    filters = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert filters.languages == tuple(languages) and filters.rows.shape == (1 << langid.ROWS_LOG2, 2)
    docs = spark.createDataFrame([(k, _words(k, 80)) for k in range(70)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, filters).collect()} == dict(enumerate(languages))


def test_mask_words_answer_for_their_languages():
    """Votes from two mask words equal those of one language at a time."""
    data = np.frombuffer(b" some bytes of a text ", np.uint8)
    at = np.array([0, 10, len(data)])
    rows = np.random.default_rng(0).integers(0, 2 ** 63, (1 << 8, 2), np.uint64) * np.uint64(2)
    whole, grams = langid.Filters(tuple(map(str, range(128))), rows, np.full(128, 0.1), 8, (3,)).votes(data, at)
    for k in (0, 1, 63, 64, 65, 127):
        single = langid.language_bit(rows, k)[:, None].astype(np.uint8)
        votes, same = langid.Filters(("x",), single, np.full(1, 0.1), 8, (3,)).votes(data, at)
        assert (votes[:, 0] == whole[:, k]).all() and (same == grams).all()


def test_rows_that_share_an_id_are_drawn_one_by_one(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "map_arrow", lambda df, *a, **k: (seen.append(df.count()), real(df, *a, **k))[1])
    from churnlab.llm.common import map_arrow as real
    docs = spark.createDataFrame([(7, _words(1, 8, i), "x") for i in range(3000)] + [(i, _words(2, 8, i), "y") for i in range(40)],
                                 "doc_id long, text string, lang string")
    langid.learn(docs, sample_per_language=200)
    assert 140 + 40 <= seen[0] <= 260 + 40


def test_null_ids_are_not_held_out(spark, tmp_path):
    rows = [(None, "the cat and the dog of the house", "en")] * 2 + [(i, f"the cat {i} and the dog of the house", "en") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_language_id"](spark, str(tmp_path)).collect()
    assert [r.held_out for r in got if r.doc_id is None] == [False, False] and len(got) == 32
