"""Language identification by language-bitmask n-gram filters.

The filter is a bit-sliced Bloom filter: row ``i`` holds one bit per language,
and the rows that an n-gram hashes to are and-ed, which answers for all
languages at once which of them contain it. A text's votes are the popcounts of
the answers per language, less what the fill of each language's slice lets
through by chance; the language with the most corrected votes wins.

Learning takes a bounded sample of labelled documents per language. Prediction
reads whole texts in the scan tasks and shuffles nothing; the filter is
``2**rows_log2`` bytes for up to eight languages, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from churnlab.llm.common import map_arrow, slices, utf8

#: Lengths of the n-grams in bytes of the padded, lower-cased text.
ORDERS = (3, 5)
HASHES = 3
ROWS_LOG2 = 20
#: Bits of a mask word where there are more languages than one word has bits; fewer get the smallest word that holds them.
WORD_BITS = 64
#: Labelled documents that are learned from, per language (about this many, by hash of id and text).
SAMPLE_PER_LANGUAGE = 2000
#: N-grams that enter the filter, per language and order (the most frequent ones).
GRAMS_PER_LANGUAGE = 60_000
#: An n-gram counts as contained in a language where its relative frequency is at least this share of its highest.
CONTAINED_SHARE = 0.1
UNKNOWN = "und"

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of every text with a space before and after it, and their offsets."""
    column = pc.fill_null(column, "")
    space = pa.scalar(" ", column.type)
    raw, at = utf8(pc.binary_join_element_wise(space, column, space, pa.scalar("", column.type)))
    return _FOLD[raw], at


def gram_codes(data: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes that begin at each position, packed into one integer."""
    n = max(0, len(data) - order + 1)
    code = np.zeros(n, np.uint64)
    for k in range(order):
        code = (code << np.uint64(8)) | data[k: k + n]
    return code


def filter_rows(codes: np.ndarray, order: int, rows_log2: int) -> list[np.ndarray]:
    """The filter rows of each n-gram, one array per hash function."""
    mixed = (codes + np.uint64(order << 56)) * _MIX[0]
    mixed ^= mixed >> np.uint64(29)
    return [(mixed * m) >> np.uint64(64 - rows_log2) for m in _MIX[1: HASHES + 1]]


def language_bit(masks: np.ndarray, k: int) -> np.ndarray:
    """0 or 1 per row of mask words: the bit of language ``k``."""
    one = masks.dtype.type(1)
    return (masks[:, k // WORD_BITS] >> masks.dtype.type(k % WORD_BITS)) & one


@dataclass(frozen=True)
class Filters:
    """Languages (bit 0 of word 0 first), filter rows as mask words (row, word), chance of a false answer per language."""

    languages: tuple[str, ...]
    rows: np.ndarray
    false_rate: np.ndarray
    rows_log2: int
    orders: tuple[int, ...]

    def votes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(corrected votes per text and language, n-grams per text)."""
        texts, n = len(at) - 1, len(self.languages)
        votes, grams = np.zeros((texts, n)), np.zeros(texts, np.int64)
        for order in self.orders:
            codes = gram_codes(data, order)
            known = np.full((len(codes), self.rows.shape[1]), np.iinfo(self.rows.dtype).max, self.rows.dtype)
            for row in filter_rows(codes, order, self.rows_log2):
                known &= self.rows[row]
            first, last = np.minimum(at[:-1], len(codes)), np.clip(at[1:] - order + 1, 0, len(codes))
            last = np.maximum(first, last)
            size = last - first
            grams += size
            for k in range(n):
                upto = np.concatenate(([0], np.cumsum(language_bit(known, k), dtype=np.int64)))
                false = self.false_rate[k]
                votes[:, k] += np.maximum(0.0, (upto[last] - upto[first] - size * false) / (1 - false))
        return votes, grams


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_per_language: int = SAMPLE_PER_LANGUAGE, rows_log2: int = ROWS_LOG2) -> Filters:
    """Fit the filters on a bounded sample of the rows with a language.

    The sample keeps the rows whose hashed id and text fall below bound / rows of
    the language, so rows that share an id are drawn one by one (equal rows
    together). All languages are learned. Only n-grams of the sample, at most
    ``GRAMS_PER_LANGUAGE`` per language and order, reach the driver; the filter
    has ``2**rows_log2`` rows of a bit per language.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect())  # a row per language
    languages = tuple(lang for lang, _ in counts)
    if not languages:
        return Filters((), np.zeros((1 << rows_log2, 1), np.uint8), np.zeros(0), rows_log2, ORDERS)
    facts = docs.sparkSession.createDataFrame(
        [(lang, k, min(1.0, sample_per_language / n)) for k, (lang, n) in enumerate(counts)], "lang string, k int, share double")
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.join(F.broadcast(facts), "lang").where(drawn < F.col("share")).select("text", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = padded(part.column("text"))
                k = part.column("k").to_numpy()
                for order in ORDERS:
                    codes = gram_codes(data, order)
                    owner = np.repeat(np.arange(len(k)), np.diff(at))[: len(codes)]
                    whole = np.arange(len(codes)) + order <= at[1:][owner]
                    for lang in np.unique(k):
                        code, n = np.unique(codes[whole & (k[owner] == lang)], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(code), lang, np.int32)), pa.array(np.full(len(code), order, np.int32)),
                             pa.array(code.view(np.int64)), pa.array(n)], ["k", "o", "code", "n"])

    grams = map_arrow(sample, run, "k int, o int, code long, n long").groupBy("k", "o", "code").agg(F.sum("n").alias("n"))
    grams = grams.where(~F.col("code").isin([int("20" * order, 16) for order in ORDERS]))  # white space alone
    total = grams.groupBy("k", "o").agg(F.sum("n").alias("total"))
    rate = grams.join(F.broadcast(total), ["k", "o"]).withColumn("rate", F.col("n") / F.col("total"))  # a row per language and order
    highest = rate.groupBy("o", "code").agg(F.max("rate").alias("highest"))
    held = rate.join(highest, ["o", "code"]).where((F.col("rate") >= CONTAINED_SHARE * F.col("highest")) & (F.col("n") > 1))
    place = F.row_number().over(Window.partitionBy("k", "o").orderBy(F.desc("n"), "code"))  # over a bounded sample
    chosen = held.withColumn("place", place).where(F.col("place") <= GRAMS_PER_LANGUAGE).select("k", "o", "code").toPandas()
    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if np.dtype(t).itemsize * 8 >= len(languages)), np.uint64)
    rows = np.zeros((1 << rows_log2, -(-len(languages) // WORD_BITS)), kind)
    for (k, order), part in chosen.groupby(["k", "o"]):
        for row in filter_rows(part.code.to_numpy().astype(np.int64).view(np.uint64), int(order), rows_log2):
            rows[row, k // WORD_BITS] |= kind(1) << kind(k % WORD_BITS)
    fill = np.array([np.count_nonzero(language_bit(rows, k)) / len(rows) for k in range(len(languages))])
    return Filters(languages, rows, fill ** HASHES, rows_log2, ORDERS)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``lang_pred`` and ``score`` of every row, after the columns named in ``keep``.

    score is the share of the text's n-grams that the language contains (0 to
    1). A null text and one without a letter is ``und`` with score 0, and so is
    every text if nothing was learned. Ties go to the language that sorts
    first; null ids and repeated rows are returned as given.
    """
    columns = [id_col, *keep]
    if text_col not in columns:
        columns.append(text_col)  # a text that is kept travels once
    names = [f"c{i}" for i in range(len(columns))]
    out_names, text_name = names[: 1 + len(keep)], names[columns.index(text_col)]
    given = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip([id_col, *keep], out_names))
    schema += ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*filters.languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, text_name):
                column = part.column(text_name)
                data, at = padded(column)
                letters = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
                has = letters[at[1:]] > letters[at[:-1]]
                for i in np.flatnonzero(~has):  # no a-z: look at the other letters
                    has[i] = any(map(str.isalpha, column[i].as_py() or ""))
                best = np.full(len(has), len(filters.languages))
                score = np.zeros(len(has))
                if filters.languages:
                    votes, grams = filters.votes(data, at)
                    best = np.where(has, votes.argmax(1), best)
                    score = np.where(has, votes.max(1) / np.maximum(grams, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in out_names], pa.array(labels[best].tolist(), pa.string()),
                     pa.array(np.clip(score, 0.0, 1.0))], [*out_names, "lang_pred", "score"])

    out = map_arrow(given, run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip([id_col, *keep], out_names)], "lang_pred", "score")
