"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the word classes of a clause: *insult* and *threat*
emit weights, *target* raises what is aimed at somebody near by, *negation* and
*reported speech* lower what they govern. Their product is composed once into
one deterministic machine (next state and weight factor per state and class),
which runs over the clauses of a text. Clauses are scored, not words: the same
insult weighs less after "not" or "she said" than after "you are".

The seed words below fix the function of negation, reported speech, target and
threat. The insult lexicon is learned from labelled documents: a word, or the
stem of a longer one, enters it where it is used in significantly more
different contexts (word before, word after) of toxic documents than its use in
clean ones explains. Contexts, not occurrences, are counted on the toxic side,
so copies of one document add nothing. A part of the labelled rows is kept back
to turn the clause scores of a text, and their density in it, into a probability
(a ridge logistic regression on a bounded sample).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnlab.llm.common import map_arrow, materialize, slices, texts

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Seed words (English, French, German, Spanish).
SEEDS = {
    NEGATION: "not no never nor neither without hardly don't doesn't isn't aren't wasn't ne pas jamais aucun nicht kein keine nie nunca jamás",
    REPORT: "said says say told wrote writes quoted quote claimed claims reported reportedly according alleged dit disait écrit selon sagte schrieb laut dijo escribió según",
    TARGET: "you your you're yours u he she him her they them their these those people tu toi vous votre ils elles du dich dir ihr euch sie tú usted ustedes ellos ellas",
    THREAT: "kill murder hurt destroy burn shoot stab beat punish die tuer détruire töten schlagen sterben matar destruir morir",
}
THREAT_WEIGHT = 2.0
#: Words that a negation or a target governs, to its right.
NEGATION_REACH, TARGET_REACH = 3, 4
NEGATED, REPORTED, AIMED = 0.25, 0.5, 1.5
#: Likelihood ratio that a word must reach to enter the lexicon, least weight of an entry, size of the lexicon.
MIN_G2, MIN_WEIGHT, MAX_LEXICON = 20.0, 1.5, 20_000
STEM = 5
#: Labelled rows that are learned from at most (a sample by hash of the id; its ids and labels are broadcast, so no text
#: is shuffled at any size).
LEARN_ROWS = 60_000
#: Newton steps and ridge of the calibration.
NEWTON_STEPS, RIDGE = 25, 1e-2
PREDICT_AT = 0.3
#: Words that a learning task counts before it hands them on.
FLUSH = 400_000

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE = re.compile(r"[.!?;:|\n\r]+")


# ---- transducers -------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Transducer:
    """``step[state][symbol] = (next state, factor)``; state 0 is the start of a clause."""

    step: tuple[tuple[tuple[int, float], ...], ...]


def governor(trigger: int, reach: int, factor: float) -> Transducer:
    """Multiply insults and threats by ``factor`` for ``reach`` words after the trigger (0: to the end of the clause)."""
    states = []
    for left in range((reach or 1) + 1):
        row = []
        for symbol in range(6):
            after = (reach or 1) if symbol == trigger else left if not reach else max(0, left - 1)
            row.append((after, factor if left and symbol in (INSULT, THREAT) else 1.0))
        states.append(tuple(row))
    return Transducer(tuple(states))


def emitter(symbol: int, alone: float, again: float) -> Transducer:
    """Weight factor of a symbol at its first place in a clause and at later ones; 0 states for other symbols."""
    rows = [tuple((1 if s == symbol else state, (again if state else alone) if s == symbol else 1.0) for s in range(6))
            for state in (0, 1)]
    return Transducer(tuple(rows))


def compose(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """Product machine: (next state, factor) tables over the states that can be reached from the start."""
    start = (0,) * len(parts)
    number, todo, table = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in range(6):
            moves = [p.step[s][symbol] for p, s in zip(parts, state)]
            after = tuple(m[0] for m in moves)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], math.prod(m[1] for m in moves)))
        table.append(row)
    both = np.array(table)
    return both[:, :, 0].astype(int), both[:, :, 1]


GRAMMAR = [emitter(INSULT, 1.0, 0.7), emitter(THREAT, 0.5, 0.5), governor(TARGET, TARGET_REACH, AIMED),
           governor(NEGATION, NEGATION_REACH, NEGATED), governor(REPORT, 0, REPORTED)]


def machine() -> tuple[list[list[int]], list[list[float]]]:
    after, factor = compose(GRAMMAR)
    return after.tolist(), factor.tolist()


def seed_classes() -> dict[str, tuple[int, float]]:
    return {w: (kind, THREAT_WEIGHT) for kind, line in SEEDS.items() for w in line.split()}


def clause_scores(text: str, classes: dict[str, tuple[int, float]], triggers: frozenset, after,
                  factor) -> tuple[list[float], int]:
    """(scores of the clauses that hold an insult or a threat, words of the text)."""
    low = text.lower()
    every = _WORD.findall(low)
    words = set(every)
    if triggers.isdisjoint(words) and triggers.isdisjoint({w[:STEM] + "-" for w in words if len(w) > STEM}):
        return [], len(every)
    scores = []
    for clause in _CLAUSE.split(low):
        state, score, fired = 0, 0.0, False
        for word in _WORD.findall(clause):
            kind, weight = classes.get(word) or (classes.get(word[:STEM] + "-") if len(word) > STEM else None) or (OTHER, 0.0)
            if kind in (INSULT, THREAT):
                score += weight * factor[state][kind]
                fired = True
            state = after[state][kind]
        if fired:
            scores.append(score)
    return scores, len(every)


# ---- learning ----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    coefficients: tuple[float, ...]

    def classes(self) -> dict[str, tuple[int, float]]:
        return seed_classes() | {w: (INSULT, v) for w, v in self.insults.items()}


def _units(text: str) -> list[tuple[str, str]]:
    """(unit, context) of every word: the word and its stem, with the words around it."""
    words = ["", *_WORD.findall(text.lower()), ""]
    out = []
    for a, w, b in zip(words, words[1:], words[2:]):
        out.append((w, f"{a} {b}"))
        if len(w) > STEM:
            out.append((w[:STEM] + "-", f"{a} {w} {b}"))
    return out


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Insult weights from (text, toxic): log-odds of toxic contexts against uses in clean documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = set(), Counter()

        def flush() -> pa.RecordBatch:
            unit = [u for u, _ in toxic] + list(clean)
            context = [c for _, c in toxic] + [None] * len(clean)
            uses = [0] * len(toxic) + list(clean.values())
            toxic.clear(), clean.clear()
            return pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(context, pa.int64()), pa.array(uses, pa.int64())],
                                              ["unit", "context", "uses"])

        for batch in batches:
            for part in slices(batch, "text"):
                for text, label in zip(texts(part.column("text")), part.column("toxic").to_pylist()):
                    if label:
                        toxic.update((u, crc32(c.encode())) for u, c in _units(text))
                    else:
                        words = _WORD.findall(text.lower())
                        clean.update(words)
                        clean.update([w[:STEM] + "-" for w in words if len(w) > STEM])
                    if len(toxic) + len(clean) > FLUSH:
                        yield flush()
        yield flush()

    rows = map_arrow(labelled.select("text", "toxic"), run, "unit string, context long, uses long")
    per_context = rows.groupBy("unit", "context").agg(F.sum("uses").alias("uses"))
    units = materialize(per_context.groupBy("unit").agg(F.count("context").alias("t"), F.sum("uses").alias("c")))
    words = ~F.col("unit").endswith("-")
    total_t, total_c = units.where(words).agg(F.sum("t"), F.sum("c")).first()
    if not total_t or not total_c:
        return {}
    t, c, share = F.col("t"), F.col("c"), total_t / (total_t + total_c)
    n = t + c
    g2 = 2 * (t * F.log(t / (n * share)) + F.when(c > 0, c * F.log(c / (n * (1 - share)))).otherwise(0.0))
    weight = F.log((t + 0.5) / (total_t + 1.0)) - F.log((c + 0.5) / (total_c + 1.0))
    entries = (units.where("t >= 3").select("unit", g2.alias("g2"), weight.alias("weight"))
               .where((F.col("g2") >= MIN_G2) & (F.col("weight") >= MIN_WEIGHT))
               .orderBy(F.desc("g2"), "unit").limit(MAX_LEXICON).collect())
    seeds = seed_classes()
    return {r.unit: r.weight for r in entries if r.unit not in seeds}


def features(raw, words, log1p=np.log1p) -> list:
    """What the calibration sees, from the clause score and the number of words (arrays or columns)."""
    return [log1p(raw), log1p(100 * raw / (words + 20))]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and coefficients by Newton's method with a small ridge, so that separable data stay finite."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
    return tuple(beta.tolist())


def raw_scores(docs: DataFrame, insults: dict[str, float], keep: list[str]) -> DataFrame:
    """Clause score ``raw`` and number of ``words`` of every row after the columns ``keep``; reads column text."""
    model = Model(insults, ())
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", raw double, words long"
    names = [f"c{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (after, factor) = model.classes(), machine()
        triggers = frozenset(w for w, (kind, _) in classes.items() if kind in (INSULT, THREAT))
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [clause_scores(t, classes, triggers, after, factor) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.array([sum(r) for r, _ in rows], pa.float64()),
                     pa.array([n for _, n in rows], pa.int64())], [*names, "raw", "words"])

    given = docs.select(*[F.col(f.name).alias(n) for n, f in zip(names, fields)], "text")
    out = map_arrow(given, run, schema)
    return out.select(*[F.col(n).alias(f.name) for n, f in zip(names, fields)], "raw", "words")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit lexicon and calibration on at most ``LEARN_ROWS`` labelled documents.

    Two thirds of them (by hash of the id) teach the lexicon, one third the
    calibration. Rows without a label or id are ignored; a document with several
    labels counts as toxic if one of them says so. At most about ``LEARN_ROWS``
    ids, and of their rows as many different texts, are drawn by hash; equal rows
    of an id are drawn together and calibrate once. Without a toxic or a clean
    document the lexicon is empty and all scores are equal.
    """
    label = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(label_col).cast("int").alias("toxic")))
    share = min(1.0, LEARN_ROWS / max(1, label.count()))
    chosen = label.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # An id may have any number of rows: what is drawn is bounded by different rows, not by ids.
    joined = joined.withColumn("h", F.xxhash64("text"))
    share = min(1.0, LEARN_ROWS / max(1, joined.select("id", "h").distinct().count()))
    joined = joined.where(F.pmod(F.xxhash64("id", "h", F.lit("row")), F.lit(1 << 20)) < int(share * (1 << 20)))
    third = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(3)) == 0
    insults = learn_lexicon(joined.where(~third).drop("h"))
    rows = raw_scores(joined.where(third), insults, ["id", "h", "toxic"]).dropDuplicates(["id", "h"]).toPandas()
    if not len(rows):
        return Model(insults, (0.0, 0.0, 0.0))
    x = np.column_stack(features(rows.raw.to_numpy(), rows.words.to_numpy()))
    return Model(insults, fit_logistic(x, rows.toxic.to_numpy(float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score`` (probability of label 1) and ``predicted`` of every row.

    Null and empty texts, and texts without a matched clause, get the rate of
    such texts among the labelled ones; null ids and repeated rows are returned
    as given; an empty table gives no rows. Nothing is shuffled.
    """
    raw = raw_scores(docs.select(F.col(id_col), F.col(text_col).alias("text")), model.insults, [id_col])
    first, *rest = model.coefficients
    x = sum((F.lit(b) * f for b, f in zip(rest, features(F.col("raw"), F.col("words"), F.log1p))), F.lit(first))
    return (raw.select(id_col, F.round(1 / (1 + F.exp(-x)), 6).alias("score"))
            .withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int")))
