"""Classifier evaluation over (label, score) tables (survey EV1-EV12, EV18, EV19, W8).

Threshold-free metrics work on the per-distinct-score table: one partial
aggregate (positives/negatives per score), then running sums by the
range-partitioned ``prefix_sums`` helper (no single-partition window). At scale
the score can be rounded (``score_digits``) to bound the curve size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.operators.ranking import prefix_sums, previous_in_group

EPS = 1e-12
# Threshold sweep used by the metric-at-thresholds report.
SWEEP_THRESHOLDS = [round(0.1 + 0.05 * i, 2) for i in range(17)]


def _div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """One-row tp, fp, tn, fn (EV1 source)."""
    y, p = F.col(label), F.col(score) >= F.lit(float(threshold))
    return df.agg(F.count_if((y == 1) & p).alias("tp"), F.count_if((y == 0) & p).alias("fp"),
                  F.count_if((y == 0) & ~p).alias("tn"), F.count_if((y == 1) & ~p).alias("fn"))


def confusion_matrix(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """EV1: all four cells, long form (actual, predicted, count)."""
    c = confusion_counts(df, threshold, label, score)
    return c.selectExpr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, count)")


def _metric_cols(tp, fp, tn, fn, beta: float = 2.0):
    precision = _div(tp, tp + fp)
    recall = _div(tp, tp + fn)
    b2 = beta * beta
    return {
        "accuracy": _div(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": _div(2 * precision * recall, precision + recall),
        f"f{int(beta)}": _div((1 + b2) * precision * recall, b2 * precision + recall),
    }


def threshold_metrics(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """EV2, EV3, EV12: accuracy, precision, recall, F1, F2 (zero division -> 0)."""
    c = confusion_counts(df, threshold, label, score)
    m = _metric_cols(*(F.col(k) for k in ("tp", "fp", "tn", "fn")))
    return c.select(F.lit(float(threshold)).alias("threshold"), *[F.round(v, 6).alias(k) for k, v in m.items()])


def classification_report(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """EV4: per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    c = confusion_counts(df, threshold, label, score)
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1_1, f1_0 = _div(2 * p1 * r1, p1 + r1), _div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    acc = _div(tp + tn, n)
    w = c.select(p0.alias("p0"), r0.alias("r0"), f1_0.alias("f0"), s0.alias("s0"), p1.alias("p1"), r1.alias("r1"),
                 f1_1.alias("f1"), s1.alias("s1"), acc.alias("acc"), n.alias("n"))
    rows = w.selectExpr(
        "stack(5,"
        " '0', p0, r0, f0, s0,"
        " '1', p1, r1, f1, s1,"
        " 'accuracy', acc, acc, acc, n,"
        " 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n,"
        " 'weighted avg', try_divide(p0 * s0 + p1 * s1, n), try_divide(r0 * s0 + r1 * s1, n),"
        " try_divide(f0 * s0 + f1 * s1, n), n)"
        " as (class, precision, recall, f1, support)")
    return rows.select("class", *[F.round(F.coalesce(F.col(k), F.lit(0.0)), 6).alias(k)
                                  for k in ("precision", "recall", "f1")], F.col("support").cast("long"))


def score_counts(df: DataFrame, label: str = "label", score: str = "score", score_digits: int | None = None) -> DataFrame:
    """W8 source: positives and negatives per distinct score (partial aggregation)."""
    s = F.round(F.col(score), score_digits) if score_digits is not None else F.col(score)
    return df.select(s.alias("score"), F.col(label).cast("long").alias("y")).groupBy("score").agg(
        F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg"))


def cumulative_counts(df: DataFrame, label: str = "label", score: str = "score",
                      score_digits: int | None = None) -> DataFrame:
    """Per distinct score s, tp(s) and fp(s) for the rule ``score >= s``
    (running sums in descending score order) plus the class totals."""
    sc = score_counts(df, label, score, score_digits)
    totals = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = prefix_sums(sc, [F.col("score").desc()], ["pos", "neg"], prefix="cum_")
    return (cum.crossJoin(F.broadcast(totals))
               .select("score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "P", "N"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", score_digits: int | None = None,
              drop_intermediate: bool = True) -> DataFrame:
    """EV7: (threshold, fpr, tpr) at the distinct scores, led by (infinity, 0, 0).

    ``drop_intermediate`` leaves out the points on a straight line between their neighbours: a point stays if it is the
    first or the last one, or if the next lower score holds another number of positives or negatives than its own.
    """
    c = cumulative_counts(df, label, score, score_digits)
    if drop_intermediate:
        # The next lower score is the previous one in rising order: a lag that crosses range partitions.
        both = previous_in_group(c.withColumn("all", F.lit(1)), "all", ["score"], ["pos", "neg"], prefix="next_")
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bends = F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        c = both.where(first | bends)
    curve = c.select(F.col("score").alias("threshold"), F.round(_div(F.col("fp"), F.col("N")), 6).alias("fpr"),
                     F.round(_div(F.col("tp"), F.col("P")), 6).alias("tpr"))
    zero = F.lit(0.0)
    start = c.limit(1).select(F.lit(float("inf")).alias("threshold"), zero.alias("fpr"), zero.alias("tpr"))
    return start.unionByName(curve)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", score_digits: int | None = None) -> DataFrame:
    """EV8: precision, recall, F1, F2 *at* each threshold (B1 corrected); F-beta
    with the reference's 1e-12 guard in the denominator."""
    c = cumulative_counts(df, label, score, score_digits)
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    r = _div(F.col("tp"), F.col("P"))

    def fb(beta):
        b2 = beta * beta
        return (1 + b2) * (p * r) / (b2 * p + r + F.lit(EPS))
    return c.select(F.col("score").alias("threshold"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                    F.round(fb(1.0), 6).alias("f1"), F.round(fb(2.0), 6).alias("f2"))


def auc_scores(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """EV5 + EV6 in one pass over the cumulative table.

    ROC-AUC (ties count one half) = sum_s pos_s * (neg below s + neg_s / 2) / (P N);
    average precision = sum_s (pos_s / P) * tp(s) / (tp(s) + fp(s)).
    """
    c = cumulative_counts(df, label, score)
    below = F.col("N") - F.col("fp")
    auc_term = F.col("pos") * (below + F.col("neg") / 2.0)
    ap_term = (F.col("pos") / F.col("P")) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.agg(F.round(F.try_divide(F.sum(auc_term), F.first("P") * F.first("N")), 6).alias("roc_auc"),
                 F.round(F.sum(ap_term), 6).alias("pr_auc"))


def evaluation_record(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """EV9: long (metric, value) table: threshold, seven metrics, confusion cells,
    sizes and positives."""
    c = confusion_counts(df, threshold, label, score)
    m = _metric_cols(*(F.col(k) for k in ("tp", "fp", "tn", "fn")))
    wide = c.crossJoin(auc_scores(df, label, score)).select(
        F.lit(float(threshold)).alias("threshold"), m["accuracy"].alias("accuracy"), m["precision"].alias("precision"),
        m["recall"].alias("recall"), m["f1"].alias("f1"), m["f2"].alias("f2"), "roc_auc", "pr_auc",
        "tn", "fp", "fn", "tp", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("test_size"),
        (F.col("tp") + F.col("fp")).alias("predicted_positive"), (F.col("tp") + F.col("fn")).alias("actual_positive"))
    names = wide.columns
    rows = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {rows}) as (metric, value)").select(
        "metric", F.round("value", 6).alias("value"))


def metrics_at_thresholds(df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, label: str = "label",
                          score: str = "score", low_recall: float = 0.5) -> DataFrame:
    """EV10 + EV19: one aggregate with conditional counts per threshold (no
    cross join of the data), unpivoted; plus the low-recall warning flag."""
    y, s = F.col(label), F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        p = s >= F.lit(float(t))
        aggs += [F.count_if((y == 1) & p).alias(f"tp{i}"), F.count_if((y == 0) & p).alias(f"fp{i}"),
                 F.count_if((y == 0) & ~p).alias(f"tn{i}"), F.count_if((y == 1) & ~p).alias(f"fn{i}")]
    wide = df.agg(*aggs)
    rows = ", ".join(f"cast({float(t)!r} as double), tp{i}, fp{i}, tn{i}, fn{i}" for i, t in enumerate(thresholds))
    long = wide.selectExpr(f"stack({len(thresholds)}, {rows}) as (threshold, tp, fp, tn, fn)")
    m = _metric_cols(*(F.col(k) for k in ("tp", "fp", "tn", "fn")))
    return long.select("threshold", "tp", "fp", "tn", "fn", *[F.round(v, 6).alias(k) for k, v in m.items()],
                       (m["recall"] < low_recall).alias("low_recall_warning"))


def fn_reduction(df: DataFrame, high: float, low: float, label: str = "label", score: str = "score") -> DataFrame:
    """EV18: false negatives at two thresholds and the reduction."""
    y, s = F.col(label), F.col(score)
    return df.agg(F.count_if((y == 1) & (s < high)).alias("fn_high"),
                  F.count_if((y == 1) & (s < low)).alias("fn_low")).select(
        F.lit(float(high)).alias("threshold_high"), F.lit(float(low)).alias("threshold_low"),
        "fn_high", "fn_low", (F.col("fn_high") - F.col("fn_low")).alias("fn_reduction"))


def choose_threshold_fbeta(df: DataFrame, beta: float = 2.0, min_precision: float = 0.0, min_recall: float = 0.0,
                           label: str = "label", score: str = "score") -> DataFrame:
    """EV11(a): max F-beta among thresholds meeting both minimums; if none
    qualifies, max F-beta overall. Ties -> lowest threshold (argmax order).
    Any beta; the choice is made on unrounded values."""
    c = cumulative_counts(df, label, score)
    p, r, b2 = F.col("precision"), F.col("recall"), float(beta) ** 2
    pr = c.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                  _div(F.col("tp"), F.col("P")).alias("recall"))
    flagged = pr.withColumn("f", (1 + b2) * (p * r) / (b2 * p + r + F.lit(EPS))).withColumn(
        "ok", (p >= min_precision) & (r >= min_recall))
    n_ok = flagged.agg(F.count_if("ok").alias("_n"))
    pick = flagged.crossJoin(F.broadcast(n_ok)).where((F.col("_n") == 0) | F.col("ok"))
    key = F.struct(F.col("f"), (-F.col("threshold")).alias("neg_t"))
    return pick.agg(F.max_by("threshold", key).alias("threshold"), F.round(F.max("f"), 6).alias("score"),
                    F.first(F.col("_n") > 0).alias("constrained"))


def choose_threshold_accuracy(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """EV11(b): highest accuracy over {0} U distinct scores U {1} (clipped to
    [0, 1]); the first (lowest) threshold wins ties."""
    c = cumulative_counts(df, label, score)
    tot = c.agg(F.first("P").alias("P"), F.first("N").alias("N"))
    at_scores = c.where((F.col("score") >= 0) & (F.col("score") <= 1)).select(
        F.col("score").alias("threshold"), ((F.col("tp") + F.col("N") - F.col("fp")) / (F.col("P") + F.col("N")))
        .alias("accuracy"))
    # Thresholds 0 and 1: every score >= 0 is positive; at 1 only scores >= 1.
    n_ge1 = df.agg(F.count_if((F.col(label) == 1) & (F.col(score) >= 1)).alias("tp1"),
                   F.count_if((F.col(label) == 0) & (F.col(score) >= 1)).alias("fp1"),
                   F.count_if((F.col(label) == 1) & (F.col(score) >= 0)).alias("tp0"),
                   F.count_if((F.col(label) == 0) & (F.col(score) >= 0)).alias("fp0"))
    ends = n_ge1.crossJoin(tot).selectExpr(
        "stack(2, 0.0D, (tp0 + N - fp0) / (P + N), 1.0D, (tp1 + N - fp1) / (P + N)) as (threshold, accuracy)")
    cands = at_scores.unionByName(ends).distinct()
    key = F.struct(F.col("accuracy"), (-F.col("threshold")).alias("neg_t"))
    return cands.agg(F.max_by("threshold", key).alias("threshold"), F.round(F.max("accuracy"), 6).alias("accuracy"))


def choose_threshold_recall(df: DataFrame, min_recall: float = 0.80, label: str = "label",
                            score: str = "score") -> DataFrame:
    """EV11(c): the highest threshold whose recall reaches ``min_recall``."""
    c = cumulative_counts(df, label, score)
    return c.where(_div(F.col("tp"), F.col("P")) >= min_recall).agg(F.max("score").alias("threshold"))
