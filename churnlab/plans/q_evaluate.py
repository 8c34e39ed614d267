"""Catalogue: evaluation on (label, score) = (churn_flag, fixture probability) (survey EV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab.operators import evaluate as ev
from churnlab.plans.oracle_base import with_ctes
from churnlab.plans.registry import register
from churnlab.sources.fixture import policyholders

T = 0.20


def labelled(spark, d):
    return policyholders(spark, d).select("customer_id", F.col("churn_flag").alias("label"),
                                          F.col("churn_probability_true").alias("score"))


LS = "ls AS (SELECT customer_id, churn_flag AS label, churn_probability_true AS score FROM policyholders)"
CUM = """cum AS (
  SELECT score, pos, neg,
         CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
         (SELECT CAST(sum(label) AS BIGINT) FROM ls) AS P,
         (SELECT CAST(count(*) - sum(label) AS BIGINT) FROM ls) AS N
  FROM (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg
        FROM ls GROUP BY score)
)"""


def E(body: str, *extra: str) -> str:
    return with_ctes(body, LS, *extra)


def _counts_sql(t: float) -> str:
    return (f"SELECT count(*) FILTER (WHERE label = 1 AND score >= {t!r}e0) AS tp,"
            f" count(*) FILTER (WHERE label = 0 AND score >= {t!r}e0) AS fp,"
            f" count(*) FILTER (WHERE label = 0 AND NOT score >= {t!r}e0) AS tn,"
            f" count(*) FILTER (WHERE label = 1 AND NOT score >= {t!r}e0) AS fn FROM ls")


def _z(x: str) -> str:
    return f"coalesce({x}, 0.0e0)"


def _d(a: str, b: str) -> str:
    return _z(f"CAST({a} AS DOUBLE) / nullif({b}, 0)")


def _metrics_sql(tp="tp", fp="fp", tn="tn", fn="fn") -> dict[str, str]:
    p = _d(tp, f"({tp} + {fp})")
    r = _d(tp, f"({tp} + {fn})")
    return {
        "accuracy": _d(f"({tp} + {tn})", f"({tp} + {fp} + {tn} + {fn})"),
        "precision": p,
        "recall": r,
        "f1": _d(f"2 * {p} * {r}", f"({p} + {r})"),
        "f2": _d(f"5 * {p} * {r}", f"(4 * {p} + {r})"),
    }


@register("ev01_confusion_matrix", E(
    "SELECT * FROM (SELECT 0 AS actual, 0 AS predicted, tn AS count FROM c UNION ALL SELECT 0, 1, fp FROM c"
    " UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c)", f"c AS ({_counts_sql(T)})"))
def q_ev01(spark, d):
    return ev.confusion_matrix(labelled(spark, d), T)


@register("ev02_threshold_metrics", E(
    f"SELECT {T!r}e0 AS threshold, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _metrics_sql().items())
    + " FROM c", f"c AS ({_counts_sql(T)})"))
def q_ev02(spark, d):
    return ev.threshold_metrics(labelled(spark, d), T)


def _report_sql():
    p1, r1 = _d("tp", "(tp + fp)"), _d("tp", "(tp + fn)")
    p0, r0 = _d("tn", "(tn + fn)"), _d("tn", "(tn + fp)")
    return f"""SELECT class, round(coalesce(precision, 0.0e0), 6) AS precision, round(coalesce(recall, 0.0e0), 6) AS recall,
  round(coalesce(f1, 0.0e0), 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM w
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM w
  UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM w
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM w
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / nullif(n, 0), (r0 * s0 + r1 * s1) / nullif(n, 0),
                   (f0 * s0 + f1 * s1) / nullif(n, 0), n FROM w)""", f"""w AS (
  SELECT p0, r0, {_d('2 * p0 * r0', '(p0 + r0)')} AS f0, s0, p1, r1, {_d('2 * p1 * r1', '(p1 + r1)')} AS f1, s1,
         {_d('tp + tn', 'n')} AS acc, n
  FROM (SELECT *, {p0} AS p0, {r0} AS r0, {p1} AS p1, {r1} AS r1, tn + fp AS s0, tp + fn AS s1,
               tp + fp + tn + fn AS n FROM c))"""


_RB, _RW = _report_sql()


@register("ev04_classification_report", E(_RB, f"c AS ({_counts_sql(T)})", _RW))
def q_ev04(spark, d):
    return ev.classification_report(labelled(spark, d), T)


_AUC_SQL = ("SELECT round(sum(pos * ((N - fp) + neg / 2.0e0)) / (first(P) * first(N)), 6) AS roc_auc,"
            " round(sum((CAST(pos AS DOUBLE) / P) * (CAST(tp AS DOUBLE) / (tp + fp))), 6) AS pr_auc FROM cum")


@register("ev05_roc_pr_auc", E(_AUC_SQL, CUM))
def q_ev05(spark, d):
    return ev.auc_scores(labelled(spark, d))


_ROC_POINT = f"score AS threshold, round({_d('fp', 'N')}, 6) AS fpr, round({_d('tp', 'P')}, 6) AS tpr"
_ROC_START = "SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0e0 AS fpr, 0.0e0 AS tpr FROM (SELECT 1 FROM cum LIMIT 1)"


@register("ev07_roc_curve", E(
    f"{_ROC_START} UNION ALL SELECT {_ROC_POINT} FROM (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,"
    " row_number() OVER w AS place FROM cum WINDOW w AS (ORDER BY score DESC))"
    " WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg", CUM))
def q_ev07(spark, d):
    return ev.roc_curve(labelled(spark, d))


@register("ev07_roc_curve_all_points", E(f"{_ROC_START} UNION ALL SELECT {_ROC_POINT} FROM cum", CUM))
def q_ev07a(spark, d):
    return ev.roc_curve(labelled(spark, d), drop_intermediate=False)


_PR_RAW = ("SELECT score AS threshold, p AS precision, r AS recall, 5 * (p * r) / (4 * p + r + 1e-12) AS f2"
           f" FROM (SELECT score, CAST(tp AS DOUBLE) / (tp + fp) AS p, {_d('tp', 'P')} AS r FROM cum)")
_PR = ("SELECT score AS threshold, round(p, 6) AS precision, round(r, 6) AS recall,"
       " round(2 * (p * r) / (1 * p + r + 1e-12), 6) AS f1, round(5 * (p * r) / (4 * p + r + 1e-12), 6) AS f2"
       f" FROM (SELECT score, CAST(tp AS DOUBLE) / (tp + fp) AS p, {_d('tp', 'P')} AS r FROM cum)")


@register("ev08_pr_curve", E(_PR, CUM))
def q_ev08(spark, d):
    return ev.pr_curve(labelled(spark, d))


def _record_sql():
    m = _metrics_sql()
    cols = {"threshold": f"{T!r}e0", "accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"],
            "f1": m["f1"], "f2": m["f2"], "roc_auc": "roc_auc", "pr_auc": "pr_auc", "tn": "tn", "fp": "fp", "fn": "fn",
            "tp": "tp", "test_size": "tp + fp + tn + fn", "predicted_positive": "tp + fp",
            "actual_positive": "tp + fn"}
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value FROM c, a"
                              for k, v in cols.items())


@register("ev09_evaluation_record", E(_record_sql(), CUM, f"c AS ({_counts_sql(T)})", f"a AS ({_AUC_SQL})"))
def q_ev09(spark, d):
    return ev.evaluation_record(labelled(spark, d), T)


def _sweep_sql():
    rows = []
    for t in ev.SWEEP_THRESHOLDS:
        m = _metrics_sql()
        rows.append(f"SELECT CAST({float(t)!r} AS DOUBLE) AS threshold, tp, fp, tn, fn, "
                    + ", ".join(f"round({e}, 6) AS {k}" for k, e in m.items())
                    + f", {m['recall']} < 0.5e0 AS low_recall_warning FROM ({_counts_sql(t)})")
    return " UNION ALL ".join(rows)


@register("ev10_metrics_at_thresholds", E(_sweep_sql()))
def q_ev10(spark, d):
    return ev.metrics_at_thresholds(labelled(spark, d))


@register("ev11a_threshold_max_f2", E(
    "SELECT arg_max(threshold, (f2, -threshold)) AS threshold, round(max(f2), 6) AS score, first(n_ok > 0) AS constrained"
    " FROM (SELECT * FROM pr CROSS JOIN (SELECT count(*) FILTER (WHERE precision >= 0.3e0 AND recall >= 0.85e0)"
    " AS n_ok FROM pr)) WHERE n_ok = 0 OR (precision >= 0.3e0 AND recall >= 0.85e0)", CUM, f"pr AS ({_PR_RAW})"))
def q_ev11a(spark, d):
    return ev.choose_threshold_fbeta(labelled(spark, d), 2.0, min_precision=0.3, min_recall=0.85)


@register("ev11b_threshold_max_accuracy", E(
    "SELECT arg_max(threshold, (accuracy, -threshold)) AS threshold, round(max(accuracy), 6) AS accuracy FROM ("
    "SELECT DISTINCT * FROM (SELECT score AS threshold, (tp + N - fp) / CAST(P + N AS DOUBLE) AS accuracy FROM cum"
    " WHERE score >= 0 AND score <= 1 UNION ALL"
    " SELECT 0.0e0, (count(*) FILTER (WHERE label = 1 AND score >= 0) + count(*) FILTER (WHERE label = 0)"
    " - count(*) FILTER (WHERE label = 0 AND score >= 0)) / CAST(count(*) AS DOUBLE) FROM ls UNION ALL"
    " SELECT 1.0e0, (count(*) FILTER (WHERE label = 1 AND score >= 1) + count(*) FILTER (WHERE label = 0)"
    " - count(*) FILTER (WHERE label = 0 AND score >= 1)) / CAST(count(*) AS DOUBLE) FROM ls))", CUM))
def q_ev11b(spark, d):
    return ev.choose_threshold_accuracy(labelled(spark, d))


@register("ev11c_threshold_recall80", E(
    f"SELECT max(score) AS threshold FROM cum WHERE {_d('tp', 'P')} >= 0.8e0", CUM))
def q_ev11c(spark, d):
    return ev.choose_threshold_recall(labelled(spark, d), 0.80)


@register("ev18_fn_reduction", E(
    "SELECT 0.5e0 AS threshold_high, 0.4e0 AS threshold_low, count(*) FILTER (WHERE label = 1 AND score < 0.5e0)"
    " AS fn_high, count(*) FILTER (WHERE label = 1 AND score < 0.4e0) AS fn_low,"
    " count(*) FILTER (WHERE label = 1 AND score < 0.5e0) - count(*) FILTER (WHERE label = 1 AND score < 0.4e0)"
    " AS fn_reduction FROM ls"))
def q_ev18(spark, d):
    return ev.fn_reduction(labelled(spark, d), 0.5, 0.4)
