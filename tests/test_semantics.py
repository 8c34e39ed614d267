"""Edge cases of the pandas/Spark semantic decisions on tiny frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.functions import scoring as sc
from churnlab.operators import rates, stats


def test_flag_null_is_zero(spark):
    df = spark.createDataFrame([(None,), (0.2,), (0.05,)], "p double")
    got = [r[0] for r in df.select(fx.flag(F.col("p") >= 0.12)).collect()]
    assert got == [0, 1, 0]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-0.3,), (0.4,)], "p double")
    got = [r[0] for r in df.select(fx.clip_lower(F.col("p"))).collect()]
    assert got == [None, 0.0, 0.4]


def test_premium_bins_right_closed(spark):
    vals = [-0.1, 0.0, 1e-9, 0.05, 0.10, 0.12, 0.1199, None]
    df = spark.createDataFrame([(v,) for v in vals], "premium_change_pct double")
    got = [r[0] for r in df.select(fx.premium_change_bin()).collect()]
    assert got == ["<=0%", "<=0%", "0-5%", "0-5%", "5-10%", "10%+", "10%+", None]


def test_payout_groups_edges(spark):
    vals = [0.0, 0.2, 0.2000001, 1.0, 1.1, None]
    df = spark.createDataFrame([(v,) for v in vals], "payout_ratio_12m double")
    got = [r[0] for r in df.select(fx.payout_group()).collect()]
    assert got == [fx.PAYOUT_GROUPS[0], fx.PAYOUT_GROUPS[0], fx.PAYOUT_GROUPS[1], fx.PAYOUT_GROUPS[4], None, None]


def test_empty_bins_kept(spark):
    df = spark.createDataFrame([(0.2, 1), (0.3, 0)], "premium_change_pct double, churn_flag int")
    out = {r["premium_change_bin"]: (r["customers"], r["churn_rate"])
           for r in rates.rate_by_premium_change_bin(df).collect()}
    assert out["10%+"] == (2, 0.5)
    assert out["<=0%"] == (0, None)
    assert len(out) == 4


def test_rate_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", 0)], "k string, churn_flag int")
    rows = rates.rate(df, ["k"]).collect()
    assert [(r.k, r.customers, r.churned) for r in rows] == [("a", 2, 1)]


def test_qcut_duplicate_edges_dropped(spark):
    # Many equal values -> duplicate quantile edges are dropped; buckets right-closed.
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate([0, 0, 0, 0, 0, 0, 1, 2, 3, 4])],
                               "x double, churn_flag int")
    out = rates.rate_by_quantile(df, "x").orderBy("bucket").collect()
    assert sum(r.customers for r in out) == 10
    assert out[0].lower == 0.0 and out[0].customers == 6


def test_tier_cutoffs_and_labels(spark):
    # At t = 0.2 the critical cutoff is max(0.6, 0.2 * 3.0) = 0.6000000000000001
    # in floating point (as in the reference), so 0.6 itself is "high".
    df = spark.createDataFrame([(0.61,), (0.6,), (0.4,), (0.25,), (0.2499,), (0.1,)], "p double")
    got = [r[0] for r in df.select(sc.risk_tier("p", 0.2)).collect()]
    assert got == ["critical", "high", "high", "watch", "stable", "stable"]
    assert sc.tier_cutoffs(0.3) == {"watch": 0.36, "high": 0.6, "critical": 0.8999999999999999}
    lab = spark.createDataFrame([("high",), ("odd",)], "t string").select(sc.tier_label_ko("t")).collect()
    assert [r[0] for r in lab] == ["고위험", "odd"]


def test_reason_rules_order_and_fallback(spark):
    cols = ["premium_change_pct", "num_price_increases_last_3y", "late_payment_count_12m", "missed_payment_flag",
            "complaint_flag", "quote_requested_flag", "coverage_downgrade_flag", "customer_tenure_months",
            "multi_policy_flag"]
    rows = [
        (0.2, 3, 3, 1, 1, 1, 1, 5, 0),      # all fire -> first three kept
        (0.0, 0, 0, 0, 0, 0, 0, 100, 1),    # none -> fallback
        (None, 2, 0, 1, 0, 0, 0, 100, 1),   # null pct fires nothing; elif branches
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c == 'premium_change_pct' else 'int'}"
                                               for c in cols))
    got = [r[0] for r in df.select(sc.reason_text(set(cols))).collect()]
    assert got[0] == ", ".join([sc.REASON_PRICE_JUMP, sc.REASON_LATE, sc.REASON_COMPLAINT])
    assert got[1] == sc.REASON_FALLBACK
    assert got[2] == ", ".join([sc.REASON_PRICE_COUNT, sc.REASON_MISSED])


def test_reason_absent_columns_use_defaults(spark):
    df = spark.createDataFrame([(1,)], "complaint_flag int")
    got = df.select(sc.reason_text({"complaint_flag"})).first()[0]
    assert got == sc.REASON_COMPLAINT


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "s string")
    assert df.agg(F.mode("s", True)).first()[0] == "a"


def test_correlation_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    y = x * 0.5 + rng.normal(size=200)
    z = rng.normal(size=200)
    rows = [(float(a), float(b) if i % 7 else None, float(c)) for i, (a, b, c) in enumerate(zip(x, y, z))]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = {(r.col_i, r.col_j): r.r for r in stats.correlation_long(df, ["x", "y", "z"]).collect()}
    mask = np.array([i % 7 != 0 for i in range(200)])
    exp = np.corrcoef(x[mask], y[mask])[0, 1]
    assert math.isclose(got[("x", "y")], round(exp, 6), abs_tol=1e-6)
    assert math.isclose(got[("x", "z")], round(np.corrcoef(x, z)[0, 1], 6), abs_tol=1e-6)


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "c double, x double")
    assert stats.correlation_long(df, ["c", "x"]).first().r is None
