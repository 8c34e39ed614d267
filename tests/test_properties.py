"""Properties from SURVEY §5: exact percentiles, tier partition, priority permutation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from churnlab.functions.scoring import TIERS
from churnlab.operators import ranking, scoring


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, size=400)
    x = np.round(rng.normal(size=400), 3)
    y = np.where(rng.random(400) < 0.1, np.nan, np.round(rng.exponential(size=400), 3))
    rows = [(int(a), float(b), None if np.isnan(c) else float(c)) for a, b, c in zip(g, x, y)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    out = ranking.exact_percentiles(df, ["x", "y"], probs, ["g"]).collect()
    assert len(out) == 6
    for r in out:
        vals = (x if r.column == "x" else y)[g == r.g]
        vals = vals[~np.isnan(vals)]
        exp = np.percentile(vals, [p * 100 for p in probs])      # linear interpolation
        got = [r[f"q{i}"] for i in range(len(probs))]
        assert r.n == len(vals)
        assert np.allclose(got, exp, rtol=0, atol=1e-12)


def test_tiers_partition_the_table(ph):
    scored = scoring.score_table(ph, "churn_probability_true", 0.2)
    dist = {r.risk_tier: r.customers for r in scoring.tier_distribution(scored).collect()}
    assert set(dist) == set(TIERS)
    assert sum(dist.values()) == ph.count()


def test_coupon_priority_is_permutation(ph):
    scored = scoring.score_table(ph, "churn_probability_true", 0.2)
    got = scored.select("customer_id", "churn_probability", "coupon_priority").collect()
    assert sorted(r.coupon_priority for r in got) == list(range(1, len(got) + 1))
    order = sorted(got, key=lambda r: (-r.churn_probability, r.customer_id))
    assert [r.coupon_priority for r in order] == list(range(1, len(got) + 1))


def test_prefix_sums_exclusive(spark):
    df = spark.range(1, 51).withColumn("x", F.lit(2))
    out = ranking.prefix_sums(df, [F.col("id")], ["x"], inclusive=False, num_partitions=3).orderBy("id").collect()
    assert [r.cum_x for r in out] == [2 * i for i in range(50)]
