"""Executed plans: one Python scan per correlation query, no sort of the data for percentiles and selections."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QS = entry.queries()


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a33_correlation_matrix", "a34_strong_pairs", "a35_strong_label_correlations",
                                  "a36_top2_label_correlations"])
def test_one_python_scan(spark, name):
    final = plan(QS[name](spark, SF)).split("== Initial Plan ==")[0]
    assert final.count("MapInPandas") == 1


def test_scatter_reads_two_features(spark):
    text = plan(QS["a36_top2_scatter_rows"](spark, SF)).split("== Initial Plan ==")[0]
    assert text.count("FileScan") == 1 and "MapInPandas" not in text


@pytest.mark.parametrize("name", ["c16_describe", "a10_box_premium_change_by_age_churn", "a37_iqr_outliers", "p01_base_profile"])
def test_percentiles_need_no_range_sort_or_checkpoint(spark, name):
    text = plan(QS[name](spark, SF))
    assert "rangepartitioning" not in text and "ExistingRDD" not in text


@pytest.mark.parametrize("name", ["d_all_checks", "a06_premium_summary", "n16_engineered_means_combined"])
def test_one_scan(spark, name):
    assert plan(QS[name](spark, SF)).split("== Initial Plan ==")[0].count("FileScan") == 1
