"""Catalogue: sources, cleaning, features, data quality (survey IO/C/F/D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators import clean, quality, stats
from churnlab.plans.oracle_base import with_ctes
from churnlab.plans.registry import register
from churnlab.plans.sql_fragments import (AGE_BAND_SQL, ANALYSIS_SQL, F1_SELECT, FEATURES_CTE, HYP_SQL, flag, q)
from churnlab.sources.fixture import POLICYHOLDER_COLUMNS, age_band_expr, policyholders
from churnlab.sources.io import POLICYHOLDER_SCHEMA
from churnlab.sources import io
from churnlab.sources.lookups import column_dictionary

PH = policyholders


def _excl(cols):
    return ", ".join(cols)


@register("c01_drop_unused", with_ctes(f"SELECT * EXCLUDE ({_excl(clean.UNUSED_COLUMNS)}) FROM policyholders"))
def q_c01(spark, d):
    return clean.drop_unused(PH(spark, d))


@register("c02_drop_redundant", with_ctes(
    f"SELECT * EXCLUDE ({_excl(clean.REDUNDANT_COLUMNS)}) FROM policyholders"))
def q_c02(spark, d):
    return clean.drop_redundant(PH(spark, d))


_ENC_SQL = with_ctes(
    "SELECT * EXCLUDE ({drop}) REPLACE ({enc}) FROM policyholders".format(
        drop=_excl(clean.UNUSED_COLUMNS + clean.REDUNDANT_COLUMNS),
        enc=", ".join(
            f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'nan')) - 1 AS INTEGER) AS {c}"
            for c in ["marital_status", "policy_type"])))


@register("c03_label_encode_level1", _ENC_SQL)
def q_c03(spark, d):
    """IO2 level 1 = C1 + C2 + C3 (age_band is dropped by C2 before encoding)."""
    return clean.load_level(PH(spark, d), 1)


@register("c03_encoding_map", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code, label"
    f" FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS label FROM policyholders)"
    for c in clean.CATEGORICAL_COLUMNS)))
def q_c03_map(spark, d):
    return clean.encoding_table(PH(spark, d))


@register("c04_feature_frame", with_ctes(
    f"SELECT * EXCLUDE ({_excl(clean.LEAKAGE_COLUMNS + ['churn_flag'])}), {F1_SELECT} FROM policyholders"))
def q_c04(spark, d):
    return fx.add_engineered_features(clean.feature_frame(PH(spark, d)))


@register("c06_clip_policies", with_ctes(
    "SELECT customer_id, CAST(least(num_policies, 10) AS INTEGER) AS num_policies FROM policyholders"))
def q_c06(spark, d):
    return clean.clip_policies(PH(spark, d)).select("customer_id", "num_policies")


@register("c07_cap_rate", with_ctes(
    "SELECT customer_id, CASE WHEN premium_change_pct IS NOT NULL THEN least(premium_change_pct, 0.119e0) END"
    " AS premium_change_pct FROM policyholders"))
def q_c07(spark, d):
    return clean.cap_rate(PH(spark, d)).select("customer_id", "premium_change_pct")


DOUBLE_COLS = [f.name for f in POLICYHOLDER_SCHEMA.fields if f.dataType.simpleString() == "double"]
NUMERIC_COLS = [f.name for f in POLICYHOLDER_SCHEMA.fields if f.dataType.simpleString() in ("double", "int")]


@register("c08_inf_to_zero", with_ctes("SELECT customer_id, " + ", ".join(
    f"coalesce(CASE WHEN NOT isnan({c}) AND abs({c}) <> 'inf'::DOUBLE THEN {c} END, 0.0e0) AS {c}" for c in DOUBLE_COLS)
    + " FROM policyholders"))
def q_c08(spark, d):
    return clean.inf_to_zero(PH(spark, d), DOUBLE_COLS).select("customer_id", *DOUBLE_COLS)


@register("c09_claimants", with_ctes("SELECT * FROM policyholders WHERE num_claims_12m > 0"))
def q_c09(spark, d):
    return clean.claimants(PH(spark, d))


@register("c10_multi_policy_only", with_ctes("SELECT * FROM policyholders WHERE multi_policy_flag = 1"))
def q_c10(spark, d):
    return clean.multi_policy_only(PH(spark, d))


@register("c11_parse_date", with_ctes(
    "SELECT customer_id, CAST(CAST(try_strptime(as_of_date, '%Y-%m-%d') AS DATE) AS VARCHAR) AS as_of_parsed,"
    " CAST(year(CAST(try_strptime(as_of_date, '%Y-%m-%d') AS DATE)) AS INTEGER) AS as_of_year FROM policyholders"))
def q_c11(spark, d):
    p = clean.parse_date(PH(spark, d), "as_of_date", "parsed")
    return p.select("customer_id", F.col("parsed").cast("string").alias("as_of_parsed"),
                    F.year("parsed").cast("int").alias("as_of_year"))


def _dict_sql() -> str:
    from churnlab.sources.lookups import COLUMN_DESCRIPTIONS, DESCRIPTION_KO
    rows = ", ".join(f"({q(c)}, {q(desc)}, {q(DESCRIPTION_KO.get(desc, desc))})"
                     for c, desc in COLUMN_DESCRIPTIONS)
    return rows


@register("c12_column_dictionary_translated", with_ctes(
    "SELECT i.\"column\", i.non_null, d.description, d.description_ko FROM ("
    + " UNION ALL ".join(f"SELECT {q(c)} AS \"column\", count({c}) AS non_null FROM policyholders"
                         for c in POLICYHOLDER_COLUMNS)
    + f") i LEFT JOIN (VALUES {_dict_sql()}) d(\"column\", description, description_ko) ON i.\"column\" = d.\"column\""))
def q_c12(spark, d):
    info = stats.info(PH(spark, d)).select("column", "non_null")
    return info.join(F.broadcast(column_dictionary(spark)), "column", "left").select(
        "column", "non_null", "description", "description_ko")


@register("c13_preview", with_ctes(
    f"SELECT {', '.join(clean.PREVIEW_COLUMNS)} FROM policyholders ORDER BY customer_id LIMIT 20"))
def q_c13(spark, d):
    return clean.preview(PH(spark, d))


@register("c14_distinct_regions", with_ctes(
    "SELECT DISTINCT region_name FROM policyholders WHERE region_name IS NOT NULL ORDER BY region_name"))
def q_c14(spark, d):
    return clean.distinct_values(PH(spark, d), "region_name")


@register("c14_distinct_policies", with_ctes(
    "SELECT DISTINCT policy_type FROM policyholders WHERE policy_type IS NOT NULL ORDER BY policy_type"))
def q_c14p(spark, d):
    return clean.distinct_values(PH(spark, d), "policy_type")


@register("c05_column_kinds", with_ctes(" UNION ALL ".join(
    f"SELECT {q(f.name)} AS \"column\", CASE WHEN data_type IN ('INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'string' END AS kind"
    f" FROM (SELECT typeof({f.name}) AS data_type FROM policyholders LIMIT 1)" for f in POLICYHOLDER_SCHEMA.fields)))
def q_c05(spark, d):
    """Every column of the table by kind, from its schema."""
    p = PH(spark, d)
    rows = [(c, "numeric") for c in stats.numeric_columns(p)] + [(c, "string") for c in stats.string_columns(p)]
    return spark.createDataFrame(rows, "column string, kind string")


@register("c15_distinct_count", with_ctes(
    "SELECT count(DISTINCT customer_id) AS distinct_count FROM policyholders"))
def q_c15(spark, d):
    return clean.distinct_count(PH(spark, d), "customer_id")


def _describe_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {q(c)} AS \"column\", count({c}) AS count, round(avg({x}), 6) AS mean,"
            f" round(stddev_samp({x}), 6) AS std, round(min({x}), 9) AS min,"
            f" round(quantile_cont({x}, 0.25), 9) AS p25, round(quantile_cont({x}, 0.5), 9) AS p50,"
            f" round(quantile_cont({x}, 0.75), 9) AS p75, round(max({x}), 9) AS max FROM policyholders")
    return " UNION ALL ".join(parts)


@register("c16_describe", with_ctes(_describe_sql(NUMERIC_COLS)))
def q_c16(spark, d):
    """All numeric columns, found by type."""
    return stats.describe(PH(spark, d))


def _info_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {q(f.name)} AS \"column\", {i} AS position, {q(f.dataType.simpleString())} AS dtype,"
        f" count({f.name}) AS non_null FROM policyholders" for i, f in enumerate(POLICYHOLDER_SCHEMA.fields))


@register("c18_info", with_ctes(_info_sql()))
def q_c18(spark, d):
    """Schema (Spark type names) + non-null counts per column."""
    return stats.info(PH(spark, d))


# ------------------------------------------------------------------ features
@register("f01_engineered_features", with_ctes(f"SELECT customer_id, {F1_SELECT} FROM policyholders"))
def q_f01(spark, d):
    return fx.add_engineered_features(PH(spark, d)).select("customer_id", *fx.ENGINEERED_FEATURES)


@register("f02_hypothesis_scores", with_ctes(
    "SELECT customer_id, " + ", ".join(f"{e} AS {n}" for n, e in HYP_SQL.items()) + " FROM policyholders"))
def q_f02(spark, d):
    return fx.add_hypothesis_scores(PH(spark, d)).select("customer_id", *fx.HYPOTHESES)


@register("f06_analysis_features", with_ctes(
    "SELECT customer_id, " + ", ".join(f"{e} AS {n}" for n, e in ANALYSIS_SQL.items()) + " FROM policyholders"))
def q_f06(spark, d):
    return PH(spark, d).select("customer_id", *[e.alias(n) for n, e in fx.analysis_feature_exprs().items()])


@register("f24_age_band", with_ctes(
    f"SELECT customer_id, age, {AGE_BAND_SQL} AS age_band_derived FROM policyholders"))
def q_f24(spark, d):
    return PH(spark, d).select("customer_id", "age", age_band_expr(F.col("age")).alias("age_band_derived"))


@register("f25_risk_level", with_ctes(
    "SELECT customer_id, CASE WHEN churn_probability_true <= -1 OR churn_probability_true > 1 THEN NULL"
    f" WHEN churn_probability_true <= 0.4e0 THEN {q(fx.RISK_LEVELS_3[0])}"
    f" WHEN churn_probability_true <= 0.7e0 THEN {q(fx.RISK_LEVELS_3[1])}"
    f" WHEN churn_probability_true <= 1.0e0 THEN {q(fx.RISK_LEVELS_3[2])} END AS risk_level FROM policyholders"))
def q_f25(spark, d):
    return PH(spark, d).select("customer_id", fx.risk_level_3().alias("risk_level"))


@register("f26_probability_level", with_ctes(
    f"SELECT customer_id, CASE WHEN churn_probability_true * 100 < 30 THEN {q(fx.PROB_LEVELS_3[0])}"
    f" WHEN churn_probability_true * 100 < 70 THEN {q(fx.PROB_LEVELS_3[1])} ELSE {q(fx.PROB_LEVELS_3[2])} END"
    " AS probability_level FROM policyholders"))
def q_f26(spark, d):
    return PH(spark, d).select("customer_id", fx.probability_level_3("churn_probability_true").alias("probability_level"))


# ------------------------------------------------------------------ data quality
def _check_sql(name, applicable, ok):
    return (f"SELECT {q(name)} AS \"check\", count(*) FILTER (WHERE {applicable}) AS total,"
            f" count(*) FILTER (WHERE ({applicable}) AND coalesce({ok}, false)) AS matching,"
            f" count(*) FILTER (WHERE {applicable}) - count(*) FILTER (WHERE ({applicable}) AND coalesce({ok}, false))"
            " AS failing FROM policyholders")


_D1 = _check_sql("premium_change_pct",
                 "current_premium IS NOT NULL AND premium_last_year IS NOT NULL AND premium_change_pct IS NOT NULL"
                 " AND premium_last_year <> 0",
                 "abs(premium_change_pct - (current_premium - premium_last_year) / premium_last_year) < 1e-4")
_D2 = _check_sql("missed_payment_flag", "true",
                 "missed_payment_flag = CAST(late_payment_count_12m >= 4 AS INTEGER)")
_D3 = _check_sql("premium_to_coverage_ratio",
                 "current_premium IS NOT NULL AND coverage_amount IS NOT NULL"
                 " AND premium_to_coverage_ratio IS NOT NULL AND coverage_amount <> 0",
                 "abs(premium_to_coverage_ratio - current_premium / coverage_amount) < 0.01e0")
_D4 = _check_sql("claim_split", "true",
                 "num_claims_12m = num_approved_claims_12m + num_rejected_claims_12m + num_pending_claims_12m")


@register("d01_check_change_pct", with_ctes(_D1))
def q_d01(spark, d):
    return quality.check_change_pct(PH(spark, d))


@register("d02_check_missed_flag", with_ctes(_D2))
def q_d02(spark, d):
    return quality.check_missed_flag(PH(spark, d))


@register("d03_check_coverage_ratio", with_ctes(_D3))
def q_d03(spark, d):
    return quality.check_coverage_ratio(PH(spark, d))


@register("d04_check_claim_split", with_ctes(_D4))
def q_d04(spark, d):
    return quality.check_claim_split(PH(spark, d))


@register("d_all_checks", with_ctes(" UNION ALL ".join([_D1, _D2, _D3, _D4])))
def q_dall(spark, d):
    return quality.all_checks(PH(spark, d))


@register("io07_encoding_map_roundtrip", with_ctes(
    "SELECT customer_id, age_band, marital_status, policy_type FROM policyholders"))
def q_io07(spark, d):
    """IO7/J3: encode (C3), save the code map as JSON lines, load it back and
    decode the codes to labels by a join with the map."""
    p = PH(spark, d)
    cols = clean.CATEGORICAL_COLUMNS
    codes = clean.encoding_table(p, cols)
    path = io.scratch_path(spark, "encoding-map")
    io.save_encoding_map(codes, path)
    back = io.load_encoding_map(spark, path)
    enc = clean.label_encode(p.select("customer_id", *cols), cols)
    for c in cols:
        enc = io.decode(enc, back, c)
    return enc.select("customer_id", *cols)


def _csv_copy(spark, d) -> str:
    path = io.scratch_path(spark, "policyholders-csv")
    io.write_policyholders_csv(PH(spark, d), path)
    return path


@register("io01_csv_roundtrip", with_ctes("SELECT * FROM policyholders"))
def q_io01(spark, d):
    """IO1: the table written as CSV with a header and read with the fixed schema."""
    return io.read_policyholders_csv(spark, _csv_copy(spark, d))


@register("io02_load_default", with_ctes(f"SELECT * EXCLUDE ({_excl(clean.UNUSED_COLUMNS)}) FROM policyholders"))
def q_io02(spark, d):
    """IO2 without a level: unused columns dropped."""
    return io.load_policyholders(spark, _csv_copy(spark, d))


@register("io02_load_raw", with_ctes("SELECT * FROM policyholders"))
def q_io02r(spark, d):
    """IO2 with another level than 1: the raw table."""
    return io.load_policyholders(spark, _csv_copy(spark, d), level=0)


@register("io03_dictionary_coverage", with_ctes(
    "SELECT d.\"column\", d.description, count(i.n) AS rows_with_value FROM (VALUES " + _dict_sql()
    + ") d(\"column\", description, description_ko) LEFT JOIN (UNPIVOT (SELECT "
    + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in POLICYHOLDER_COLUMNS)
    + " FROM policyholders) ON COLUMNS(*) INTO NAME \"column\" VALUE n) i ON i.\"column\" = d.\"column\" GROUP BY ALL"))
def q_io03(spark, d):
    """IO3: the dictionary as CSV, read back, next to the values that the table has of each column."""
    path = io.scratch_path(spark, "dictionary")
    column_dictionary(spark).select("column", "description").write.option("header", True).csv(path)
    info = stats.info(PH(spark, d)).select("column", F.col("non_null").alias("rows_with_value"))
    return io.read_column_dictionary(spark, path).join(info, "column", "left").select(
        "column", "description", F.coalesce("rows_with_value", F.lit(0)).cast("long").alias("rows_with_value"))


_LEAKS = sorted({*clean.LEAKAGE_COLUMNS, clean.LABEL})


@register("d05_leakage_columns", with_ctes(" UNION ALL ".join(
    f"SELECT {q(c)} AS \"column\", count(COLUMNS('^{c}$')) < 0 AS among_features FROM policyholders" for c in _LEAKS)))
def q_d05(spark, d):
    """No identifier, label or leakage column is left in the feature frame of the models."""
    p = PH(spark, d)
    return quality.leakage_check(p, fx.add_engineered_features(clean.feature_frame(p)))
