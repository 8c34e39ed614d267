"""Every registered query against its DuckDB oracle on the smallest folder
(the driver does the same at sf0.01). Model queries (no oracle) are covered
in test_models.py."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from churnlab.plans.registry import ORACLE, QUERIES
from scripts.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
# The catalogue of churnlab.plans; the optional corpus queries have their own tests.
entry.queries()
_QS, _SQL = dict(QUERIES), dict(ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duck(SF)
    yield c
    c.close()


# Long trainings run in the correctness check at the larger folder; test_models.py covers their code.
LONG = ("l07", "l12", "l16", "l17", "l18", "l19", "l21", "l22", "l23_tenure_gbt", "l24_contacts_gbt", "l26", "l28", "l29", "ev13", "ev14", "ev15",
        "ev16", "ev17", "r06_model", "n10_model", "p03_profile_model", "io08")


def test_every_query_has_an_oracle():
    assert set(_SQL) == set(_QS)


@pytest.mark.parametrize("name", sorted(n for n in _SQL if not n.startswith(LONG)))
def test_query_matches_oracle(spark, con, name):
    sdf = _QS[name](spark, SF).toPandas()
    odf = con.execute(_SQL[name]).df()
    ok, msg = compare(name, sdf, odf)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [r.risk_tier for r in sorted(rows, key=lambda r: r.tier_order)] == ["critical", "high", "watch", "stable"]
    assert sum(r.customers for r in rows) == 150
