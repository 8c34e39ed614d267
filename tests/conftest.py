from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from churnlab.session import LOCAL_CONF, ensure_checkpoint_dir

    builder = SparkSession.builder.master("local[*]").appName("churnlab-tests")
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    s = builder.config("spark.sql.shuffle.partitions", "8").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def ph(spark):
    from churnlab.sources.fixture import policyholders

    return policyholders(spark, SF_SMALL)
