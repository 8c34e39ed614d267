"""Scratch storage: the cluster's folder first, a local one only with a local master, tables deleted on request."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from churnlab import session


def _fake(master, setting=None):
    context = SimpleNamespace(master=master, folder=None)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda p: setattr(context, "folder", p)
    return SimpleNamespace(conf={"spark.checkpoint.dir": setting} if setting else {}, sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(_fake(master))
    assert session.ensure_checkpoint_dir(_fake("yarn", "hdfs://x/y")) == "hdfs://x/y"


def test_a_local_master_gets_a_scratch_folder():
    path = session.ensure_checkpoint_dir(_fake("local[2]"))
    assert os.path.isdir(path)
    os.rmdir(path)


def test_tables_can_be_deleted(spark):
    kept, session._TABLES[:] = list(session._TABLES), []
    session.materialize(spark.range(3))
    path = session._TABLES[0]
    assert os.path.isdir(path.removeprefix("file:"))
    session.clear_tables(spark)
    assert not os.path.exists(path.removeprefix("file:")) and session._TABLES == []
    session._TABLES[:] = kept


def test_changed_input_makes_a_new_key(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t.parquet"))
    before = session.memo_key(spark, str(tmp_path), "x")
    assert session.memo_key(spark, str(tmp_path) + "/", "x") == before
    spark.range(2).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert session.memo_key(spark, str(tmp_path), "x") != before
