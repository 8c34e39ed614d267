"""Session construction and lineage helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults a local run needs; on a cluster the submitter's settings win because
# ``getOrCreate`` returns the existing session untouched.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "churnlab") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", os.environ.get("CHURNLAB_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Only a ``local`` master, whose
    tasks share the driver's disk, gets a fresh scratch folder under /tmp when
    the setting is absent; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    path = tempfile.mkdtemp(prefix="churnlab-ckpt-", dir="/tmp")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor
    loss). Used for internal cut points whose consumers read every column."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in a fresh folder under the shared
    checkpoint directory and return a scan of it.

    For derived tables that many queries read: like a reliable checkpoint it
    survives executor loss and cuts the lineage, and in addition later queries
    get column pruning (ReadSchema), pushed filters and file statistics for AQE.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "churnlab")
    df.write.parquet(path)
    return spark.read.parquet(path)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared checkpoint directory; ``clear_tables`` deletes it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


_TABLES: list[str] = []


_MEMOS: list[dict] = []


def memo() -> dict:
    """A dictionary for results that read scratch tables: emptied when these are deleted."""
    _MEMOS.append({})
    return _MEMOS[-1]


def clear_tables(spark: SparkSession) -> None:
    """Delete the scratch folders of this session (``materialize``, ``scratch_folder``) and forget the results that read
    them; the next query builds them anew. For the end of a job: frames that read the tables stop working."""
    jvm = spark._jvm
    for held in _MEMOS:
        held.clear()
    while _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_version(spark: SparkSession, folder: str) -> int:
    """Hash of names, sizes and times of the files below a folder of tables: new files make a new version."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    seen, todo = [], [root]
    while todo:
        for status in fs.listStatus(todo.pop()):
            seen.append((status.getPath().getName(), status.getLen(), status.getModificationTime()))
            if status.isDirectory():
                todo.append(status.getPath())
    return hash(tuple(sorted(seen)))


def memo_key(spark: SparkSession, folder: str, *parts) -> tuple:
    """Key for per-application memoized derived tables of a folder of input tables
    (the application id is unique per SparkContext, unlike ``id()`` of a recycled
    object). Changed input files make a new key."""
    return (spark.sparkContext.applicationId, folder.rstrip("/"), input_version(spark, folder), *parts)
