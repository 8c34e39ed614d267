"""Helpers shared by the corpus operators: tables, scratch tables, Arrow text buffers.

Tasks receive Arrow batches of whole texts. Each batch is cut into slices of a
few megabytes before numpy touches it, so a task's memory follows the slice
limit (or one document, if that is larger), not the batch or the partition.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from churnlab.session import ensure_checkpoint_dir, materialize  # noqa: F401 - re-exported for the operators
from churnlab.sources.tables import table_path

#: Bytes of text that a task turns into numpy arrays at once.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 2 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir`` (shared by all executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: What Python workers keep from task to task, by name: a function that empties it.
WORKER_CACHES: dict[str, Callable[[], None]] = {}


def map_arrow(df: DataFrame, fn: Callable, schema, cache: str = "") -> DataFrame:
    """``mapInArrow`` whose batches hold at most ``BATCH_BYTES`` (Spark's default is 64 MB, once in the JVM and once in
    Python for every task). A session that has another bound than the default keeps it.

    Workers live on from one operator to the next. A task empties all caches but the one that it names, so memory
    follows the operator at work.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches(cache)
        yield from fn(batches)

    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def release_caches(keep: str = "") -> None:
    """Empty the caches but one, and hand free memory of this process back to the machine: workers live on through all
    operators of a job, and an allocator keeps what the last one needed."""
    for name, empty in WORKER_CACHES.items():
        if name != keep:
            empty()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another libc
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty. ``bytes[offsets[i]:offsets[i+1]]`` is row i."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def texts(column: pa.Array) -> list[str]:
    """The rows as Python strings; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of the decimal document id leaves ``remainder``."""
    from pyspark.sql import functions as F

    return (F.crc32(doc_id.cast("string").cast("binary")) % modulus) == remainder


def row_keys(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = True) -> DataFrame:
    """All rows with a long ``key`` that tells rows of one id apart by their text.

    A row with an id gets the XXH64 of its text: rows that repeat an id and its
    text have one key. Rows without an id are numbered, each for itself, and
    written once, so that every plan over the result sees the same numbers; with
    ``null_ids`` off they get the XXH64 too.
    """
    from pyspark.sql import functions as F

    digest = F.xxhash64(F.col(text_col))
    if not null_ids:
        return docs.withColumn(key, digest)
    numbered = materialize(docs.where(F.col(id_col).isNull()).withColumn(key, F.monotonically_increasing_id()))
    return docs.where(F.col(id_col).isNotNull()).withColumn(key, digest).unionByName(numbered)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i]+lengths[i]-1`` of every row, concatenated."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(total)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder once no plan reads it any more."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
