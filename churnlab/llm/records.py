"""Token-id files: length-delimited binary records with masked checksums and a separate offset index.

A record is, all little-endian::

    uint64 payload length | uint32 masked crc32 of these 8 bytes | payload | uint32 masked crc32 of the payload

and its payload is ``int64 document id, uint8 bytes per id, ids``. Ids take two
bytes where the vocabulary fits and four otherwise; the highest bit of that byte
says that the document has no id. A checksum is masked by
rotating it 15 bits to the right and adding a constant, so that a checksum of
data that holds checksums stays meaningful.

Documents are range-partitioned by id, each task writes one file in ascending
order, and the offset index is a Parquet table with one row per record. The
index alone serves shuffled reads: any subset in any order is a set of byte
ranges.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from churnlab.llm import files
from churnlab.llm.common import map_arrow, materialize, shared_folder, slices, texts
from churnlab.llm.tokens import TEXT_BYTES, encoder, tokenizer_path

_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<qB")
_CRC = struct.Struct("<I")
#: Flag in the byte of the id width: a document without an id.
_NO_ID = 0x80
#: Bytes of records that one reading task takes from one file.
CHUNK_BYTES = 32 << 20
INDEX = ("doc_id long, file string, ordinal long, offset long, length long, n_tokens long, tokens_before long")


class CorruptRecord(ValueError):
    pass


def mask(crc: int) -> int:
    """Rotate right by 15 bits and add the constant of the framing."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _CRC.pack(mask(zlib.crc32(size))), payload, _CRC.pack(mask(zlib.crc32(payload)))))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; raises ``CorruptRecord`` where a length or checksum doesn't fit."""
    if len(record) < _HEAD.size + _CRC.size:
        raise CorruptRecord("short record")
    size, size_crc = _HEAD.unpack_from(record)
    if mask(zlib.crc32(record[:8])) != size_crc or len(record) != _HEAD.size + size + _CRC.size:
        raise CorruptRecord("length doesn't fit its checksum or the index")
    payload = record[_HEAD.size: _HEAD.size + size]
    if mask(zlib.crc32(payload)) != _CRC.unpack_from(record, _HEAD.size + size)[0]:
        raise CorruptRecord("payload doesn't fit its checksum")
    return payload


def pack_ids(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    head = _ID.pack(0, width | _NO_ID) if doc_id is None else _ID.pack(doc_id, width)
    return head + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = _ID.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width & ~_NO_ID}", offset=_ID.size).astype("<u4")
    return None if width & _NO_ID else doc_id, ids


def write_token_files(docs: DataFrame, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text", any_ids: bool = False) -> tuple[str, DataFrame]:
    """Encode every whole text, append ``end_id`` and write the records; (folder, index table).

    The index has one row per record: doc_id, file, ordinal (place in the file),
    offset and length in bytes, n_tokens (end id included), tokens_before (ids
    of all earlier records of the same file). A null text gives a record with
    the end id alone; repeated ids keep a record each; with ``any_ids``, so do
    rows without an id, before all others and with a null in the index, and
    otherwise they raise; an empty table gives an empty index; other columns
    are ignored.
    """
    spark = docs.sparkSession
    folder, path = shared_folder(spark, "tokens"), tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        name, out, at, ordinal, before = "", None, 0, 0, 0
        try:
            for batch in batches:
                for part in slices(batch, "text", TEXT_BYTES):
                    ids, counts = enc.encode(texts(part.column("text")))
                    ends = np.cumsum(counts)
                    rows = []
                    if out is None:
                        name, out = files.new_file(folder, ".rec")
                    for doc, a, b in zip(part.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist()):
                        if doc is None and not any_ids:
                            raise ValueError("a record needs a document id")
                        record = frame(pack_ids(doc, np.append(ids[a:b], end_id), width))
                        out.write(record)
                        rows.append((doc, name, ordinal, at, len(record), b - a + 1, before))
                        at, ordinal, before = at + len(record), ordinal + 1, before + b - a + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(zip(*rows))],
                        [f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    # The row number lets equal and null ids spread over several ranges.
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
               .repartitionByRange("doc_id", "row").drop("row").sortWithinPartitions("doc_id"))
    return folder, materialize(map_arrow(ordered, run, INDEX, cache="tokens"))


def with_global_start(index: DataFrame) -> DataFrame:
    """Add ``start``: ids of all records before this one, files taken in the order of their documents (nulls first).

    The running total goes over one row per file, never over the records.
    """
    per_file = index.groupBy("file").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("first_doc", "last_doc", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = per_file.select("file", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("file_start"))
    return (index.join(before, "file").withColumn("start", F.col("file_start") + F.col("tokens_before"))
            .drop("file_start", "tokens_before"))


def read_token_files(folder: str, index: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Read the records of any part of an index by byte ranges and check them.

    doc_id and n_tokens come from the files; ids is the binary of the ids as
    little-endian uint32, and ids_crc32 its unsigned crc32. ``keep`` names index
    columns to hand through.
    """
    fields = [f for f in index.schema.fields if f.name in keep]
    schema = "doc_id long, n_tokens long, ids_crc32 long, ids binary" + "".join(
        f", {f.name} {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, offset, length = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            a = 0
            while a < len(names):
                b, size = a, 0
                while b < len(names) and names[b] == names[a] and size < files.READ_BYTES:
                    size, b = size + length[b], b + 1
                rows = [unpack_ids(unframe(r)) for r in files.read_ranges(folder, names[a], list(zip(offset[a:b], length[a:b])))]
                raw = [ids.tobytes() for _, ids in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in rows], pa.int64()), pa.array([len(i) for _, i in rows], pa.int64()),
                     pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(raw, pa.binary()),
                     *[batch.column(f.name).slice(a, b - a) for f in fields]],
                    ["doc_id", "n_tokens", "ids_crc32", "ids", *[f.name for f in fields]])
                a = b

    chunk = F.floor(F.col("offset") / CHUNK_BYTES).alias("chunk")
    picked = (index.select("file", "offset", "length", *keep, chunk).repartition("file", "chunk")
              .sortWithinPartitions("file", "offset").drop("chunk"))
    return map_arrow(picked, run, schema)
