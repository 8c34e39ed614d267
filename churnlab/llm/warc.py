"""WARC archives: index first, then coalesced byte-range reads.

Writing: the payload digests are computed and grouped in the JVM, with the
payloads left out of that shuffle; the smallest page of each group of equal
payloads becomes the response, the others revisit it. Then every task writes
the records of its pages to one archive (each record a gzip member of its own)
and returns an index row per record: file, offset, length, URL and digest.

Reading: any selection of index rows is sorted by file and offset, neighbouring
ranges are merged into reads of a few megabytes, and each record is unpacked on
its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnlab.llm import files
from churnlab.llm.common import map_arrow, materialize, shared_folder, slices

VERSION = b"WARC/1.1"
#: Fixed instant of the records: archives of equal tables are equal, byte for byte.
DATE = b"2000-01-01T00:00:00Z"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that one reading task takes from one archive.
CHUNK_BYTES = 32 << 20


class CorruptRecord(ValueError):
    pass


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload as its block, or a revisit without it. A page without an id is ``urn:page:null``."""
    block = payload if refers_to is None else b""
    # Line breaks inside a URL would end the header line; they are percent-encoded, as URLs ask for.
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8")
    lines = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
             b"WARC-Record-ID: <urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id), b"WARC-Date: " + DATE, b"WARC-Target-URI: " + target,
             b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Payload-Length: %d" % size]
    if refers_to is not None:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + REVISIT_PROFILE]
    lines += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block); raises ``CorruptRecord`` where the record's lengths don't fit."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not gap:
        raise CorruptRecord("not a WARC record")
    headers = {k.decode(): v.decode("utf-8") for k, _, v in (line.partition(b": ") for line in lines)}
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise CorruptRecord("block length doesn't fit")
    return headers, rest[:size]


def record_types(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, size, digest, refers_to) of (page_id, payload binary), one row per page id and payload: refers_to is the
    smallest page with an equal payload of at least ``min_bytes``, null for that page itself, for pages without an id and
    for smaller payloads."""
    meta = materialize(pages.select("page_id", F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest")).distinct())
    firsts = (meta.where(F.col("size") >= min_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    refers = F.when((F.col("size") >= min_bytes) & (F.col("first") != F.col("page_id")), F.col("first"))
    return meta.join(firsts, "digest", "left").select("page_id", "size", "digest", refers.alias("refers_to"))


INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 100, any_ids: bool = False) -> tuple[str, DataFrame]:
    """Write one record per row; (folder, index table).

    A null payload is an empty one and a null URL an empty one. With
    ``any_ids``, every row keeps a record of its own: one without an id is a
    response whose id is null in the index, and rows that repeat an id are all
    responses or all revisits for equal payloads (a revisit names the page id
    and the digest of its payload). Otherwise page ids are the key of the
    table, and rows without an id or ids that occur twice raise an error. An
    empty table gives an empty index; other columns are ignored.
    """
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession, "warc")
    page_id = F.col(id_col) if any_ids else F.when(F.col(id_col).isNull(), F.raise_error(F.lit("a page needs an id"))).otherwise(F.col(id_col))
    known = pages.select(
        page_id.cast("long").alias("page_id"),
        F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    types = record_types(known, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = "", None, 0
        try:
            for batch in batches:
                for part in slices(batch, "payload"):
                    if out is None:
                        name, out = files.new_file(folder, ".warc.gz")
                    columns = [part.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to")]
                    rows = []
                    for page, url, payload, size, digest, refers in zip(*columns):
                        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = squeeze.compress(record_bytes(page, url, payload or b"", size, digest, refers)) + squeeze.flush()
                        out.write(member)
                        rows.append((page, url, name, at, len(member), digest, "response" if refers is None else "revisit"))
                        at += len(member)
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                     [f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    # A row finds its digest again by id and payload: ids may be null or repeat.
    t = types.withColumnsRenamed({"page_id": "type_page", "digest": "type_digest"})
    same = F.col("page_id").eqNullSafe(F.col("type_page")) & (F.col("digest") == F.col("type_digest"))
    joined = known.withColumn("digest", F.sha2("payload", 256)).join(t, same).select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")
    index = materialize(map_arrow(joined, run, INDEX))
    if not any_ids:
        total, different = index.agg(F.count("*"), F.count_distinct("page_id")).first()
        if total != different:
            raise ValueError("page ids must be unique")
    return folder, index


def read_archives(folder: str, index: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records of any part of an index.

    Returns page_id, url, record_type, refers_to, payload_bytes, payload_digest
    and, if asked for, the payload (null for revisits). Of a response, size and
    digest are computed from the payload read and must equal the header's.
    """
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
              + ", payload binary" * payloads)

    def page_of(urn: str) -> int | None:
        name = urn.strip("<>").rpartition(":")[2]
        return None if name == "null" else int(name)

    def one(member: bytes) -> tuple:
        headers, block = parse_record(zlib.decompress(member, 31))
        digest, size = headers["WARC-Payload-Digest"].partition(":")[2], int(headers["WARC-Payload-Length"])
        refers = None
        if headers["WARC-Type"] == "revisit":
            refers, block = page_of(headers["WARC-Refers-To"]), None
        elif len(block) != size or hashlib.sha256(block).hexdigest() != digest:
            raise CorruptRecord("payload doesn't fit its digest")
        return (page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], refers,
                *((block,) if payloads else ()))

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *((pa.binary(),) if payloads else ()))
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, offset, length = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            a = 0
            while a < len(names):
                b, size = a, 0
                while b < len(names) and names[b] == names[a] and size < files.READ_BYTES:
                    size, b = size + length[b], b + 1
                rows = [one(m) for m in files.read_ranges(folder, names[a], list(zip(offset[a:b], length[a:b])))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], fields)
                a = b

    picked = (index.select("file", "offset", "length", F.floor(F.col("offset") / CHUNK_BYTES).alias("chunk"))
              .repartition("file", "chunk").sortWithinPartitions("file", "offset").drop("chunk"))
    return map_arrow(picked, run, schema)
