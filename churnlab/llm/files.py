"""Files that tasks write to and read byte ranges from, in the shared folder.

``pyarrow.fs`` opens the folder that ``spark.checkpoint.dir`` names (local,
HDFS, S3, GCS). A task writes a file under a name no other attempt uses and
returns rows that name it; a file counts only if those rows were committed, so
a lost or repeated task leaves nothing that a reader would see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs

#: Ranges closer than this are fetched in one read.
GAP_BYTES = 64 << 10
#: One read fetches at most this much (or one record, if that is larger).
READ_BYTES = 4 << 20


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """Spark's names of a folder in pyarrow's terms: ``s3a`` and ``s3n`` are S3, a path without a scheme is local."""
    scheme, _, rest = uri.partition("://")
    if scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return pafs.FileSystem.from_uri(uri) if rest or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def new_file(folder: str, suffix: str) -> tuple[str, object]:
    """(name, output stream) of a file of its own below ``folder``."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return name, fs.open_output_stream(f"{path}/{name}", compression=None)


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """Merge sorted (offset, length) ranges into reads: (offset, length, first range, ranges)."""
    reads: list[list[int]] = []
    for i, (at, length) in enumerate(ranges):
        if reads and at - (reads[-1][0] + reads[-1][1]) <= gap and at + length - reads[-1][0] <= most:
            reads[-1][1] = max(reads[-1][1], at + length - reads[-1][0])
            reads[-1][3] += 1
        else:
            reads.append([at, length, i, 1])
    return [tuple(r) for r in reads]


def read_ranges(folder: str, name: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each (offset, length) of one file, in the given (sorted) order, by coalesced reads."""
    fs, path = open_folder(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        for at, length, first, n in coalesce(ranges):
            block = memoryview(f.read_at(length, at))
            for a, size in ranges[first: first + n]:
                yield bytes(block[a - at: a - at + size])
