"""Embedding near-duplicates by a pivot-permutation index.

1. Equal vectors collapse to one class by digest (partial aggregate), so a
   vector that a third of all rows share is one row of the index.
2. A bounded sample of each vector length gives ``PIVOTS`` reference vectors that
   lie apart from each other. Every class is described by its ``NEAREST`` nearest
   pivots in order. Pivots are files in the shared folder that tasks read, so
   neither the driver nor a plan holds anything per length.
3. The inverted lists are kept per length and set of ``SHARED`` pivots: two
   vectors of a length meet in a list exactly if they share that many of their
   nearest pivots. Lists of one vector drop out.
4. A list of more than ``BLOCK`` vectors is dealt out in blocks, one task unit
   per pair of blocks. A pair that shares more pivots meets in several lists
   and is verified in the one of its lowest shared pivots alone, so it counts
   once. Cosines are computed in double precision, in matrix blocks.
5. Long lists return link counts and a spanning forest, never their pairs.

The index is approximate (pairs that share fewer pivots are not seen); every
row is indexed and every reported link is verified. ``recall`` measures it
against all pairs for the query set of ids divisible by 20.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnlab.llm.common import map_arrow, materialize, remove_folder, shared_folder
from churnlab.llm.components import component_roots
from churnlab.llm.files import new_file, open_folder

#: Reference vectors (at most 128: two mask words), how many describe a vector, how many a pair must share.
PIVOTS, NEAREST, SHARED = 128, 6, 3
#: Vectors of a length that its pivots are chosen from (all, or about this many by hash), and the cosine above which two
#: pivots are too close.
PIVOT_SAMPLE, PIVOT_APART = 4096, 0.7
#: A list key is a vector length and ``SHARED`` digits, each a pivot's number plus one (0: a length with fewer pivots).
DIGITS, KEY_BITS = PIVOTS + 1, 24
#: Lengths whose pivots a task keeps while it describes vectors.
KEPT_LENGTHS = 8
#: Vectors of one list that are compared in one block; lists up to ``SHORT`` are compared list-wise in bulk.
BLOCK, SHORT = 512, 16


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, apart: float = PIVOT_APART) -> np.ndarray:
    """Unit vectors of the sample, in order, that have a cosine below ``apart`` with those chosen before."""
    chosen = np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    for v in sample:
        if len(chosen) < pivots and (not len(chosen) or (chosen @ v).max() < apart):
            chosen = np.vstack([chosen, v])
    return chosen


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the squares finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_table(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, digest, dim, vec) with the vector as doubles; digest is null for vectors that cannot link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, dims, raw = [], [], []
            for row, known in zip(batch.column("vec"), batch.column("id").is_valid()):
                v = row.values.to_numpy(zero_copy_only=False).astype(np.float64) if row.is_valid else np.zeros(0)
                ok = known.as_py() and v.any() and bool(np.isfinite(v).all()) and not row.values.null_count
                data = (v + 0.0).tobytes() if ok else None  # -0.0 and 0.0 are one value
                raw.append(data)
                dims.append(len(v) if ok else None)
                digest.append(blake2b(data, digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digest, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
                                             ["id", "digest", "dim", "vec"])

    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return map_arrow(given, run, "id long, digest binary, dim int, vec binary")


def pivot_files(classes: DataFrame, folder: str) -> DataFrame:
    """(dim, file): the pivots of each vector length, chosen by one task per length from about ``PIVOT_SAMPLE`` classes of
    the smallest hashes. Only files that the returned table names are read."""
    sizes = classes.groupBy("dim").agg(F.count("*").alias("of_dim"))
    low = F.col("rep").cast("double") < F.lit(-float(1 << 63)) + F.lit(float(1 << 64) * PIVOT_SAMPLE) / F.col("of_dim")
    sample = classes.select("dim", "rep", "vec").join(sizes, "dim").where((F.col("of_dim") <= PIVOT_SAMPLE) | low).drop("of_dim")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        pivots = choose_pivots(unit(group.sort_values("rep")["vec"].tolist()))
        name, out = new_file(folder, ".pivots")
        with out:
            out.write(pivots.tobytes())
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "file": [name]})

    return materialize(sample.groupBy("dim").applyInPandas(choose, "dim int, file string"))


def describe(classes: DataFrame, folder: str) -> DataFrame:
    """(rep, n, vec, m0, m1, keys) of classes (rep, n, dim, vec, file): the pivot mask of each class and the keys of its
    inverted lists."""
    def lists(raw: list[bytes], dim: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nearest, shared = min(NEAREST, len(pivots)), min(SHARED, len(pivots))
        near = np.argsort(-(unit(raw) @ pivots.T), axis=1, kind="stable")[:, :nearest]
        bits = np.zeros((len(near), 2), np.uint64)
        for k in range(nearest):
            bits[np.arange(len(near)), near[:, k] // 64] |= np.uint64(1) << (near[:, k] % 64).astype(np.uint64)
        members = np.sort(near, axis=1)[:, np.array(list(combinations(range(nearest), shared)))]  # row, list, rising pivots
        digits = np.zeros(members.shape[:2], np.int64)
        for k in range(shared):
            digits = digits * DIGITS + members[:, :, k] + 1
        return bits, digits + (dim << KEY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, dims = np.array(batch.column("file").to_pylist(), object), batch.column("dim").to_numpy()
            for name in dict.fromkeys(names):
                part = batch.take(pa.array(np.flatnonzero(names == name)))
                dim = int(part.column("dim")[0].as_py())
                if name not in held:
                    if len(held) >= KEPT_LENGTHS:
                        held.pop(next(iter(held)))
                    with fs.open_input_file(f"{path}/{name}") as f:
                        held[name] = np.frombuffer(f.read(), np.float64).reshape(-1, dim)
                bits, keys = lists(part.column("vec").to_pylist(), dim, held[name])
                at = pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("n"), part.column("vec"),
                                                  *[pa.array(bits[:, w].copy().view(np.int64)) for w in (0, 1)],
                                                  pa.ListArray.from_arrays(at, pa.array(keys.ravel()))],
                                                 ["rep", "n", "vec", "m0", "m1", "keys"])

    return map_arrow(classes, run, "rep long, n long, vec binary, m0 long, m1 long, keys array<long>")


def _key_masks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: mask words of its pivots, and of all pivots up to its highest."""
    own, upto = np.zeros((len(keys), 2), np.uint64), np.zeros((len(keys), 2), np.uint64)
    rest = keys & ((1 << KEY_BITS) - 1)
    for k in range(SHARED):
        digit, rest = rest % DIGITS, rest // DIGITS
        at = np.flatnonzero(digit)
        pivot = digit[at] - 1
        bit = np.uint64(1) << (pivot % 64).astype(np.uint64)
        own[at, pivot // 64] |= bit
        if k == 0:  # the last digit is the highest pivot
            high, low_bits = pivot >= 64, bit | (bit - np.uint64(1))
            upto[at, 0] = np.where(high, np.uint64(2**64 - 1), low_bits)
            upto[at, 1] = np.where(high, low_bits, np.uint64(0))
    return own, upto


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links (row, earlier row) of a symmetric boolean matrix."""
    todo, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if todo[i]:
            todo[i], front = False, [i]
            while front:
                at = front.pop()
                new = np.flatnonzero(near[at] & todo)
                todo[new] = False
                front += new.tolist()
                out += [(j, at) for j in new.tolist()]
    return out


def _verify(units: DataFrame, threshold: float) -> DataFrame:
    """Links of the list blocks: rows (a, b, null) connect, rows (a, null, w) add w links to a."""
    def rows_of(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c).to_numpy() for c in ("key", "bi", "bj", "b", "rep", "n")}
        out["mask"] = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("m0", "m1")], 1)
        out["x"] = unit(batch.column("vec").to_pylist())
        return out

    def links(r: dict) -> pa.RecordBatch:
        same = (r["key"][1:] == r["key"][:-1]) & (r["bi"][1:] == r["bi"][:-1]) & (r["bj"][1:] == r["bj"][:-1])
        start = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(r["key"])]))
        size = np.diff(start)
        own, upto = _key_masks(r["key"])
        weight, edges = np.zeros(len(r["key"]), np.int64), []
        short = (size <= SHORT) & (r["bi"][start[:-1]] == r["bj"][start[:-1]])
        is_short, group = np.repeat(short, size), np.repeat(np.arange(len(size)), size)
        for step in range(1, min(SHORT, len(group))):  # rows `step` apart in all short lists at once
            i = np.flatnonzero((group[step:] == group[:-step]) & is_short[step:])
            if not len(i):
                break
            j = i + step
            i = i[(((r["mask"][i] & r["mask"][j]) & upto[i]) == own[i]).all(axis=1)]
            j = i + step
            i = i[np.einsum("ij,ij->i", r["x"][i], r["x"][j]) >= threshold]
            j = i + step
            np.add.at(weight, i, r["n"][j])
            np.add.at(weight, j, r["n"][i])
            edges += list(zip(r["rep"][i].tolist(), r["rep"][j].tolist()))
        for g in np.flatnonzero(~short):
            a, b = start[g], start[g + 1]
            mask, x, n, block = r["mask"][a:b], r["x"][a:b], r["n"][a:b], r["b"][a:b]
            near = x @ x.T >= threshold
            for w in (0, 1):
                near &= (mask[:, None, w] & mask[None, :, w] & upto[a, w]) == own[a, w]
            if r["bi"][a] != r["bj"][a]:
                near &= block[:, None] != block[None, :]
            np.fill_diagonal(near, False)
            weight[a:b] += near @ n
            rep = r["rep"][a:b].tolist()
            edges += [(rep[p], rep[q]) for p, q in forest(near)]
        counted = np.flatnonzero(weight)
        left = [a for a, _ in edges] + r["rep"][counted].tolist()
        right = [b for _, b in edges] + [None] * len(counted)
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()),
                                           pa.array([None] * len(edges) + weight[counted].tolist(), pa.int64())], ["a", "b", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the list that may go on in the next batch
        for batch in batches:
            dims = batch.column("key").to_numpy() >> KEY_BITS  # sorted by key: vectors of one length lie together
            ends = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(ends, ends[1:]):
                if a == b:
                    continue
                r = rows_of(batch.slice(a, b - a))
                if held is not None and held["key"][0] >> KEY_BITS != dims[a]:
                    yield links(held)
                    held = None
                if held is not None:
                    r = {k: np.concatenate((held[k], r[k])) for k in r}
                last = (r["key"] == r["key"][-1]) & (r["bi"] == r["bi"][-1]) & (r["bj"] == r["bj"][-1])
                cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
                held = {k: v[cut:] for k, v in r.items()}
                if cut:
                    yield links({k: v[:cut] for k, v in r.items()})
        if held is not None:
            yield links(held)

    return map_arrow(units, run, "a long, b long, w long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors of one length are linked where their cosine is at least
    ``threshold``; vectors of different lengths are not. Null and zero vectors,
    vectors with null or non-finite components or without an id have no links and
    are components of their own. Rows that repeat an id are vectors of their own
    with that id.
    An empty table gives no rows; other columns are ignored.
    """
    table = materialize(vector_table(vectors, id_col, vec_col))
    usable = table.where("dim is not null")
    # Rows that repeat an id may hold different vectors: a class is named by its smallest id and its digest.
    classes = usable.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    one = usable.select("digest", F.col("id").alias("least"), "dim", "vec").dropDuplicates(["digest", "least"])
    classes = materialize(classes.join(one, ["digest", "least"]).withColumn("rep", F.xxhash64("digest")))
    found = described_links(classes, threshold)
    weights = found.where("w is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    roots = component_roots(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.select("digest", "least", "n", "rep").join(weights, "rep", "left").join(roots, "rep", "left")
    named = named.withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = named.join(least, "root").select("digest", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), "component_id")
    out = table.select("id", "digest").join(facts, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def described_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Retrieve through the inverted lists and verify; see ``_verify`` for the rows."""
    spark = classes.sparkSession
    folder = shared_folder(spark, "pivots")
    described = classes.select("rep", "n", "dim", "vec").join(pivot_files(classes, folder), "dim")
    index = materialize(describe(described, folder))
    remove_folder(spark, folder)
    posted = index.select(F.explode("keys").alias("key"), "rep")
    lists = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = (posted.join(lists, "key").withColumn("blocks", blocks)
               .withColumn("b", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = members.select("key", "rep", "b", other.alias("o")).select(
        "key", "rep", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))
    units = units.join(index.select("rep", "n", "vec", "m0", "m1"), "rep")
    units = units.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return materialize(_verify(units, threshold))


def recall(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
           every: int = 20) -> float:
    """Share of the true links of the rows with ids divisible by ``every`` that ``n_links`` counts; blocks of queries
    against all rows (a measurement, not part of the operator)."""
    table = vector_table(vectors, id_col, vec_col).where("digest is not null")
    queries = table.where(F.col("id") % every == 0)
    total = 0
    wanted = queries.select("dim", "vec").toPandas()
    for dim, of_dim in wanted.groupby("dim"):
        for a in range(0, len(of_dim), 4096):
            q = unit(of_dim.vec.iloc[a: a + 4096].tolist())

            def count(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        x = unit(batch.column("vec").to_pylist())
                        yield pa.RecordBatch.from_arrays([pa.array([int((x @ q.T >= threshold).sum())])], ["n"])

            total += (map_arrow(table.where(F.col("dim") == int(dim)).select("vec"), count, "n long").agg(F.sum("n")).first()[0] or 0) - len(q)
    found = result.where(F.col(id_col) % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return found / total if total else 1.0
