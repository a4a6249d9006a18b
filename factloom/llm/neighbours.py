"""Most similar vectors for every vector (problem 6).

Randomly rotated one-bit codes in an inverted file.  Vectors are normalised, so cosine similarity is the
inner product.  Each vector is stored in the list of its nearest centre c as v = c + |r| o; the rotated
unit residual o keeps one bit a dimension plus two scalars.  Every vector asks the lists of its nearest
centres; there, inner products are estimated from the packed bits and correction scalars (one matrix product
with the bits as signs), with the code's error bound; only vectors whose upper bound reaches the k-th best
lower bound are compared exactly.

The centres come from a bounded sample (SAMPLE rows), all rows are indexed.  Hot lists are cut into
blocks of at most BLOCK rows, and each block answers its list's queries alone, so no task holds an
unbounded list.  Exact copies of a vector are one vector with its ids: a vector needs no more than k + 1
of them, so a hot group of copies adds nothing to a list.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.tables import Scratch

#: Rows from which the centres are fitted, at most.
SAMPLE = 32_768
#: Centres: LISTS_PER_ROOT times the root of the number of rows, at most SAMPLE / 4.
LISTS_PER_ROOT = 2.0
#: Lists each vector asks.
PROBES = 6
#: Stored rows, and queries, of a list that one task compares at once.
BLOCK = 8_192
QUERY_BLOCK = 32_768
#: Times k rows that are compared first, and the error allowed to single precision.
FIRST, SINGLE = 2, 1e-5
#: The error bound's width in standard deviations of the one-bit estimate.
EPSILON = 3.2


def parse_vectors(df: DataFrame, json_col: str, dim: int, extra: list[str]) -> DataFrame:
    """The rows whose JSON is a list of ``dim`` finite numbers not all zero, with it as ``vector``."""
    schema = T.StructType([*(df.schema[c] for c in extra), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vectors = [], []
            for n, text in enumerate(batch.column(json_col).to_pylist()):
                if text and (v := read_vector(text, dim)) is not None:
                    keep.append(n)
                    vectors.append(v)
            values = np.concatenate(vectors) if vectors else np.empty(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim, dtype=np.int32)), pa.array(values))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in extra), lists], names=[*extra, "vector"])

    return df.select(*extra, json_col).mapInArrow(run, schema)


def read_vector(text: str, dim: int) -> np.ndarray | None:
    """A JSON list of ``dim`` finite numbers that are not all zero; None for anything else."""
    s = text.strip()
    if not (s.startswith("[") and s.endswith("]")) or s.count(",") != dim - 1:
        return None
    try:
        found = json.loads(s)
    except ValueError:
        return None
    if len(found) != dim or not all(type(x) in (int, float) for x in found):
        return None
    try:
        v = np.array(found, np.float64)
    except OverflowError:
        return None
    return v if np.isfinite(v).all() and v.any() else None


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Spherical k-means on the sample, in blocks of rows."""
    n = len(sample)
    lists = max(1, min(lists, n))
    centres = sample[np.random.default_rng(seed).permutation(n)[:lists]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[k : k + 4096] @ centres.T, axis=1) for k in range(0, n, 4096)])
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(sample[order], at)
        centres[near[order][at]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def binary_of(v: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    v = np.ascontiguousarray(v)
    width = v.shape[1] * v.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(v), [None, pa.py_buffer(v)]).cast(pa.binary())


def vectors_of(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)


def pack_bits(signs: np.ndarray) -> np.ndarray:
    """Boolean rows to rows of 64-bit words."""
    pad = -signs.shape[1] % 64
    if pad:
        signs = np.pad(signs, ((0, 0), (0, pad)))
    return np.packbits(signs, axis=1).view(np.uint64)


class Codes:
    """One-bit codes of unit vectors' residuals against their list's centre."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        residual = (vectors - centre) @ turn
        self.norm = np.linalg.norm(residual, axis=1)
        unit = residual / np.maximum(self.norm, 1e-12)[:, None]
        signs = unit > 0
        self.bits = pack_bits(signs)
        dim = vectors.shape[1]
        #: <code, o>: how well the code stands for its residual
        self.fit = np.maximum(np.abs(unit).sum(axis=1) / np.sqrt(dim), 1e-6)
        self.on_centre = vectors @ centre
        self.error = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit * EPSILON / np.sqrt(max(dim - 1, 1))

    def estimate(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries (rows) with the coded vectors, and their error bounds."""
        dim = queries.shape[1]
        residual = (queries - centre) @ turn
        norm = np.linalg.norm(residual, axis=1)
        # the packed bits as -1 and 1, so that one product gives <code, residual> for all
        signs = np.unpackbits(self.bits.view(np.uint8), axis=1, count=dim).astype(np.float32)
        signs = (2 * signs - 1) / np.float32(np.sqrt(dim))
        # <v, u> = <v, c> + <u - c, c> + |r_v| <o_v, r_u>
        known = self.on_centre[None, :] + ((queries - centre) @ centre)[:, None]
        estimated = (residual @ signs.T) * (self.norm / self.fit)[None, :]
        return known + estimated, norm[:, None] * (self.norm * self.error)[None, :]


def best_in_list(stored: np.ndarray, queries: np.ndarray, same: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int):
    """For each query, up to k stored rows of highest inner product: (query, row, value) arrays.

    same[q]: the stored row that is the query itself, or -1.
    """
    codes = Codes(stored, centre, turn)
    out = []
    for lo in range(0, len(queries), 512):
        block = queries[lo : lo + 512]
        est, err = codes.estimate(block, centre, turn)
        own = same[lo : lo + 512]
        rows = np.flatnonzero(own >= 0)
        est[rows, own[rows]] = -np.inf
        n = est.shape[1]
        if n > k:
            # the best by estimate are compared first: the k-th of them is a bar the others' upper bounds must reach
            first = np.argpartition(-est, min(FIRST * k, n) - 1, axis=1)[:, : FIRST * k]
            seen = np.einsum("ij,ikj->ik", block, stored[first])
            seen[~np.isfinite(np.take_along_axis(est, first, axis=1))] = -np.inf
            bar = -np.partition(-seen, k - 1, axis=1)[:, k - 1]
            q, row = np.nonzero((est + err >= bar[:, None] - SINGLE) & np.isfinite(est))
        else:
            q, row = np.nonzero(np.isfinite(est))
        # the chosen ones in single precision, those that may be among the k in double
        exact = np.einsum("ij,ij->i", block[q], stored[row])
        if n > k:
            close = exact >= bar[q] - SINGLE
            q, row = q[close], row[close]
        exact = np.einsum("ij,ij->i", block[q].astype(np.float64), stored[row].astype(np.float64))
        order = np.lexsort((row, -exact, q))
        q, row, exact = q[order], row[order], exact[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        out.append((q[top] + lo, row[top], exact[top]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, int)] * 3


def nearest_neighbours(vectors: DataFrame, dim: int, k: int = 5, probes: int = PROBES) -> DataFrame:
    """(id, vector array<double>) to (id, neighbour, similarity), the k most similar other rows of each row.

    Approximate: a neighbour is missed if it lies in none of the ``probes`` asked lists or, rarely, if its
    error bound fails.  Fewer than k come out only if fewer rows are found.  Ties are broken by the
    smaller neighbour id.  ids must not be null; of rows with one id and different vectors one counts; vectors
    must be finite, of length ``dim`` and not zero (``parse_vectors`` sees to it).  Other columns are ignored.  An empty input gives an
    empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    id_type = vectors.schema["id"].dataType
    packed = T.StructType([T.StructField("id", id_type), T.StructField("raw", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column("id"), binary_of(v)], names=["id", "raw"])

    # vectors are read and normalised once; from here on copies are told by two hashes
    unit = vectors.select("id", "vector").mapInArrow(pack, packed)
    unit, _ = scratch.cut(unit.select("id", "raw", F.xxhash64("raw").alias("h1"), F.xxhash64(F.lit(1), "raw").alias("h2")))
    of_id = unit.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    groups = of_id.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    grouped = unit.groupBy("h1", "h2").agg(F.first("raw").alias("raw")).join(groups, ["h1", "h2"])
    grouped, _ = scratch.cut(grouped)
    total = grouped.count()
    sample = vectors_of(grouped.orderBy("h1", "h2").limit(SAMPLE).select("raw").toArrow().column("raw").to_pylist(), dim)
    lists = int(min(max(LISTS_PER_ROOT * np.sqrt(total), 1), SAMPLE // 4))
    centres = fit_centres(sample.astype(np.float32), lists) if total else np.zeros((1, dim), np.float32)
    del sample
    shared = spark.sparkContext.broadcast(centres)
    turn = rotation(dim)
    wanted = min(probes, len(centres))
    placed = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("raw", T.BinaryType()),
            T.StructField("home", T.IntegerType()),
            T.StructField("lists", T.ArrayType(T.IntegerType())),
        ]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                s = vectors_of(part.column("raw").to_pylist(), dim) @ c.T
                near = np.argpartition(-s, wanted - 1, axis=1)[:, :wanted].astype(np.int32)
                ends = np.arange(0, near.size + 1, wanted, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("raw"),
                        pa.array(s.argmax(axis=1).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel())),
                    ],
                    names=["id", "raw", "home", "lists"],
                )

    cells, _ = scratch.cut(grouped.select("id", "raw").mapInArrow(assign, placed))
    # A list's stored rows and its queries fall into blocks of bounded size; a row is repeated for each
    # block of the other side.  Nearly all lists have one block of either.
    n_lists = len(centres)
    stored_in = np.zeros(n_lists, np.int64)
    asked = np.zeros(n_lists, np.int64)
    for r in cells.groupBy("home").count().collect():  # bounded: a row a centre
        stored_in[r[0]] = r[1]
    for r in cells.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        asked[r[0]] = r[1]
    blocks = spark.createDataFrame(
        pd.DataFrame(
            {
                "list": np.arange(n_lists, dtype=np.int32),
                "s_blocks": np.maximum(-(-stored_in // BLOCK), 1).astype(np.int32),
                "q_blocks": np.maximum(-(-asked // QUERY_BLOCK), 1).astype(np.int32),
            }
        )
    )
    h = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = cells.select("id", "raw", F.col("home").alias("list")).join(F.broadcast(blocks), "list")
    stored = stored.select("list", F.pmod(h, "s_blocks").cast("int").alias("s"), every("q_blocks").alias("q"), "id", "raw", F.lit(True).alias("stored"))
    query = cells.select("id", "raw", F.explode("lists").alias("list")).join(F.broadcast(blocks), "list")
    query = query.select("list", every("s_blocks").alias("s"), F.pmod(h, "q_blocks").cast("int").alias("q"), "id", "raw", F.lit(False).alias("stored"))
    found = T.StructType(
        [T.StructField("id", id_type), T.StructField("neighbour", id_type), T.StructField("similarity", T.DoubleType())]
    )

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v = vectors_of(table.column("raw").to_pylist(), dim)
        is_stored = table.column("stored").to_numpy()
        at, asks = np.flatnonzero(is_stored), np.flatnonzero(~is_stored)
        ids = table.column("id").to_pylist()
        place = {ids[n]: k for k, n in enumerate(at.tolist())}
        same = np.array([place.get(ids[n], -1) for n in asks.tolist()], np.int64)
        a, b, s = best_in_list(v[at], v[asks], same, shared.value[key[0].as_py()], turn, k) if len(at) and len(asks) else [np.empty(0, int)] * 3
        column = table.column("id")
        return pa.table(
            {"id": column.take(pa.array(asks[a])), "neighbour": column.take(pa.array(at[b])), "similarity": pa.array(s, pa.float64())}
        )

    near = stored.union(query).groupBy("list", "s", "q").applyInArrow(answer, found)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    top = lambda df: df.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    near = top(near)
    hot = grouped.where("copies > 1").select("h1", "h2", F.col("id").alias("rep"))
    if hot.isEmpty():
        return near
    # Copies: each vector was searched once; its rows now get one another and the rows of its neighbours,
    # of which none needs more than k + 1.
    near, _ = scratch.cut(near)
    rows = of_id.join(hot, ["h1", "h2"]).select("id", "rep")
    rows, _ = scratch.cut(rows)
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    others = few.where("id <> rep")
    wider = near.union(
        near.join(others.select(F.col("rep").alias("neighbour"), F.col("id").alias("copy")), "neighbour").select("id", "copy", "similarity")
    ).union(few.select(F.col("rep").alias("id"), F.col("id").alias("neighbour"), F.lit(1.0)))
    to_rows = wider.withColumnRenamed("id", "rep").join(rows.where("id <> rep"), "rep").select("id", "neighbour", "similarity")
    return top(wider.union(to_rows).where("id <> neighbour"))
