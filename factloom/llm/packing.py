"""Filling fixed-capacity containers (problem 8).

Harmonic packing: an item of length in (capacity/(k+1), capacity/k] is of class k, and a container of
class k takes k of them, so every worker fills containers on its own, without a shuffle.  What a class
leaves of its containers is then topped up with the longest smaller items that fit, which plain harmonic
packing wastes.  Classes are filled longest items first, so nearly only each block's last containers
stay partly empty: at most a few per task, whatever the corpus' size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: So many items are packed together; a task with more packs them in blocks.
BLOCK_ITEMS = 200_000


def harmonic_pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container number (0..) of each item; every length is in 1..capacity.

    Ties are broken by the items' order, so equal input gives equal output.
    """
    order = np.lexsort((np.arange(len(lengths)), lengths))
    left: dict[int, list[int]] = {}
    for k in order[::-1].tolist():
        left.setdefault(int(lengths[k]), []).append(k)
    for items in left.values():
        items.reverse()  # pop() takes the latest in the list: the one that came last goes first
    sizes = sorted(left)
    bins = np.full(len(lengths), -1, np.int64)
    n = -1
    while sizes:
        n += 1
        longest = sizes[-1]
        of_class = capacity // longest
        room = capacity
        taken = 0
        while sizes:
            if taken < of_class and sizes[-1] <= room:  # the class' own items, longest first
                at = len(sizes) - 1
                taken += 1
            else:  # top up
                at = bisect_right(sizes, room) - 1
                if at < 0:
                    break
            size = sizes[at]
            items = left[size]
            bins[items.pop()] = n
            room -= size
            if not items:
                del sizes[at]
    return bins


def pack_documents(counts: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """(id, size) to (id, piece, token_from, n_tokens, container_id), a row per piece.

    An item of at most ``capacity`` is one piece (piece 0).  A longer one is cut into pieces of exactly
    ``capacity``, each a container of its own, and a rest that is packed like an item.  Items of size
    null, 0 or less are left out.  Repeated rows are items of their own; a null id stays null.
    ``container_id`` is unique over the result and made from the task's number, so a task that runs
    again gives the same containers.
    """
    kind = counts.schema[id_col].dataType
    counts = counts.select(id_col, size_col)

    def pack(ids: pa.Array, sizes: np.ndarray, prefix: str) -> pa.RecordBatch:
        pieces = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(capacity, sizes[row] - piece * capacity)
        bins = harmonic_pack(length, capacity)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(piece * capacity, pa.int64()),
                pa.array(length, pa.int32()),
                pa.array([f"{prefix}{b}" for b in bins.tolist()], pa.string()),
            ],
            names=[id_col, "piece", "token_from", "n_tokens", "container_id"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held_ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        n = block = 0
        for batch in batches:
            sizes = batch.column(size_col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.flatnonzero(sizes > 0)
            held_ids.append(batch.column(id_col).take(pa.array(keep)))
            held.append(sizes[keep])
            n += len(keep)
            if n >= BLOCK_ITEMS:
                yield pack(pa.concat_arrays(held_ids), np.concatenate(held), f"{task}-{block}-")
                held_ids, held, n, block = [], [], 0, block + 1
        if n:
            yield pack(pa.concat_arrays(held_ids), np.concatenate(held), f"{task}-{block}-")

    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("token_from", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("container_id", T.StringType()),
        ]
    )
    return counts.mapInArrow(run, schema)
