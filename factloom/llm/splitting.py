"""Splitting oversized items at natural boundaries (problem 2).

Every place of a text has a boundary strength: paragraph, line, sentence or word end, or none.  A sparse
table over (strength, place) answers the maximum of any window in one comparison, so each piece ends at
the strongest boundary of its permissible window, the rightmost of equals; the next piece starts
``overlap`` characters before.  Batches are split the same way, over their chunks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CHUNK_BUDGET, BATCH_BUDGET, OVERLAP = 1_500, 15_000, 150
#: What doesn't count at either end of a text.
BLANKS = " \t\r\n"

_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]")
#: A short word before a full stop is taken for an abbreviation.
_SHORT = re.compile(r"(?:^|[\s(])[^\W\d_]{1,3}$")


class RangeMax:
    """Sparse table: the largest of values[lo..hi], for windows up to ``width`` long."""

    def __init__(self, values: np.ndarray, width: int) -> None:
        self.levels = [values]
        while 2 ** len(self.levels) <= min(width, len(values)):
            last, step = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-step], last[step:]))

    def query(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi - 2**k + 1]))


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each place 0..n: 4 paragraph, 3 line, 2 sentence, 1 word end, 0 none, -1 never."""
    n = len(text)
    s = np.zeros(n + 1, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct = np.unique(codes)
    blank = np.isin(codes, [c for c in distinct.tolist() if chr(c).isspace()])
    line = (codes == 10) | (codes == 13)
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    s[ends] = 1
    for m in _SENTENCE.finditer(text):
        if not (m[0][0] == "." and _SHORT.search(text[max(0, m.start() - 5) : m.start()])):
            s[m.end()] = 2
    if line.any():
        # a word end is a line end, or a paragraph end, by the line feeds of the white space behind it
        feeds = np.concatenate([[0], np.cumsum(codes == 10)])
        returns = np.concatenate([[0], np.cumsum(codes == 13)])
        solid = np.flatnonzero(~blank)
        after = np.searchsorted(solid, ends)
        until = np.where(after < len(solid), solid[np.minimum(after, len(solid) - 1)] if len(solid) else n, n)
        count = np.maximum(feeds[until] - feeds[ends], returns[until] - returns[ends])
        s[ends[count == 1]] = 3
        s[ends[count > 1]] = 4
    joiners = [c for c in distinct.tolist() if unicodedata.combining(chr(c)) or 0xFE00 <= c <= 0xFE0F or c == 0x200D]
    if joiners:
        s[np.flatnonzero(np.isin(codes, joiners))] = -1
    return s


def split_text(text: str, limit: int = CHUNK_BUDGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces, each of at most ``limit`` characters, sharing ``overlap`` with the one before.

    A piece is at least half of the limit long if a boundary allows; where there is none at all it is cut at
    the limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    key = strengths(text) * (n + 1) + np.arange(n + 1)
    table = RangeMax(key, limit)
    pieces, start = [], 0
    while n - start > limit:
        least, most = start + overlap + 1, start + limit
        best = table.query(max(least, start + limit // 2), most)
        if best < n + 1:
            best = max(best, table.query(least, most))
        end = best % (n + 1) if best >= n + 1 else most
        while end > least and key[end] < 0:  # not between a letter and its accent
            end -= 1
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


def split_chunks_of(lengths: list[int], sections: list[str | None], pages: list[int | None], budget: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the pieces of a batch: runs of chunks of one section within the budget.

    A piece starts with the last chunk of the one before if that fits and is of the same section.  A chunk
    longer than the budget is a piece of its own.
    """
    pieces: list[tuple[int, int]] = []
    n = len(lengths)
    block = 0
    while block < n:
        stop = block
        while stop < n and sections[stop] == sections[block]:
            stop += 1
        total = np.concatenate([[0], np.cumsum(lengths[block:stop])])
        m = stop - block
        # strength of a cut before chunk k of the block: the end counts most, then a change of page
        rank = np.array([0] + [2 if pages[block + k] != pages[block + k - 1] else 1 for k in range(1, m)] + [3], np.int64)
        table = RangeMax(rank * (m + 1) + np.arange(m + 1), m + 1)
        start, fresh = 0, 0  # fresh: the first chunk that no piece has yet
        while fresh < m:
            most = int(np.searchsorted(total, total[start] + budget, side="right")) - 1
            if most <= fresh:  # the repeated chunk leaves no room, or one chunk exceeds the budget
                if start < fresh:
                    start = fresh
                    continue
                most = fresh + 1
            half = int(np.searchsorted(total, total[start] + budget / 2, side="left"))
            end = table.query(min(max(fresh + 1, half), most), most) % (m + 1)
            pieces.append((block + start, block + end))
            fresh = end
            start = end - 1 if end < m else end
        block = stop
    return pieces


def _latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*columns)).alias("r"))
    return rows.select("_key", "r.*")


def counted_length(column: str):
    """Characters of a text, without blanks at either end; 0 for null."""
    return F.coalesce(F.length(F.trim(F.col(column), F.lit(BLANKS))), F.lit(0))


def split_chunks(chunks: DataFrame, limit: int = CHUNK_BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks whose text, stripped, has more than ``limit`` characters.

    Result: item_id, section, piece (from 0), start, end (places in the stripped text), text.  Of rows with
    one id the one with the longest text, then the largest, counts.  Null ids and null texts are left out.
    """
    named = chunks.select("id", "section", "text").withColumn("_n", counted_length("text")).where(F.col("_n") > limit)
    named = _latest(named, "id", ["_n", "text", "section"]).select(F.col("_key").alias("item_id"), "section", F.trim("text", F.lit(BLANKS)).alias("text"))
    schema = T.StructType(
        [
            T.StructField("item_id", chunks.schema["id"].dataType),
            T.StructField("section", T.StringType()),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, end, text = [], [], [], [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                for p, (a, b) in enumerate(split_text(t, limit, overlap)):
                    row.append(k)
                    piece.append(p)
                    start.append(a)
                    end.append(b)
                    text.append(t[a:b])
            at = pa.array(row, pa.int64())
            columns = [batch.column("item_id").take(at), batch.column("section").take(at), piece, start, end, text]
            columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return named.mapInArrow(run, schema)


def split_batches(batches: DataFrame, chunks: DataFrame, budget: int = BATCH_BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the batches whose chunks' stripped lengths add up to more than ``budget``.

    Result: item_id, section (of the chunks), piece (from 0), chunk_ids, start, end, chars.  start and end
    are null, except that a chunk longer than the budget is itself cut by ``split_text``.  total_chars is
    not used.  Unknown chunk ids count 0 characters and have a null section; ids named twice count twice.
    Batches with a null id or without chunks are left out.
    """
    lengths = chunks.select("id", "section", "page_number", counted_length("text").alias("_n"))
    lengths = _latest(lengths, "id", ["_n", "section", "page_number"])
    once = _latest(batches.select("batch_id", "chunk_ids"), "batch_id", ["chunk_ids"])
    parts = once.select(F.col("_key").alias("item_id"), F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    parts = parts.join(lengths, parts["chunk_id"] == lengths["_key"], "left")
    items = parts.groupBy("item_id").agg(
        F.sum(F.coalesce("_n", F.lit(0))).alias("total"),
        F.sort_array(F.collect_list(F.struct("pos", "chunk_id", F.coalesce("_n", F.lit(0)).alias("n"), "section", "page_number"))).alias("parts"),
    )
    items = items.where(F.col("total") > budget).select("item_id", "parts")
    schema = T.StructType(
        [
            T.StructField("item_id", batches.schema["batch_id"].dataType),
            T.StructField("section", T.StringType()),
            T.StructField("piece", T.IntegerType()),
            T.StructField("chunk_ids", T.ArrayType(T.StringType())),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("chars", T.LongType()),
        ]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, parts in zip(batch.column("item_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                sizes = [p["n"] for p in parts]
                runs = split_chunks_of(sizes, [p["section"] for p in parts], [p["page_number"] for p in parts], budget)
                for p, (a, b) in enumerate(runs):
                    out.append((item, parts[a]["section"], p, [x["chunk_id"] for x in parts[a:b]], None, None, sum(sizes[a:b])))
            columns = list(zip(*out, strict=True)) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    pieces = items.mapInArrow(run, schema)
    # chunks longer than a batch's budget: cut their text, which only they need
    long = _latest(chunks.select("id", "text").withColumn("_n", counted_length("text")).where(F.col("_n") > budget), "id", ["_n", "text"])
    cuts = split_chunks(long.select(F.col("_key").alias("id"), F.lit(None).cast("string").alias("section"), "text"), budget, overlap)
    cuts = cuts.select(F.col("item_id").alias("_chunk"), F.col("piece").alias("_part"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    pieces = pieces.withColumn("_chunk", F.when(F.col("chars") > budget, F.col("chunk_ids")[0])).join(cuts, "_chunk", "left")
    # each cut chunk is a piece alone; number the pieces again behind it
    order = F.struct("piece", F.coalesce("_part", F.lit(0)).alias("part"))
    number = F.row_number().over(Window.partitionBy("item_id").orderBy(order)) - 1
    return pieces.select(
        "item_id",
        "section",
        number.alias("piece"),
        "chunk_ids",
        F.coalesce("start", "_start").alias("start"),
        F.coalesce("end", "_end").alias("end"),
        F.coalesce((F.col("_end") - F.col("_start")).cast("long"), "chars").alias("chars"),
    )
