"""Encoding a whole corpus with a public byte-level tokenizer (problem 7).

Content-defined chunk reuse.  A rolling hash over the bytes of each text picks cut places that depend
on the bytes around them alone, so equal passages of different documents fall into equal chunks.  A
worker encodes each distinct chunk once and keeps its ids for all later documents (workers serve many
tasks).  A chunk's inside between its first and its last safe place (a printable ASCII byte followed by
a space or line feed, where the tokenizer's splitting always starts anew) encodes alike in any context.
What lies around a join, from the last safe place before it to the first one behind it, is encoded
again as one string, over several chunks where one has no safe place: both its ends then agree with
their neighbours, so the result equals the encoding of the text in one piece.

``encode_corpus`` needs no shuffle: chunks are shared within a worker, not across workers.
``encode_corpus_shared`` shares them across the cluster, which moves the corpus and its ids over the network;
it pays where most of a corpus repeats.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.tables import Scratch

#: Where the public tokenizers' files are, unless a path is given.
TOKENIZERS = "/opt/tokenizers"
#: How byte-level BPE of this vocabulary splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A cut where the rolling hash ends in so many zero bits: chunks of 2**9 bytes on average.
MASK_BITS = 9
#: Bytes the rolling hash looks at: as many as it has bits.
WINDOW = 16
#: So many bytes are hashed at a time, so that the arrays stay in the processor's cache.
HASH_BYTES = 1 << 17
#: A worker forgets its chunks when they hold more than so many bytes of text.
CACHE_BYTES = 24_000_000

_GEAR = np.random.default_rng(20240229).integers(0, 2**16, 256, dtype=np.uint16)
_encodings: dict[str, ChunkEncoder] = {}


def load_bpe(path: str):
    """tiktoken's encoder of a vocabulary file, without special tokens."""
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def rolling_cuts(data: np.ndarray, mask_bits: int = MASK_BITS) -> np.ndarray:
    """Places p (1..n-1) behind whose last WINDOW bytes a chunk ends; depends on those bytes alone."""
    top = np.uint16(((1 << mask_bits) - 1) << (16 - mask_bits))
    found = []
    for lo in range(0, len(data), HASH_BYTES):
        first = max(0, lo - WINDOW + 1)
        h = _GEAR[data[first : lo + HASH_BYTES]]
        width = 1
        while width < WINDOW:  # h(p) = sum of gear[byte p-k] << k for k < WINDOW
            older = h[:-width] << np.uint16(width)
            h[width:] += older
            width *= 2
        found.append(np.flatnonzero((h[lo - first :] & top) == 0) + (lo + 1))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def safe_places(data: np.ndarray) -> np.ndarray:
    """Places p where byte p-1 is printable ASCII and byte p is a space or line feed."""
    printable = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    blank = (data[1:] == 0x20) | (data[1:] == 0x0A)
    return np.flatnonzero(printable & blank) + 1


class ChunkEncoder:
    """Encodes texts, reusing the ids of chunks seen before."""

    def __init__(self, path: str) -> None:
        self.bpe = load_bpe(path)
        self.known: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.encoded_bytes = 0
        self.total_bytes = 0

    def pieces(self, data: bytes, spans: np.ndarray) -> list[bytes]:
        """Each text's pieces, in order: chunk insides and join strings.

        spans: the texts' ends.  They are ends of pieces too, so no piece reaches into another text.
        """
        a = np.frombuffer(data, np.uint8)
        if not len(a):
            return []
        safe = safe_places(a)
        cuts = np.union1d(rolling_cuts(a), spans)
        # around each cut: the last safe place at or before it, the first one at or behind it
        k = np.searchsorted(safe, cuts, side="right")
        before = np.where(k > 0, safe[np.maximum(k - 1, 0)] if len(safe) else 0, 0)
        k = np.searchsorted(safe, cuts, side="left")
        behind = np.where(k < len(safe), safe[np.minimum(k, len(safe) - 1)] if len(safe) else len(a), len(a))
        ends = np.unique(np.concatenate([before, behind, spans]))
        ends = ends[(ends > 0) & (ends <= len(a))]
        lo = 0
        out = []
        for hi in ends.tolist():
            out.append(data[lo:hi])
            lo = hi
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, and the number of ids of each text."""
        data = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        spans = np.cumsum(sizes)
        self.total_bytes += len(data)
        pieces = self.pieces(data, np.unique(spans))
        known = self.known
        new = list(dict.fromkeys(p for p in pieces if p not in known))
        if new:
            if self.held > CACHE_BYTES:
                known.clear()
                self.held = 0
                new = list(dict.fromkeys(pieces))
            encode = self.bpe.encode_ordinary
            for p in new:
                known[p] = np.array(encode(p.decode()), np.int32)
            size = sum(map(len, new))
            self.held += size
            self.encoded_bytes += size
        ids = [known[p] for p in pieces]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        upto = np.concatenate([[0], np.cumsum(counts)])
        at = upto[np.searchsorted(ends, spans, side="left") + 1] if len(ends) else np.zeros(len(spans), np.int64)
        at = np.where(spans > 0, at, 0)
        return (np.concatenate(ids) if ids else np.empty(0, np.int32)), np.diff(np.concatenate([[0], at]))


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file; it outlives the task."""
    if path not in _encodings:
        _encodings[path] = ChunkEncoder(path)
    return _encodings[path]


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: So many bytes of text are hashed and encoded at a time.
BLOCK_BYTES = 4_000_000


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES together; a longer text is a range of its own."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
) -> DataFrame:
    """(id, text) to (id, ids array<int>), a row per input row, repeated rows included.

    Null and empty texts get an empty list; a null id stays null.  Strings of special tokens are
    ordinary text.  Texts are encoded whole, whatever their length.  Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for lo, hi in blocks(texts):
                ids, counts = enc.encode(texts[lo:hi])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), lists], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def encode_corpus_shared(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
) -> DataFrame:
    """``encode_corpus`` for corpora that repeat: every distinct chunk is encoded once on the whole cluster.

    The same rows come out.  Texts are cut into the same pieces, which are told by a hash of 128 bits, encoded
    once each, and joined back; so the corpus crosses the network once, its distinct pieces and the ids
    once more.  It pays where most bytes lie in passages that many documents share.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    piece = T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("piece", T.BinaryType())])
    cut = T.StructType([T.StructField("id", kind), T.StructField("whole", T.BinaryType()), T.StructField("pieces", T.ArrayType(piece))])
    arrow = pa.list_(pa.struct([("hash", pa.binary()), ("piece", pa.binary())]))

    def digest(data: bytes) -> bytes:
        return hashlib.blake2b(data, digest_size=16).digest()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for lo, hi in blocks(texts):
                found = [[{"hash": digest(p), "piece": p} for p in enc.pieces(t, np.array([len(t)]))] for t in texts[lo:hi]]
                whole = pa.array([digest(t) for t in texts[lo:hi]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), whole, pa.array(found, arrow)], names=["id", "whole", "pieces"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary).bpe
        for batch in batches:
            ids = [bpe.encode_ordinary(p.decode()) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(ids, pa.list_(pa.int32()))], names=["hash", "ids"])

    parts, _ = Scratch(spark).cut(rows.mapInArrow(split, cut))
    distinct = parts.select(F.explode("pieces").alias("p")).groupBy("p.hash").agg(F.first("p.piece").alias("piece"))
    known = distinct.mapInArrow(encode, T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    # repeated rows are one row with its number of copies
    once = parts.groupBy("id", "whole").agg(F.count("*").alias("copies"), F.first(F.transform("pieces", lambda p: p["hash"])).alias("hashes"))
    each = once.select("id", "whole", "copies", F.posexplode_outer("hashes").alias("n", "hash")).join(known, "hash", "left")
    joined = each.groupBy("id", "whole", "copies").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")))).alias("parts"))
    whole = joined.select(F.col("id").alias(id_col), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return whole.select(id_col, "ids")


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
) -> DataFrame:
    """(id, text) to (id, n_tokens); null and empty texts have 0."""
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            counts = [enc.encode(texts[lo:hi])[1] for lo, hi in blocks(texts)]
            n = pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n], names=[id_col, "n_tokens"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(run, schema)
