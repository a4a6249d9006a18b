"""Offline embeddings: hashed words and character trigrams, and cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import let, norm

DIM = 128


def _bucket(token: Column) -> Column:
    """FNV-style hash modulo 128; only its low seven bits matter, and they follow from themselves."""
    letters = F.transform(F.sequence(F.lit(1), F.length(token)), lambda k: F.ascii(F.substring(token, k, F.lit(1))))
    return F.aggregate(letters, F.lit(69), lambda h, c: (h.bitwiseXOR(c) * 19).bitwiseAND(127))


def ngram_vector(text: Column) -> Column:
    """128 counts of hashed words and trigrams, scaled to length 1; zeros for an empty or null text."""
    plain = F.regexp_replace(norm(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    trigrams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3)))
    tokens = let(words, lambda ws: F.concat(ws, F.flatten(F.transform(F.filter(ws, lambda w: F.length(w) >= 3), trigrams))))
    places = F.sequence(F.lit(0), F.lit(DIM - 1))
    count = lambda bs: F.transform(places, lambda p: F.size(F.filter(bs, lambda x: x == p)).cast("double"))
    counts = let(F.transform(tokens, _bucket), count)
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda c: let(length(c), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c))
    return let(counts, scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; 0 for an empty, null or zero vector, or for different lengths."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    clamp = lambda x: F.when(x > 1, 1.0).when(x < -1, -1.0).otherwise(x)  # noqa: E731  (least and greatest skip nulls)
    value = let(dot(a, b) / F.when(lengths > 0, lengths), clamp)
    return F.coalesce(F.when(F.size(a) == F.size(b), value), F.lit(0.0))
