"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its norm; a zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return 1 - dot(a, b)


def hashed_embedding(words: Column, dims: int = 384) -> Column:
    """A unit vector of a bag of words, each word hashed to a place: what stands in for a model where there is none."""
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    return unit(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double")))
