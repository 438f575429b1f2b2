"""Vector expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product over the common length; 0 if a side is null or empty."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y)
    return F.when(a.isNull() | b.isNull() | (n < 1), F.lit(0.0)).otherwise(F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def closeness(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), dot(a, b))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def hashed(words: Column, dim: int = 16) -> Column:
    """A unit vector of a list of words, by the first digit of their MD5; stands in where no model's vectors are at hand. No words: null."""
    digits = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 1), 16, 10).cast("int") % dim)
    count = lambda acc, d: F.transform(acc, lambda x, i: x + F.when(i == d, 1.0).otherwise(0.0))
    return F.when(F.size(words) > 0, F.aggregate(digits, F.array_repeat(F.lit(0.0), dim), count, unit))
