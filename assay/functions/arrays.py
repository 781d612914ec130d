"""Expressions over arrays of numbers, free of user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def others_max(values: Column, index: Column) -> Column:
    """Largest element at any other place than the 0-based index."""
    return F.array_max(F.filter(values, lambda v, i: i != index))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def unit_hash(seed: Column | int, index: Column, salt: str = "") -> Column:
    """A number in [0, 1) that depends on seed, index and salt only: the first 32 bits of an MD5 digest."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat_ws(":", seed.cast("string"), index.cast("string"), *([F.lit(salt)] if salt else []))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def finite(value: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None)).otherwise(value)
