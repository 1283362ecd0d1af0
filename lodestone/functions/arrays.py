"""Column expressions on numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import col


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm2(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def norm1(v: Column) -> Column:
    return total(F.transform(v, lambda x: F.abs(x)))


def distance2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def distance1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or zero norm."""
    scale = norm2(a) * norm2(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def normalized(v: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    n = norm2(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
