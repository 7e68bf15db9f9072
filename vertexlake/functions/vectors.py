"""Column expressions on array<double> features; a null in a vector, or a null vector, gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance. Vectors of unequal length give null."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def first_argmax(v: Column) -> Column:
    """The place (from 1) of the first largest entry."""
    return F.array_position(v, F.array_max(v)).cast("int")


def entropy(p: Column) -> Column:
    """-sum p log2 p over the positive entries."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def determinant(rows: list[list[Column]]) -> Column:
    """Determinant of a small matrix of columns by expansion along the first row."""
    if len(rows) == 1:
        return rows[0][0]
    out = None
    for j, x in enumerate(rows[0]):
        term = x * determinant([[*r[:j], *r[j + 1 :]] for r in rows[1:]])
        out = term if out is None else out + term if j % 2 == 0 else out - term
    return out
