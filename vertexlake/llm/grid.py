"""Vectors on a grid: distances as compiled arithmetic, and the axes and cells on which near vectors meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dist2(a: Column, b: Column, dims: int) -> Column:
    """The squared distance of two vectors of `dims` numbers."""
    out = None
    for k in range(dims):
        d = (a[k] - b[k]) * (a[k] - b[k])
        out = d if out is None else out + d
    return F.lit(0.0) if out is None else out


def gap2(alo: Column, ahi: Column, blo: Column, bhi: Column, dims: int) -> Column:
    """The square of the least distance of two boxes."""
    out = None
    for k in range(dims):
        g = F.greatest(blo[k] - ahi[k], alo[k] - bhi[k], F.lit(0.0))
        out = g * g if out is None else out + g * g
    return F.lit(0.0) if out is None else out


def widest(df: DataFrame, vector: str, dims: int, n: int) -> list[int]:
    """The n axes along which vectors spread most."""
    spread = df.agg(F.count("*"), *[F.stddev(F.col(vector)[k]) for k in range(dims)]).first()
    return sorted(range(dims), key=lambda k: -(spread[k + 1] or 0.0))[:n]


def cells_near(lo: Column, hi: Column, axes: list[int], half: float, side: float) -> list[Column]:
    """For each axis the cells of `side` that the stretch lo - half .. hi + half meets, to be exploded."""
    return [F.sequence(F.floor((lo[k] - half) / side), F.floor((hi[k] + half) / side)) for k in axes]
