"""Samples nearest each archetype, and bins of equal counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexlake.functions.ranks import row_numbers


def bins_by_share(dist: DataFrame, share: float = 0.1) -> DataFrame:
    """(arch, sample_id): the round(n * share) nearest samples of each archetype (half to even), ties by sample. A share outside 0..1 is an error."""
    if not 0 <= share <= 1:
        raise ValueError("a share is between 0 and 1")
    x = row_numbers(dist, ["arch"], "dist", ["sample_id"], total="n")
    return x.filter(F.col("rn") <= F.bround(F.col("n") * share, 0)).select("arch", "sample_id")


def bins_by_cutoff(dist: DataFrame, cutoff: float) -> DataFrame:
    """(arch, sample_id): all samples nearer than the cutoff; an archetype may have none."""
    return dist.filter(F.col("dist") < cutoff).select("arch", "sample_id")


def equal_bins(df: DataFrame, by: list[str], value: str, ties: list[str | Column], n_bins: int) -> DataFrame:
    """`bin`: 1..n_bins by rank, each of round(n / n_bins) rows (half to even); the last takes what is left."""
    each = F.greatest(F.lit(1.0), F.bround(F.col("n_") / n_bins, 0))
    x = row_numbers(df, by, value, ties, out="rn_", total="n_")
    return x.withColumn("bin", F.least(F.lit(n_bins), F.ceil(F.col("rn_") / each)).cast("int")).drop("rn_", "n_")


def choose_bins(binned: DataFrame, select: list[int] | None = None, combine: list[int] | None = None) -> DataFrame:
    """Only the bins in `select`; each bin renamed to the entry of `combine` at its place."""
    x = binned if select is None else binned.filter(F.col("bin").isin(select))
    return x if combine is None else x.withColumn("bin", F.get(F.array(*map(F.lit, combine)), F.col("bin") - 1))
