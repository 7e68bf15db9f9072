"""Projection on principal components without centring, and back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexlake.functions import blocks

#: Up to so many features the feature-by-feature products are summed and solved on the driver (32 MB).
GRAM = 2_000


@dataclass
class Svd:
    """loadings (features x components), singular values, and the scaling that came before."""

    u: np.ndarray
    d: np.ndarray
    means: np.ndarray | None
    sds: np.ndarray | None
    log2: bool
    offset: float


def moments(samples: DataFrame) -> DataFrame:
    """(pos, mean, sd) of each feature, sd with n - 1; nulls take no part."""
    x = samples.select(F.posexplode("features").alias("pos", "v"))
    return x.groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def prepare(features: Column, log2: bool = False, offset: float = 1.0, means: list[float] | None = None, sds: list[float] | None = None) -> Column:
    """log2(x + offset) and (x - mean) / sd of every entry, each if asked; a feature without spread becomes 0."""
    v = F.transform(features, lambda x: F.log2(x + offset)) if log2 else features
    if means is not None:
        mid, sd = F.array(*map(F.lit, means)), F.array(*map(F.lit, sds))
        v = F.zip_with(F.zip_with(v, mid, lambda x, m: x - m), sd, lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0)))
    return v


def gram(samples: DataFrame, dims: int) -> np.ndarray:
    """The sum of x x' over all rows: each partition adds up its own, one row of fixed size for each."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((dims, dims))
        for b in batches:
            x = blocks.rows(b["features"])
            if x.size:
                g += x.T @ x
        yield pd.DataFrame({"i": np.arange(dims), "row": list(g)})

    rows = samples.select("features").mapInPandas(part, "i int, row array<double>")
    total = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((dims, dims))
    out[total["i"], total["j"]] = total["v"]
    return out


def gram_table(samples: DataFrame) -> DataFrame:
    """(i, j, v) of the same sums in columns, for i <= j."""
    x = samples.select("features", F.posexplode("features").alias("i", "a"))
    x = x.select("i", "a", F.posexplode("features").alias("j", "b")).filter("i <= j")
    return x.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def fit_svd(samples: DataFrame, n_dim: int, log2: bool = False, offset: float = 1.0, zscore: bool = False) -> Svd:
    """The first components. The sign of each is fixed: its loading of largest size is positive.

    Rows with a null entry are left out. Beyond GRAM features a distributed solver is used.
    """
    from vertexlake.operators.fit import whole_rows

    good, n, dims = whole_rows(samples)
    x = good.withColumn("features", prepare(F.col("features"), log2, offset))
    means = sds = None
    if zscore:
        m = moments(x).orderBy("pos").toPandas()  # a row for each feature
        means, sds = m["mean"].tolist(), m["sd"].fillna(0.0).tolist()
        x = x.withColumn("features", prepare(F.col("features"), means=means, sds=sds))
    if dims <= GRAM:
        val, vec = np.linalg.eigh(gram(x, dims))
        order = np.argsort(-val)[:n_dim]
        u, d = vec[:, order], np.sqrt(np.maximum(val[order], 0.0))
    else:
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix

        s = RowMatrix(x.select("features").rdd.map(lambda r: Vectors.dense(r[0]))).computeSVD(n_dim)
        u, d = s.V.toArray(), np.array(s.s)
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return Svd(u, d, None if means is None else np.array(means), None if sds is None else np.array(sds), log2, offset)


def to_components(samples: DataFrame, s: Svd) -> DataFrame:
    """(sample_id, features): coordinates on the components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = blocks.rows(b["features"], len(s.u))
            if s.log2:
                x = np.log2(x + s.offset)
            if s.means is not None:
                x = np.divide(x - s.means, s.sds, out=np.zeros_like(x), where=s.sds > 0)
            yield pd.DataFrame({"sample_id": b["sample_id"], "features": list(x @ s.u)})

    good = samples.filter((F.size("features") == len(s.u)) & ~F.exists("features", lambda v: v.isNull()))
    return good.select("sample_id", "features").mapInPandas(run, f"sample_id {dict(samples.dtypes)['sample_id']}, features array<double>")


def from_components(positions: np.ndarray, s: Svd, undo_zscore: bool = False, undo_log2: bool = False) -> np.ndarray:
    """Archetype positions (components x k) in the first features' units again; the same offset is taken off."""
    x = s.u @ positions
    if undo_zscore and s.means is not None:
        x = x * s.sds[:, None] + s.means[:, None]
    return 2.0**x - s.offset if undo_log2 else x
