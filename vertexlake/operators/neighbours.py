"""Nearest neighbours and the graph of shared neighbours.

A table of at most BLOCK numbers goes to all tasks, and each compares its rows with it. A larger one never meets the driver: its rows are dealt into
blocks of up to TASK_BLOCKS times that size, every pair of blocks is a task of its own that keeps the best k of each row, and the best of a row's blocks are
ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.functions import blocks, keyed

#: Numbers in a table that is sent to the tasks: 16 MB; and how many times that a task holds of either side.
BLOCK, TASK_BLOCKS = 2_000_000, 8


def _nearest(c: pd.DataFrame, ids: np.ndarray, y: np.ndarray, k: int, dims: int, digits: int) -> Iterator[pd.DataFrame]:
    """(sample_id, neighbour, dist): the k nearest of `ids` (ascending, with vectors y) to each row of c; ties by id."""
    sq = (y * y).sum(1)
    m = min(len(ids), k)
    for a in range(0, len(c) if m else 0, 500):
        own = c["sample_id"].to_numpy()[a : a + 500]
        x = blocks.rows(c["features"].iloc[a : a + 500], dims)
        d2 = (x * x).sum(1)[:, None] + sq[None] - 2 * x @ y.T
        # The farthest of any m, by exact distance, bounds the m-th distance; all within it, with room for rounding, are compared.
        some = np.argpartition(d2, m - 1, 1)[:, :m]
        far = np.sqrt(((x[:, None] - y[some]) ** 2).sum(2)).max(1) + 10.0**-digits
        within = d2 <= (far * far * (1 + 1e-12) + 1e-15 * (dims + 8) * ((x * x).sum(1) + sq.max()))[:, None]
        near, d = np.empty((len(x), m), int), np.empty((len(x), m))
        for i, row in enumerate(within):
            j = np.flatnonzero(row)
            e = np.round(np.sqrt(((x[i] - y[j]) ** 2).sum(1)), digits)
            order = np.lexsort((j, e))[:m]
            near[i], d[i] = j[order], e[order]
        yield pd.DataFrame({"sample_id": np.repeat(own, m), "neighbour": ids[near.ravel()], "dist": d.ravel()})


def knn(samples: DataFrame, k: int = 20, digits: int = 9) -> DataFrame:
    """(sample_id, neighbour, place, dist): the k nearest of all samples to each, itself first; ties by id. Broken vectors take no part.

    Distances are rounded to `digits`. The work grows as the square of the samples; sketch very large tables first.
    """
    from vertexlake.operators.fit import whole_rows

    good, n, dims = whole_rows(samples)
    id_ = dict(samples.dtypes)["sample_id"]
    schema = f"sample_id {id_}, neighbour {id_}, dist double"
    if n * max(dims, 1) <= BLOCK:
        table = good.toPandas().sort_values("sample_id", ignore_index=True)
        ids, y = table["sample_id"].to_numpy(), blocks.rows(table["features"], dims)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield from _nearest(b, ids, y, k, dims, digits)

        best = good.mapInPandas(run, schema)
    else:
        parts = -(-n * dims // (TASK_BLOCKS * BLOCK)) if n * dims > TASK_BLOCKS * BLOCK else 2
        x = good.withColumn("own_", F.floor(keyed.uniform(1, "block", F.col("sample_id")) * parts).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.lit(int(parts) - 1)))
        asked = x.withColumnRenamed("own_", "q_").withColumn("d_", every)
        stock = x.withColumnRenamed("own_", "d_").withColumn("q_", every)

        def pair(c: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            d = d.sort_values("sample_id", ignore_index=True)
            got = list(_nearest(c, d["sample_id"].to_numpy(), blocks.rows(d["features"], dims), k, dims, digits)) if len(c) and len(d) else []
            return pd.concat(got, ignore_index=True) if got else pd.DataFrame({"sample_id": [], "neighbour": [], "dist": []})

        best = asked.groupBy("q_", "d_").cogroup(stock.groupBy("q_", "d_")).applyInPandas(pair, schema)
    w = Window.partitionBy("sample_id").orderBy("dist", "neighbour")  # k rows of each block
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("sample_id", "neighbour", "place", "dist")


def shared_neighbours(near: DataFrame, prune: float = 1 / 15) -> DataFrame:
    """(a, b, weight), a < b: shared neighbours over all neighbours of the two; pairs of less than `prune` are left out.

    A neighbour that very many samples share makes many pairs; k bounds them by n * k * (how often the most shared one occurs).
    """
    k = near.groupBy("sample_id").agg(F.count("*").alias("k"))
    x = near.select(F.col("sample_id").alias("a"), "neighbour")
    y = near.select(F.col("sample_id").alias("b"), "neighbour")
    both = x.join(y, "neighbour").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = both.join(k.withColumnsRenamed({"sample_id": "a", "k": "ka"}), "a").join(k.withColumnsRenamed({"sample_id": "b", "k": "kb"}), "b")
    return both.withColumn("weight", F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared"))).filter(F.col("weight") >= prune).select("a", "b", "weight")
