"""A varied subset: determinantal greedy selection with incremental Cholesky updates over composable core-sets.

The kernel is (1 - d / reach)**5 for points at distance d < reach and 0 beyond (positive definite up to nine
dimensions), so a point's gain - the factor by which it raises the determinant of the chosen set - is 1 as long as
nothing chosen is within reach, and falls the better the chosen ones stand for it. Each partition chooses greedily; the
chosen of several partitions are put together and chosen from again, until one task makes the last choice. A task has at
most TASK points and a core-set at most the asked size.

If no reach is given it is scaled to the size: the least step of a ladder of halved extents at which the data occupy no more
than SHARE of the size in cells. Then fewer points than the size are out of each other's reach, so gains fall below 1 and the
rest of the subset goes where what was chosen stands worst for the data: into wide crowds as well as to outliers.

Without a size, points are chosen as long as one of gain 1 is left. A point with no other within reach always has gain 1, so it is
chosen in whatever partition it lies; `alone` then keeps those that no other row comes near, exactly.

Cases: a key that is null, and a vector that is null, of another length or with a null, NaN or infinite number, do not count; of a
repeated key the row of latest version counts (then the smallest vector); copies of one vector are one candidate, with the smallest
key; ties of gain go to the smallest key; an empty table gives an empty result; a size beyond the number of distinct
vectors gives all of them whose gain is not 0 within rounding; a size above a quarter of TASK is refused.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.functions import blocks
from vertexlake.llm.grid import cells_near, dist2, widest
from vertexlake.session import attach, cut

#: Points that one task chooses from.
TASK = 20_000
#: Share of the size that the cells of one reach may number, and how often the extent is halved.
SHARE, STEPS = 0.5, 24


def finite_vector(v: Column, dims: int) -> Column:
    """Whether `v` is `dims` finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dims) & ~bad, F.lit(False))


def latest_vectors(df: DataFrame, key: str, vector: str, dims: int, version: str | None = None) -> DataFrame:
    """(key, v): of each key the row of latest version, if its vector is `dims` finite numbers. -0.0 becomes 0.0.

    The latest row decides alone: if its vector does not count, neither does the key.
    """
    x = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(vector).alias("v"), (F.col(version) if version else F.lit(0)).alias("t"))
    w = Window.partitionBy("key").orderBy(F.col("t").desc_nulls_last(), F.col("v").asc_nulls_last())
    x = x.withColumn("rn", F.row_number().over(w)).filter("rn = 1").filter(finite_vector(F.col("v"), dims))
    return x.select("key", F.transform("v", lambda e: e + F.lit(0.0)).alias("v"))


def greedy(x: np.ndarray, keys: np.ndarray, size: int | None, reach: float, all_free: bool = False, gain_at_least: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Indices and gains in the order chosen. `keys` must ascend.

    Without a size only points of gain 1 are taken; with `all_free` those are taken beyond the size too.
    """
    n = len(x)
    gain = np.ones(n)
    cols: list[tuple[np.ndarray, np.ndarray]] = []  # Cholesky columns, where they are not 0
    chosen: list[int] = []
    gains: list[float] = []
    sq = (x * x).sum(1)
    while len(chosen) < n:
        j = int(np.argmax(gain))  # the first of the largest: the smallest key
        g = gain[j]
        full = size is None or len(chosen) >= size
        if g < (1.0 if full else gain_at_least) or full and size is not None and not all_free:
            break
        chosen.append(j)
        gains.append(float(g))
        d2 = np.maximum(sq + sq[j] - 2.0 * (x @ x[j]), 0.0)
        near = np.nonzero((d2 <= reach * reach * (1 + 1e-9) + 1e-12 * (sq[j] + sq)) & (gain > 0))[0]
        d = np.sqrt(((x[near] - x[j]) ** 2).sum(1))
        e = np.where(d < reach, (1.0 - np.minimum(d, reach) / reach) ** 5, 0.0)
        e[d <= reach] = np.maximum(e[d <= reach], 1e-12)  # at the very edge a point is still within reach
        met = d <= reach
        if g < 1.0:  # a point of gain 1 is 0 in every column before
            for rows, val in cols:
                at = np.searchsorted(rows, j)
                if at < len(rows) and rows[at] == j:
                    to = np.minimum(np.searchsorted(rows, near), len(rows) - 1)
                    e -= val[at] * np.where(rows[to] == near, val[to], 0.0)
        e /= np.sqrt(g)
        cols.append((near, e))
        gain[near] = np.where(met, np.minimum(gain[near] - e * e, np.nextafter(1.0, 0.0)), gain[near] - e * e)
        gain[j] = -1.0
    return np.array(chosen, int), np.array(gains)


def _chooser(size: int | None, reach: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable", ignore_index=True)
        at, gains = greedy(blocks.rows(pdf["v"]), pdf["key"].to_numpy(), size, reach)
        out = pdf.iloc[at][["key", "v"]].copy()
        out["place"] = np.arange(1, len(at) + 1)
        out["gain"] = gains
        return out

    return run


def scaled_reach(vectors: DataFrame, size: int) -> float:
    """The reach for a subset of `size`, from one pass for the extents and one that counts the cells of all steps, both in sketches of fixed size."""
    dims = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        return 1.0
    ends = vectors.agg(*[F.min(F.col("v")[k]) for k in range(dims)], *[F.max(F.col("v")[k]) for k in range(dims)]).first()
    lows, extent = ends[:dims], max(b - a for a, b in zip(ends[:dims], ends[dims:]))
    if extent <= 0:
        return 1.0
    sides = [extent / 2**j for j in range(STEPS)]
    cell = lambda side: F.xxhash64(*[F.floor((F.col("v")[k] - lows[k]) / side) for k in range(dims)])
    n = vectors.agg(*[F.approx_count_distinct(cell(s), 0.02) for s in sides]).first()
    good = [s for s, m in zip(sides, n) if m <= max(1.0, SHARE * size)]
    return min(good, default=extent)


def select(vectors: DataFrame, size: int | None, reach: float | None = None) -> DataFrame:
    """(key, v, place, gain) of the chosen of (key, v).

    Without a size, points are taken while one of gain 1 is left; if those are more than one task holds, they come in the
    core-sets of several tasks, each with its own places.
    """
    if size is not None and 4 * size > TASK:
        raise ValueError(f"the last choice is made in one task of {TASK} points: at most a quarter can be chosen")
    x = cut(vectors.groupBy("v").agg(F.min("key").alias("key")))
    if reach is None:
        reach = scaled_reach(x, size or 1)
    schema = "key string, v array<double>, place int, gain double"
    n, step = x.count(), 0
    while True:
        parts = max(1, -(-n // TASK))
        group = F.pmod(F.xxhash64("key", F.lit(step)), F.lit(parts)).alias("part")
        x = cut(x.select("key", "v", group).groupBy("part").applyInPandas(_chooser(size, reach), schema))
        before, n, step = n, x.count(), step + 1
        if parts == 1 or size is None and n > 0.8 * before:
            return x


#: Axes on which `alone` blocks rows, and the side of a block in reaches.
AXES, SIDE = 4, 2.0


def alone(vectors: DataFrame, chosen: DataFrame, reach: float) -> DataFrame:
    """The rows of `chosen` with no other row of `vectors` within `reach`.

    A chosen row is entered in every block of the grid it comes near, each row of `vectors` in its own block; a block that holds a
    large part of the rows is spread over salts.
    """
    first = vectors.select(F.size("v")).first()
    if first is None:
        return chosen.limit(0)
    dims = first[0]
    axes = widest(vectors, "v", dims, AXES)
    side, half = SIDE * reach, reach * (1 + 1e-9)
    names = [f"b{k}" for k in axes]
    q = chosen.select(F.col("key").alias("q"), F.col("v").alias("w"))
    for name, cells in zip(names, cells_near(F.col("w"), F.col("w"), axes, half, side)):
        q = q.withColumn(name, F.explode(cells))
    rows = vectors.select("key", "v", *[F.floor(F.col("v")[k] / side).alias(f"b{k}") for k in axes])
    met = attach(rows, q, names, ["key"]).filter(F.col("key") != F.col("q"))
    met = met.filter(F.sqrt(dist2(F.col("v"), F.col("w"), dims)) <= reach).select(F.col("q").alias("key")).distinct()
    return chosen.join(met, "key", "left_anti")
