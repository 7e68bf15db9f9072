"""Tables behind the usual pictures; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.functions import vectors
from vertexlake.operators import geometry


def points(samples: DataFrame, archetypes: DataFrame, dims: list[int]) -> DataFrame:
    """(id, kind, label, x1, x2, ...): samples and archetypes on the chosen dimensions (from 1); archetypes with too few are left out."""
    xs = [F.col("v")[i - 1].alias(f"x{n}") for n, i in enumerate(dims, 1)]
    s = samples.select(F.col("sample_id").cast("string").alias("id"), F.lit("data").alias("kind"), F.lit("data").alias("label"), F.col("features").alias("v"))
    a = archetypes.select(F.col("arch_name").alias("id"), F.lit("archetype").alias("kind"), F.col("arch_name").alias("label"), F.col("position").alias("v"))
    return s.unionByName(a).filter(F.size("v") >= max(dims)).select("id", "kind", "label", *xs)


def lines(archetypes: DataFrame, average: Callable[[Column], Column] = F.avg) -> DataFrame:
    """(a, b, pos, from, to): every pair of archetypes once, each at its average over replicates."""
    m = archetypes.select("arch_id", F.posexplode("position").alias("pos", "v")).groupBy("arch_id", "pos").agg(average(F.col("v")).alias("v"))
    b = m.select(F.col("arch_id").alias("b"), "pos", F.col("v").alias("to"))
    return m.select(F.col("arch_id").alias("a"), "pos", F.col("v").alias("from")).join(b, "pos").filter("a < b").select("a", "b", "pos", "from", "to")


def panels(n: int, spark) -> DataFrame:
    """(x, y): every pair of n dimensions once."""
    return spark.range(1, n + 1).select(F.explode(F.when(F.col("id") < n, F.sequence(F.col("id") + 1, F.lit(n)))).alias("y"), F.col("id").alias("x")).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def by_k(summary: DataFrame, metric: str = "varexpl") -> DataFrame:
    """(k, value, res_value): the metric and what it gains over k - 1; a k without its predecessor keeps its own value."""
    w = Window.orderBy("k")  # a row for each k
    last = F.when(F.lag("k").over(w) == F.col("k") - 1, F.lag(metric).over(w))
    return summary.select("k", F.col(metric).alias("value"), (F.col(metric) - F.coalesce(last, F.lit(0.0))).alias("res_value"))


def structure(archetypes: DataFrame, dist: Callable[[Column, Column], Column] = vectors.distance) -> DataFrame:
    """(a, b, dist, place_a, place_b): distances between archetypes, null on the diagonal, with places in a clustered order."""
    a = archetypes.select(F.col("arch_id").alias("a"), F.col("position").alias("p"))
    d = a.join(a.select(F.col("a").alias("b"), F.col("p").alias("q")), F.size("p") == F.size("q")).select("a", "b", dist(F.col("p"), F.col("q")).alias("dist"))
    pdf = d.toPandas()  # archetypes by archetypes
    ids = sorted(pdf["a"].unique().tolist())
    m = pdf.pivot(index="a", columns="b", values="dist").loc[ids, ids].to_numpy() if ids else np.zeros((0, 0))
    place = {ids[i]: n for n, i in enumerate(geometry.leaf_order(m), 1)}
    at = archetypes.sparkSession.createDataFrame(list(place.items()), "arch_id int, place int")
    d = d.join(at.withColumnsRenamed({"arch_id": "a", "place": "place_a"}), "a").join(at.withColumnsRenamed({"arch_id": "b", "place": "place_b"}), "b")
    return d.withColumn("dist", F.when(F.col("a") != F.col("b"), F.col("dist"))).select("a", "b", "dist", "place_a", "place_b")


def distribution(rand: DataFrame, ks: list[int] | None = None, names: list[str] | None = None) -> DataFrame:
    """The permuted values with a text of observed value and p on the first row of each (k, var_name)."""
    x = rand if ks is None else rand.filter(F.col("k").isin(ks))
    x = x if names is None else x.filter(F.col("var_name").isin(names))
    first = F.row_number().over(Window.partitionBy("k", "var_name").orderBy("repl")) == 1
    text = F.concat(F.lit("p = "), F.format_number("p_value", 3))
    return x.withColumn("text", F.when(first, text).otherwise(F.lit("")))


def embed(samples: DataFrame, archetypes: DataFrame, method: str = "umap", neighbours: int = 15, rounds: int = 200, seed: int = 1, most: int = 5_000) -> DataFrame:
    """(id, kind, x1, x2): samples and archetypes laid out together in two dimensions, near ones near.

    'tsne' keeps neighbour probabilities, 'umap' pulls a neighbour graph together. Works on at most `most` rows in one task; sketch larger tables first.
    """
    p = samples.select(F.col("sample_id").cast("string").alias("id"), F.lit("data").alias("kind"), F.col("features").alias("v"))
    p = p.unionByName(archetypes.select(F.col("arch_name").alias("id"), F.lit("archetype").alias("kind"), F.col("position").alias("v")))
    n = p.count()
    if n > most:
        raise ValueError(f"more than {most} rows; sketch the table first")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "id"], ignore_index=True)
        x = np.array(pdf["v"].tolist(), float)
        y = (_tsne if method == "tsne" else _umap)(x, neighbours, rounds, seed)
        return pd.DataFrame({"id": pdf["id"], "kind": pdf["kind"], "x1": y[:, 0], "x2": y[:, 1]})

    return p.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "id string, kind string, x1 double, x2 double")


def _neighbour_weights(x: np.ndarray, k: int) -> np.ndarray:
    sq = (x * x).sum(1)
    d2 = np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0.0)
    np.fill_diagonal(d2, np.inf)
    k = min(k, len(x) - 1)
    near = np.argsort(d2, 1, kind="stable")[:, :k]
    v = np.sqrt(np.take_along_axis(d2, near, 1))
    w = np.zeros_like(d2)
    np.put_along_axis(w, near, np.exp(-(v - v[:, :1]) / np.maximum(v.mean(1, keepdims=True) - v[:, :1], 1e-9)), 1)
    return w


def _start(x: np.ndarray) -> np.ndarray:
    c = x - x.mean(0)
    u = np.linalg.svd(c, full_matrices=False)
    y = (u[0] * u[1])[:, :2]
    y = y if y.shape[1] == 2 else np.column_stack([y, np.zeros(len(y))])
    return y / max(np.abs(y).max(), 1e-12)


def _tsne(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    if len(x) < 3:
        return np.zeros((len(x), 2))
    w = _neighbour_weights(x, 3 * k)
    p = (w + w.T) / max((w + w.T).sum(), 1e-300)
    y, speed = _start(x) * 1e-2, np.zeros((len(x), 2))
    for r in range(rounds):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(q, 0.0)
        g = ((p * (12 if r < rounds // 4 else 1) - q / q.sum()) * q)
        grad = 4 * (g.sum(1)[:, None] * y - g @ y)
        speed = (0.5 if r < 50 else 0.8) * speed - len(x) / 12 * grad
        y = y + speed
    return y


def _umap(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    if len(x) < 3:
        return np.zeros((len(x), 2))
    w = _neighbour_weights(x, k)
    w = w + w.T - w * w.T
    i, j = np.nonzero(np.triu(w))
    v, y, rng = w[i, j], _start(x) * 10, np.random.default_rng(seed)
    for r in range(rounds):
        rate = 1 - r / rounds
        take = rng.random(len(v)) < v
        a, b = i[take], j[take]
        d = y[a] - y[b]
        step = np.clip(-2 * d / (1 + (d**2).sum(1, keepdims=True)), -4, 4) * rate
        np.add.at(y, a, step)
        np.add.at(y, b, -step)
        for _ in range(3):
            c = rng.integers(len(x), size=len(a))
            d = y[a] - y[c]
            s = (d**2).sum(1, keepdims=True)
            np.add.at(y, a, np.clip(2 * d / ((0.01 + s) * (1 + s)), -4, 4) * rate)
    return y
