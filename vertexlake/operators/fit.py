"""Archetype fits of a table: one fit, sweeps over k, bootstrap, permutation tests, k-means and Louvain clusters.

A matrix of at most LOCAL numbers is sent to the tasks once and each (k, replicate) is one task; a larger one is fitted
in passes over the table (`pcha.distributed_fit`), replicate by replicate on keyed samples. Failed fits are rows with
converged = false and take no part in averages. Samples with a null, NaN or infinite entry are left out.

Fit tables: archetypes (method, k, replicate, arch_id, arch_name, position), summary (method, k, replicate, sse, varexpl, hull_vol,
arc_vol, t_ratio, total_var, n_iter, converged). k and replicate are ints; a single fit is replicate 0.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexlake.functions import blocks, keyed, ranks
from vertexlake.operators import geometry, manyfits, pcha
from vertexlake.session import cut

#: Numbers in a matrix that is sent to the tasks: 16 MB.
LOCAL = 2_000_000
ARCHETYPES = "method string, k int, replicate int, arch_id int, arch_name string, position array<double>"
SUMMARY = "method string, k int, replicate int, sse double, varexpl double, hull_vol double, arc_vol double, t_ratio double, total_var double, n_iter int, converged boolean"


@dataclass
class Fits:
    """The tables of one or many fits. Printing shows the summary."""

    archetypes: DataFrame
    summary: DataFrame
    weights: DataFrame | None = None
    coeffs: DataFrame | None = None

    def __str__(self) -> str:
        rows = self.summary.orderBy("k", "replicate").limit(20).toPandas()
        return "archetype fits\n" + rows.to_string(index=False)

    def subset(self, ks: list[int]) -> Fits:
        """Only the fits with k in `ks`."""
        keep = F.col("k").isin(ks)
        own = lambda t: None if t is None else t.filter(keep)
        return Fits(self.archetypes.filter(keep), self.summary.filter(keep), own(self.weights), own(self.coeffs))

    def union(self, *others: Fits) -> Fits:
        """All fits together."""
        out = self
        for o in others:
            both = lambda a, b: a if b is None else b if a is None else a.unionByName(b, allowMissingColumns=True)
            out = Fits(*(both(getattr(out, f), getattr(o, f)) for f in ("archetypes", "summary", "weights", "coeffs")))
        return out


def whole_rows(samples: DataFrame, dims: int | None = None) -> tuple[DataFrame, int, int]:
    """(samples without broken vectors, their number, their dimensions): vectors of `dims` finite numbers.

    If not given, the dimensions are those of most vectors (of equally many the larger), so a few short rows are left out and not
    the others; `left_out` says how many of each size are.
    """
    good = samples.filter(_finite(F.col("features"))).select("sample_id", "features")
    sizes = {r[0]: r[1] for r in good.groupBy(F.size("features")).count().collect()}  # a row for each size of vector
    if dims is None:
        dims = max(sizes, key=lambda d: (sizes[d], d), default=0)
    return good.filter(F.size("features") == dims), sizes.get(dims, 0), dims


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def left_out(samples: DataFrame, dims: int) -> DataFrame:
    """(size, finite, n): the rows that a fit of `dims` dimensions leaves out, by size of vector (null of a null one) and whether all numbers are finite."""
    ok = F.coalesce(_finite(F.col("features")), F.lit(False))
    x = samples.select(F.when(F.col("features").isNotNull(), F.size("features")).alias("size"), ok.alias("finite"))
    return x.filter(~F.col("finite") | ~F.col("size").eqNullSafe(F.lit(dims))).groupBy("size", "finite").agg(F.count("*").alias("n"))


def local_matrix(good: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, dims x samples) of a table already known to be small, in the order of ids."""
    pdf = good.toPandas().sort_values("sample_id", ignore_index=True)
    return pdf["sample_id"].to_numpy(), blocks.rows(pdf["features"]).T


def _keys(seed: int, stream: str, replicate: int, n: int) -> np.ndarray:
    """Random numbers that depend only on their arguments."""
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}|{stream}|{replicate}".encode()).digest()[:8], "big")).random(n)


def goodness(x: np.ndarray, xc: np.ndarray, ratio: str) -> tuple[float, float, float]:
    """(hull volume, archetype volume, ratio): 't_ratio', 'variance_ratio' or 'none'. Not defined: NaN."""
    d, k = xc.shape
    none = float("nan")
    if ratio == "t_ratio" and k > 2 and 2 <= k - 1 <= 8 and d >= k - 1:
        hv, av = geometry.hull(x[: k - 1].T)[0], geometry.simplex_volume(xc)
        return hv, av, av / hv if hv and hv == hv else none
    if ratio == "variance_ratio" and k > 1 and x.shape[1] > 1:
        with np.errstate(invalid="ignore", divide="ignore"):
            return none, none, float(np.nanmean(xc.var(1, ddof=1) / x.var(1, ddof=1)))
    return none, none, none


def kmeans(x: np.ndarray, k: int, seed: int, iter_max: int = 10) -> pcha.Fit:
    """Centres as archetypes; variance explained is between over total sum of squares."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    c = x[:, rng.choice(n, k, replace=False)].copy()
    for r in range(iter_max):
        own = ((x[:, :, None] - c[:, None, :]) ** 2).sum(0).argmin(1)
        new = np.stack([x[:, own == j].mean(1) if (own == j).any() else c[:, j] for j in range(k)], 1)
        if np.allclose(new, c):
            break
        c = new
    own = ((x[:, :, None] - c[:, None, :]) ** 2).sum(0).argmin(1)
    s = np.eye(k)[:, own]
    within, total = float(((x - c[:, own]) ** 2).sum()), float(((x - x.mean(1, keepdims=True)) ** 2).sum()) or 1.0
    cc = s.T / np.maximum(s.sum(1), 1)
    return pcha.Fit(c, s, cc, within, (total - within) / total, r + 1, True)


def louvain_groups(x: np.ndarray, neighbours: int = 20, prune: float = 1 / 15, resolution: float = 1.0, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Communities of the shared-nearest-neighbour graph by local moving and aggregation, within one task."""
    n = x.shape[1]
    kk = min(neighbours, n)
    sq = (x * x).sum(0)
    near = np.argsort(sq[:, None] + sq[None] - 2 * x.T @ x, 1, kind="stable")[:, :kk]
    member = np.zeros((n, n), np.float32)
    np.put_along_axis(member, near, 1.0, 1)
    shared = member @ member.T
    w = shared / (2 * kk - shared)
    w[w < prune] = 0.0
    np.fill_diagonal(w, 0.0)
    w = w.astype(float)
    owner = np.arange(n)
    while True:
        m2 = w.sum() or 1.0
        deg, com = w.sum(1), np.arange(len(w))
        moved_any = False
        for _ in range(rounds):
            moved = False
            for i in np.random.default_rng(seed).permutation(len(w)):
                links = np.bincount(com, w[i], len(w))
                tot = np.bincount(com, deg, len(w))
                links[com[i]] -= w[i, i]
                tot[com[i]] -= deg[i]
                gain = links - resolution * deg[i] * tot / m2
                j = int(np.argmax(gain))
                if gain[j] > gain[com[i]] + 1e-12:
                    com[i], moved, moved_any = j, True, True
            if not moved:
                break
        _, com = np.unique(com, return_inverse=True)
        owner = com[owner]
        if not moved_any or com.max() + 1 == len(w):
            return owner
        h = np.eye(com.max() + 1)[com]
        w = h.T @ w @ h


def louvain(x: np.ndarray, k: int, seed: int, rate: float = 0.2, tries: int = 200, **options) -> pcha.Fit:
    """Mean profiles of k communities; the resolution is moved until there are k. More than 5000 samples are refused."""
    if x.shape[1] > 5000:
        raise ValueError("community detection works on at most 5000 samples; sketch the table first")
    r = options.pop("resolution", 1.0)
    for _ in range(tries):
        own = louvain_groups(x, resolution=r, seed=seed, **options)
        got = int(own.max()) + 1
        if got == k:
            break
        r = abs(r + r * rate * np.log(k / got))
    s = np.eye(got)[:, own]
    cc = s.T / s.sum(1)
    xc = x @ cc
    within, total = float(((x - xc @ s) ** 2).sum()), float(((x - x.mean(1, keepdims=True)) ** 2).sum()) or 1.0
    return pcha.Fit(xc, s, cc, within, (total - within) / total, 1, got == k)


def fit_matrix(x: np.ndarray, k: int, method: str = "pcha", seed: int = 0, order: str = "align", **options) -> pcha.Fit:
    """One fit of a matrix in memory, archetypes in a fixed order."""
    f = {"pcha": pcha.pcha, "kmeans": kmeans, "louvain": louvain}[method](x, k, seed=seed, **options)
    if not np.isfinite(f.xc).all():
        return f
    o = geometry.order_of(f.xc, order)
    return pcha.Fit(f.xc[:, o], None if f.s is None else f.s[o], None if f.c is None else f.c[:, o], f.sse, f.varexpl, f.rounds, f.converged)


def _large_fit(rows: DataFrame, k: int, dims: int, method: str, seed: int, order: str = "align", **options) -> pcha.Fit:
    """One fit of a table in passes over it, archetypes in a fixed order; a method without such a form is refused."""
    if method == "pcha":
        f = pcha.distributed_fit(rows, k, dims, seed, **options)
    elif method == "kmeans":
        f = _large_kmeans(rows, k, seed, **options)
    else:
        raise ValueError(f"{method} has no distributed form; sketch the table first")
    if f.xc.size and np.isfinite(f.xc).all():
        f.xc = f.xc[:, geometry.order_of(f.xc, order)]
    return f


def _large_kmeans(rows: DataFrame, k: int, seed: int, iter_max: int = 10) -> pcha.Fit:
    """`kmeans` of a table of any size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = rows.select(array_to_vector("features").alias("features")).persist()
    m = KMeans(k=k, maxIter=iter_max, seed=seed).fit(x)
    n = x.count()
    x.unpersist()
    xc = np.array(m.clusterCenters(), float).T
    within, total = float(m.summary.trainingCost), float(sum(r.data_var or 0.0 for r in data_variance(rows).collect())) * (n - 1) or 1.0
    return pcha.Fit(xc, None, None, within, (total - within) / total, int(m.summary.numIter), xc.shape[1] == k)


def _nearest(samples: DataFrame, xc: np.ndarray) -> DataFrame:
    """(sample_id, weights): 1 for the centre that is nearest, 0 for the others."""

    def run(batches):
        for b in batches:
            x = blocks.rows(b["features"], xc.shape[0])
            own = ((x[:, :, None] - xc[None]) ** 2).sum(1).argmin(1) if len(b) else np.zeros(0, int)
            yield pd.DataFrame({"sample_id": b["sample_id"], "weights": list(np.eye(xc.shape[1])[own])})

    return samples.select("sample_id", "features").mapInPandas(run, f"sample_id {dict(samples.dtypes)['sample_id']}, weights array<double>")


def _large_goodness(rows: DataFrame, xc: np.ndarray, ratio: str) -> tuple[float, float, float]:
    """`goodness` of a table of any size."""
    d, k = xc.shape
    none = float("nan")
    if not xc.size or not np.isfinite(xc).all():
        return none, none, none
    if ratio == "t_ratio" and k > 2 and 2 <= k - 1 <= 8 and d >= k - 1:
        hv, av = geometry.table_hull(rows, k - 1)[0], geometry.simplex_volume(xc)
        return hv, av, av / hv if hv and hv == hv else none
    if ratio == "variance_ratio" and k > 1:
        v = np.array([none if r.data_var is None else r.data_var for r in data_variance(rows).orderBy("pos").collect()])
        with np.errstate(invalid="ignore", divide="ignore"):
            return none, none, float(np.nanmean(xc.var(1, ddof=1) / v))
    return none, none, none


def _drawn(numbered: DataFrame, n: int, share: float, seed: int, replicate: int, replace: bool) -> DataFrame:
    """round(n * share) rows of a table numbered from 1, with or without replacement."""
    if not replace:
        return resample(numbered, share, seed, replicate)
    u = keyed.uniform(seed, "sample", F.lit(replicate), F.col("id"))
    return numbered.sparkSession.range(int(np.round(n * share))).select((F.floor(u * n) + 1).alias("sample_id")).join(numbered, "sample_id")


def _permuted_rows(numbered: DataFrame, n: int, seed: int, replicate: int, replace: bool) -> DataFrame:
    """The table with each feature permuted by itself, or drawn anew with replacement."""
    from vertexlake.operators.archetypes import permute_features

    long = numbered.select("sample_id", F.posexplode("features").alias("feature", "value"))
    if replace:
        u = keyed.uniform(seed, "permute", F.lit(replicate), F.col("feature"), F.col("sample_id"))
        at = long.select("sample_id", "feature", (F.floor(u * n) + 1).alias("from_"))
        x = at.join(long.withColumnRenamed("sample_id", "from_"), ["from_", "feature"])
    else:
        x = permute_features(long, seed, replicate)
    x = x.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("l"))
    return x.select("sample_id", F.transform("l", lambda e: e["value"]).alias("features"))


def _rows(method: str, k: int, replicate: int, f: pcha.Fit, x: np.ndarray | None, ratio: str, total_var: float = float("nan"), large: tuple[float, float, float] = (float("nan"),) * 3) -> tuple[list, tuple]:
    ok = bool(f.xc.size and np.isfinite(f.xc).all())
    hv, av, t = goodness(x, f.xc, ratio) if ok and x is not None else large
    arch = [(method, k, replicate, j + 1, f"archetype_{j + 1}", [float(v) for v in f.xc[:, j]]) for j in range(f.xc.shape[1])] if ok else []
    none = lambda v: None if v != v else float(v)
    return arch, (method, k, replicate, none(f.sse), none(f.varexpl), none(hv), none(av), none(t), none(total_var), f.rounds, f.converged and ok)


def fit_table(samples: DataFrame, k: int, method: str = "pcha", seed: int = 0, ratio: str = "t_ratio", strategy: str | None = None, **options) -> Fits:
    """One fit with its weights and, of a matrix in memory, its coefficients."""
    spark = samples.sparkSession
    good, n, dims = whole_rows(samples)
    if strategy == "distributed" or strategy is None and n * dims > LOCAL:
        f = _large_fit(good, k, dims, method, seed, **options)
        arch, row = _rows(method, k, 0, f, None, "none", large=_large_goodness(good, f.xc, ratio))
        own = pcha.weights(good, f.xc) if method == "pcha" else _nearest(good, f.xc)
        return Fits(spark.createDataFrame(arch, ARCHETYPES), spark.createDataFrame([row], SUMMARY), own.withColumn("k", F.lit(k)))
    ids, x = local_matrix(good)
    f = fit_matrix(x, k, method, seed, **options)
    arch, row = _rows(method, k, 0, f, x, ratio)
    out = Fits(spark.createDataFrame(arch, ARCHETYPES), spark.createDataFrame([row], SUMMARY))
    if f.s is not None:
        id_ = dict(good.dtypes)["sample_id"]
        rows = lambda m: [(i, k, v) for i, v in zip(ids.tolist(), m.tolist())]
        out.weights = spark.createDataFrame(rows(f.s.T), f"sample_id {id_}, k int, weights array<double>")
        out.coeffs = spark.createDataFrame(rows(f.c), f"sample_id {id_}, k int, coef array<double>")
    return out


def carry_groups(samples: DataFrame, members: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, arch_id) of every whole sample: the group, by (sample_id, weights), of its nearest member; ties by id. The members are few."""
    near = members.select("sample_id", "features").join(weights.select("sample_id", "weights"), "sample_id").toPandas().sort_values("sample_id", ignore_index=True)
    good, _, dims = whole_rows(samples)
    y, group = blocks.rows(near["features"], dims), np.array([int(np.argmax(w)) + 1 for w in near["weights"]], int)

    def run(batches):
        for b in batches:
            for a in range(0, len(b), 500):
                c = b.iloc[a : a + 500]
                x = blocks.rows(c["features"], dims)
                yield pd.DataFrame({"sample_id": c["sample_id"], "arch_id": group[((x[:, None] - y[None]) ** 2).sum(2).argmin(1)]})

    schema = f"sample_id {dict(good.dtypes)['sample_id']}, arch_id int"
    return good.mapInPandas(run, schema) if len(y) else good.select("sample_id", F.lit(1).alias("arch_id")).limit(0)


def k_sweep(samples: DataFrame, ks: list[int], simplex: bool = False, method: str = "pcha", seed: int = 345, ratio: str = "t_ratio", **options) -> Fits:
    """A fit for each k, each in a task; with `simplex` on the first k - 1 dimensions."""
    return _many(samples, [(k, 0) for k in ks], None, False, simplex, method, seed, ratio, False, options)


def bootstrap(samples: DataFrame, ks: list[int], n: int = 10, share: float | None = 0.65, replace: bool = False, method: str = "pcha", seed: int = 235, ratio: str = "t_ratio", simplex: bool = False, **options) -> Fits:
    """n fits of each k on resampled rows, each aligned to the first that converged."""
    return align_replicates(_many(samples, [(k, r) for k in ks for r in range(1, n + 1)], share, replace, simplex, method, seed, ratio, False, options))


def permuted(samples: DataFrame, ks: list[int], n: int = 100, method: str = "pcha", seed: int = 435, ratio: str = "t_ratio", replace: bool = False, bootstrap_n: int = 0, share: float = 0.65, **options) -> Fits:
    """n fits of each k on tables whose every feature is permuted by itself. All k of a replicate see the same permutation.

    With `bootstrap_n` each permuted table is also fitted that often on a `share` of its rows, and total_var tells how far the archetypes vary.
    """
    return _many(samples, [(k, r) for r in range(1, n + 1) for k in ks], None, replace, False, method, seed, ratio, True, options | ({"bootstrap_": (bootstrap_n, share)} if bootstrap_n else {}))


def _total_variance(found: list[np.ndarray], spread: float) -> float:
    """Mean over archetypes of their variance (summed over dimensions) in the aligned fits, over that of the data."""
    good = [x for x in found if x.size and np.isfinite(x).all()]
    good = [x for x in good if x.shape == good[0].shape]
    if len(good) < 2 or not spread > 0:
        return float("nan")
    same = np.stack([good[0], *(x[:, geometry.align(good[0], x)[1]] for x in good[1:])])
    return float(same.var(0, ddof=1).sum(0).mean() / spread)


def _many(samples: DataFrame, tasks: list[tuple[int, int]], share: float | None, replace: bool, simplex: bool, method: str, seed: int, ratio: str, permute: bool, options: dict) -> Fits:
    spark = samples.sparkSession
    options = dict(options)
    times, part = options.pop("bootstrap_", (0, 0.0))
    good, n, dims = whole_rows(samples)
    if n * dims > LOCAL:
        if method == "pcha" and n < manyfits.MOST_ROWS and not set(options) - {"conv", "maxiter", "directions"}:
            return _many_at_once(good, n, dims, tasks, share, replace, simplex, seed, ratio, permute, times, part, options)
        numbered = ranks.numbered(good, [F.col("sample_id"), F.col("features")]).select(F.col("rn").alias("sample_id"), "features")
        parts = []
        for k, r in tasks:
            rows = _permuted_rows(numbered, n, seed, r, replace) if permute else _drawn(numbered, n, share, seed, r, replace) if share is not None and r else numbered
            rows = (rows.withColumn("features", F.slice("features", 1, max(1, k - 1))) if simplex else rows).persist()
            f = _large_fit(rows, k, min(dims, max(1, k - 1)) if simplex else dims, method, seed + r, **options)
            again = [_large_fit(_drawn(rows, n, part, seed, 1_000 * r + i, False), k, dims, method, seed + r + i, **options).xc for i in range(times)]
            spread = sum(v.data_var or 0.0 for v in data_variance(rows).collect()) if times else 0.0
            parts.append(_rows(method, k, r, f, None, "none", _total_variance(again, spread), large=_large_goodness(rows, f.xc, ratio)))
            rows.unpersist()
        return Fits(spark.createDataFrame([a for p, _ in parts for a in p], ARCHETYPES), spark.createDataFrame([s for _, s in parts], SUMMARY))
    matrix = spark.sparkContext.broadcast(local_matrix(good)[1])
    schema = f"{SUMMARY}, positions array<array<double>>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, r in zip(pdf["k"].tolist(), pdf["replicate"].tolist()):
            x = matrix.value
            if permute:
                x = np.stack([row[_pick(_keys(seed, f"permute/{j}", r, x.shape[1]), replace)] for j, row in enumerate(x)]) if x.size else x
            elif share is not None and r:
                m = int(np.round(x.shape[1] * share))
                u = _keys(seed, "sample", r, x.shape[1])
                x = x[:, (u[:m] * x.shape[1]).astype(int) if replace else np.argsort(u, kind="stable")[:m]]
            if simplex:
                x = x[: max(1, k - 1)]
            f = fit_matrix(x, k, method, seed + r, **options)
            again = [fit_matrix(x[:, np.argsort(_keys(seed, "inner", 1_000 * r + i, x.shape[1]), kind="stable")[: int(np.round(x.shape[1] * part))]], k, method, seed + r + i, **options).xc for i in range(times)]
            arch, row = _rows(method, k, r, f, x, ratio, _total_variance(again, float(x.var(1, ddof=1).sum())) if times else float("nan"))
            out.append((*row, [a[-1] for a in arch]))
        return pd.DataFrame(out, columns=["method", "k", "replicate", "sse", "varexpl", "hull_vol", "arc_vol", "t_ratio", "total_var", "n_iter", "converged", "positions"])

    grid = spark.createDataFrame([(k, r, i) for i, (k, r) in enumerate(tasks)], "k int, replicate int, task int").repartition(min(len(tasks), 2000), "task")
    got = cut(grid.groupBy("task").applyInPandas(run, schema))
    arch = got.select("method", "k", "replicate", F.posexplode("positions").alias("p", "position"))
    arch = arch.select("method", "k", "replicate", (F.col("p") + 1).alias("arch_id"), F.concat(F.lit("archetype_"), F.col("p") + 1).alias("arch_name"), "position")
    return Fits(arch, got.drop("positions"))


def _many_at_once(good: DataFrame, n: int, dims: int, tasks: list[tuple[int, int]], share: float | None, replace: bool, simplex: bool, seed: int, ratio: str, permute: bool, times: int, part: float, options: dict) -> Fits:
    """`_many` of a large table by convex hulls: all fits of a table in the same passes, and so many permuted tables as `manyfits.TOGETHER` allows."""
    spark = good.sparkSession
    base, sizes = manyfits.packed(good, n, dims)
    base = base.persist()
    size_of = lambda k: min(dims, max(1, k - 1)) if simplex else dims

    def job(k: int, r: int) -> manyfits.Job:
        j = manyfits.Job(k, seed + r, size_of(k), r if permute else 0, ratio=ratio)
        return _on_draw(j, f"sample/{r}", share, replace) if not permute and share is not None and r else j

    def _on_draw(j: manyfits.Job, stream: str, share: float, replace: bool) -> manyfits.Job:
        j.counts, j.stream, j.replace = manyfits.drawn(sizes, int(np.round(n * share)), seed, stream, replace), f"{seed}/{stream}", replace
        return j

    reps = list(dict.fromkeys(r for _, r in tasks)) if permute else [0]
    groups = -(-len(reps) // max(1, manyfits.TOGETHER // (n * dims))) if permute else 1
    parts: dict[tuple[int, int], tuple] = {}
    for own in np.array_split(reps, groups):
        own = own.tolist()
        now = [t for t in tasks if not permute or t[1] in own]
        table = manyfits.permuted(base, sizes, dims, seed, own, replace).persist() if permute else base
        jobs = [job(k, r) for k, r in now]
        inner = [_on_draw(manyfits.Job(k, seed + r + i, size_of(k), r if permute else 0), f"inner/{1_000 * r + i}", part, False) for k, r in now for i in range(times)]
        got = manyfits.fits(table, jobs + inner, len(sizes), dims, **options)
        spreads = manyfits.spread(table, jobs, dims) if times else [0.0] * len(now)
        for q, (k, r) in enumerate(now):
            f, large = got[q]
            again = [g[0].xc for g in got[len(now) + q * times : len(now) + (q + 1) * times]]
            parts[k, r] = _rows("pcha", k, r, f, None, "none", _total_variance(again, spreads[q]), large=large)
        if permute:
            table.unpersist()
    base.unpersist()
    made = [parts[t] for t in tasks]
    return Fits(spark.createDataFrame([a for p, _ in made for a in p], ARCHETYPES), spark.createDataFrame([s for _, s in made], SUMMARY))


def _pick(u: np.ndarray, replace: bool) -> np.ndarray:
    return (u * len(u)).astype(int) if replace else np.argsort(u, kind="stable")


def align_replicates(fits: Fits) -> Fits:
    """Archetypes of each replicate numbered like those they are nearest to in the first replicate of their k."""
    first = fits.archetypes.groupBy("k").agg(F.min("replicate").alias("first"))
    ref = fits.archetypes.join(F.broadcast(first), "k").filter(F.col("replicate") == F.col("first")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("arch_id", "position"))).alias("ref"))
    own = fits.archetypes.groupBy("method", "k", "replicate").agg(F.sort_array(F.collect_list(F.struct("arch_id", "position"))).alias("own")).join(F.broadcast(ref), "k")

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                mat = lambda v: np.array([list(e["position"]) for e in v], float).T
                a, o = mat(r.ref), mat(r.own)
                order = geometry.align(a, o)[1] if a.shape == o.shape else list(range(o.shape[1]))
                out += [(r.method, r.k, r.replicate, i + 1, f"archetype_{i + 1}", o[:, j].tolist()) for i, j in enumerate(order)]
            yield pd.DataFrame(out, columns=["method", "k", "replicate", "arch_id", "arch_name", "position"])

    return Fits(own.select("method", "k", "replicate", "own", "ref").mapInPandas(run, ARCHETYPES), fits.summary, fits.weights, fits.coeffs)


def average_positions(archetypes: DataFrame) -> DataFrame:
    """(k, arch_id, position): the mean over replicates."""
    x = archetypes.select("k", "arch_id", F.posexplode("position").alias("pos", "v")).groupBy("k", "arch_id", "pos").agg(F.avg("v").alias("v"))
    p = x.groupBy("k", "arch_id").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("l"))
    return p.select("k", "arch_id", F.transform("l", lambda e: e["v"]).alias("position"))


def data_variance(samples: DataFrame) -> DataFrame:
    """(pos, data_var): the variance of each dimension over the samples."""
    return samples.select(F.posexplode("features").alias("pos", "v")).groupBy("pos").agg(F.var_samp("v").alias("data_var"))


def position_variance(archetypes: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, arch_id, var_vert) and (k, total_var): how far replicates of an archetype vary, over the variance of the data."""
    v = archetypes.select("k", "arch_id", F.posexplode("position").alias("pos", "v")).groupBy("k", "arch_id", "pos").agg(F.var_samp("v").alias("v"))
    total = samples.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.var_samp("x").alias("d"))
    vert = v.join(F.broadcast(total), "pos").groupBy("k", "arch_id").agg(F.try_divide(F.sum("v"), F.sum("d")).alias("var_vert"))
    return vert, vert.groupBy("k").agg(F.avg("var_vert").alias("total_var"))


def dimension_variance(archetypes: DataFrame, samples: DataFrame, normalise: bool = True) -> DataFrame:
    """(k, pos, var_dim): the variance of each dimension over archetypes (and replicates), over that of the data."""
    a = archetypes.select("k", F.posexplode("position").alias("pos", "v")).groupBy("k", "pos").agg(F.var_samp("v").alias("v"))
    if not normalise:
        return a.withColumnRenamed("v", "var_dim")
    return a.join(F.broadcast(data_variance(samples)), "pos").select("k", "pos", F.try_divide(F.col("v"), F.col("data_var")).alias("var_dim"))


def variance_ratio(archetypes: DataFrame, samples: DataFrame) -> DataFrame:
    """(k, ratio): the mean of `dimension_variance` over dimensions."""
    return dimension_variance(archetypes, samples).groupBy("k").agg(F.avg("var_dim").alias("ratio"))


def melt_summary(summary: DataFrame, columns: list[str]) -> DataFrame:
    return summary.unpivot(["k", "replicate"], columns, "var_name", "value")


#: Whether an observed value speaks for structure when it is at least, or at most, the permuted one.
AT_MOST = ("total_var",)


def empirical_p(rand: DataFrame, obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rand (k, var_name, repl, var_rand) and obs (k, var_name, var_obs), fully joined: the distribution and (k, var_name, var_obs, p_value).

    p is the share of permutations whose value speaks at least as much for structure, kept within 1/n and 1 - 1/n,
    n being the replicates that are not null. Names without replicates have a null p.
    """
    x = rand.join(obs, ["k", "var_name"], "full")
    flag = F.when(F.col("var_name").isin(*AT_MOST), F.col("var_obs") <= F.col("var_rand")).otherwise(F.col("var_obs") >= F.col("var_rand"))
    w = Window.partitionBy("k", "var_name")
    x = x.withColumn("obs_vs_rand", flag).withColumn("n_", F.count("obs_vs_rand").over(w)).withColumn("p_value", 1 - F.avg(F.col("obs_vs_rand").cast("int")).over(w))
    p = F.when(F.col("n_") == 0, None).otherwise(F.greatest(1 / F.col("n_"), F.least(1 - 1 / F.col("n_"), F.col("p_value"))))
    x = x.withColumn("p_value", p).drop("n_")
    return x, x.select("k", "var_name", "var_obs", "p_value").distinct()


def dimension_significance(observed: DataFrame, rand: DataFrame, samples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As `empirical_p`, of the variance of each dimension over the archetypes: var_name is V1, V2 and so on.

    Both tables are archetypes (k, replicate, arch_id, position); the observed variance is the mean over its replicates. With
    `samples` variances are over those of the data. Dimensions that only one side has stay, with nulls.
    """

    def each(archetypes: DataFrame) -> DataFrame:
        v = archetypes.select("k", "replicate", F.posexplode("position").alias("pos", "v")).groupBy("k", "replicate", "pos").agg(F.var_samp("v").alias("v"))
        if samples is not None:
            v = v.join(F.broadcast(data_variance(samples)), "pos").withColumn("v", F.try_divide("v", "data_var"))  # a row for each dimension
        return v.withColumn("var_name", F.concat(F.lit("V"), F.col("pos") + 1))

    o = each(observed).groupBy("k", "var_name").agg(F.avg("v").alias("var_obs"))
    r = each(rand).select("k", "var_name", F.col("replicate").alias("repl"), F.col("v").alias("var_rand"))
    return empirical_p(r, o)


def significance(samples: DataFrame, observed: Fits, n: int = 100, columns: tuple[str, ...] = ("varexpl", "t_ratio"), **options) -> tuple[DataFrame, DataFrame]:
    """Permutation test of an observed sweep: its distribution and p values."""
    ks = [r.k for r in observed.summary.select("k").distinct().orderBy("k").collect()]  # the ks of a sweep
    rand = permuted(samples, ks, n, **options)
    r = melt_summary(rand.summary.filter("converged"), list(columns)).select("k", "var_name", F.col("replicate").alias("repl"), F.col("value").alias("var_rand"))
    o = melt_summary(observed.summary, list(columns)).groupBy("k", "var_name").agg(F.avg("value").alias("var_obs"))
    return empirical_p(r, o)


def resample(samples: DataFrame, share: float, seed: int = 235, replicate: int = 1) -> DataFrame:
    """round(n * share) samples (half to even) without replacement: those of the least keys."""
    x = samples.withColumn("key_", keyed.uniform(seed, "boot", F.lit(replicate), F.col("sample_id")))
    x = ranks.row_numbers(x, [], "key_", ["sample_id"], "rn_", total="n_")
    return x.filter(F.col("rn_") <= F.bround(F.col("n_") * share, 0)).drop("key_", "rn_", "n_")


def spark_kmeans(samples: DataFrame, k: int, seed: int = 0, starts: int = 1) -> DataFrame:
    """(arch_id, position) of a k-means fit of a table of any size; the best of `starts` seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = samples.select(array_to_vector("features").alias("features")).persist()
    fits = [KMeans(k=k, maxIter=10, seed=seed + i).fit(x) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    x.unpersist()
    spark: SparkSession = samples.sparkSession
    return spark.createDataFrame([(i + 1, [float(v) for v in c]) for i, c in enumerate(best.clusterCenters())], "arch_id int, position array<double>")
