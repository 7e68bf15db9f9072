"""Smooth curves of features over distance to an archetype, and whether they fall.

A natural cubic regression spline with few knots is fitted under a curvature penalty. The sums X'X, X'y and y'y of each
feature and archetype are built by one aggregate; a task solves the small system, so no task holds the samples.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.session import cut


def spline_parts(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(F, S): second derivatives at the knots from the values there, and the curvature penalty of a natural cubic spline."""
    h = np.diff(knots)
    k = len(knots)
    d, b = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
    for i in range(k - 2):
        d[i, i], d[i, i + 1], d[i, i + 2] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i + 1 < k - 2:
            b[i, i + 1] = b[i + 1, i] = h[i + 1] / 6
    f = np.linalg.solve(b, d)
    return np.vstack([np.zeros(k), f, np.zeros(k)]), d.T @ f


def basis(x: np.ndarray, knots: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The spline's basis (values at the knots) at x; linear beyond the ends."""
    x = np.asarray(x, float)
    c = np.clip(x, knots[0], knots[-1])
    j = np.clip(np.searchsorted(knots, c, "right") - 1, 0, len(knots) - 2)
    h = knots[j + 1] - knots[j]
    lo, hi = (knots[j + 1] - c) / h, (c - knots[j]) / h
    eye = np.eye(len(knots))
    out = lo[:, None] * eye[j] + hi[:, None] * eye[j + 1]
    out += (((lo**3 - lo) * h * h / 6)[:, None]) * f[j] + (((hi**3 - hi) * h * h / 6)[:, None]) * f[j + 1]
    for end, at in ((x < knots[0], 0), (x > knots[-1], len(knots) - 1)):
        if end.any():
            e = 1e-6 * (knots[-1] - knots[0])
            a, b = knots[at], knots[at] + (e if at == 0 else -e)
            slope = (basis(np.array([b]), knots, f) - basis(np.array([a]), knots, f)) / (b - a)
            out[end] = basis(np.array([a]), knots, f) + (x[end] - a)[:, None] * slope
    return out


def solve(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float, penalty: np.ndarray, least: float = 0.0) -> dict:
    """The penalised fit whose smoothing (at least `least` times the scaled penalty) has the least generalised cross-validation score."""
    scale = np.trace(xtx) / max(np.trace(penalty), 1e-300) / max(n, 1.0)
    best: dict = {}
    for lam in np.exp(np.linspace(-6, 14, 41)):
        lam = max(lam, least)
        a = xtx + lam * scale * penalty + 1e-10 * np.trace(xtx) / len(xtx) * np.eye(len(xtx))
        inv = np.linalg.inv(a)
        b = inv @ xty
        edf = float(np.trace(inv @ xtx))
        rss = max(float(yty - 2 * b @ xty + b @ xtx @ b), 0.0)
        gcv = n * rss / max(n - edf, 1e-9) ** 2
        if not best or gcv < best["gcv"] - 1e-15:
            best = {"b": b, "gcv": gcv, "edf": edf, "rss": rss, "cov": inv * rss / max(n - edf, 1e-9)}
    return best


def fit_curves(dist: DataFrame, long: DataFrame, n_smooths: int = 4, n_points: int = 200, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Derivatives (x_name, y_name, x, fit, deriv, deriv_sd, z, prob_neg) on a grid, and summaries (x_name, y_name, smooth_term_p_val, r_sq, min_max_diff).

    dist is (sample_id, arch, dist), long (sample_id, feature, value); nulls take no part. A feature with fewer distinct
    distances than coefficients gives no rows.
    """
    good = dist.filter(F.col("dist").isNotNull() & ~F.isnan("dist"))
    ends = good.agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).first()
    if ends.lo is None or ends.lo == ends.hi:
        raise ValueError("all distances are equal or none is given")
    knots = np.linspace(float(ends.lo), float(ends.hi), n_smooths)
    f, pen = spline_parts(knots)

    def rows(batches):
        for b in batches:
            x = basis(b["dist"].to_numpy(float), knots, f) if len(b) else np.zeros((0, n_smooths))
            yield pd.DataFrame({"sample_id": b["sample_id"], "arch": b["arch"], "x": list(x)})

    x = good.select("sample_id", "arch", "dist").mapInPandas(rows, f"sample_id {dict(dist.dtypes)['sample_id']}, arch string, x array<double>")
    both = x.join(long.filter(F.col("value").isNotNull() & ~F.isnan("value")), "sample_id")
    sums = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(n_smooths) for j in range(i, n_smooths)]
    sums += [F.sum(F.col("x")[i] * F.col("value")).alias(f"c{i}") for i in range(n_smooths)]
    g = both.groupBy("arch", "feature").agg(F.count("*").alias("n"), F.sum("value").alias("sy"), F.sum(F.col("value") * F.col("value")).alias("yy"), *sums)
    grid = np.linspace(knots[0], knots[-1], n_points)
    d = (knots[-1] - knots[0]) / n_points
    b0, b1 = basis(grid, knots, f), basis(grid + d, knots, f)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.n <= n_smooths:
                    continue
                a = np.zeros((n_smooths, n_smooths))
                for i in range(n_smooths):
                    for j in range(i, n_smooths):
                        a[i, j] = a[j, i] = getattr(r, f"g{i}_{j}")
                c = np.array([getattr(r, f"c{i}") for i in range(n_smooths)])
                s = solve(a, c, r.yy, r.n, pen, least)
                slope = (b1 - b0) / d
                dv, sd = slope @ s["b"], np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", slope, s["cov"], slope), 0.0))
                z = np.divide(-dv, sd, out=np.where(dv < 0, 40.0, -40.0), where=sd > 0)
                tss = max(r.yy - r.sy**2 / r.n, 0.0)
                fit = b0 @ s["b"]
                r2 = 1 - s["rss"] / tss if tss > 0 else float("nan")
                df1 = max(s["edf"] - 1, 1e-9)
                stat = ((tss - s["rss"]) / df1) / max(s["rss"] / max(r.n - s["edf"], 1e-9), 1e-300) if tss > 0 else 0.0
                # Wilson-Hilferty: the cube root of F is nearly normal.
                v2 = max(r.n - s["edf"], 1.0)
                q = max(stat, 0.0) ** (1 / 3)
                wz = ((1 - 2 / (9 * v2)) * q - (1 - 2 / (9 * df1))) / math.sqrt(2 / (9 * df1) + q * q * 2 / (9 * v2))
                out.append((r.arch, r.feature, grid.tolist(), fit.tolist(), dv.tolist(), sd.tolist(), z.tolist(), [0.5 * math.erfc(-v / math.sqrt(2)) for v in z], 0.5 * math.erfc(wz / math.sqrt(2)), r2, float(fit[0] - fit[-1])))
            yield pd.DataFrame(out, columns=["x_name", "y_name", "x", "fit", "deriv", "deriv_sd", "z", "prob_neg", "smooth_term_p_val", "r_sq", "min_max_diff"])

    arrays = ", ".join(f"{c} array<double>" for c in ("x", "fit", "deriv", "deriv_sd", "z", "prob_neg"))
    got = g.mapInPandas(run, f"x_name string, y_name string, {arrays}, smooth_term_p_val double, r_sq double, min_max_diff double")
    got = cut(got)
    e = got.select("x_name", "y_name", F.explode(F.arrays_zip("x", "fit", "deriv", "deriv_sd", "z", "prob_neg")).alias("e")).select("x_name", "y_name", "e.*")
    return e, got.select("x_name", "y_name", "smooth_term_p_val", "r_sq", "min_max_diff")


def summarise(derivs: DataFrame) -> DataFrame:
    """(y_name, x_name, p, metric, deriv100, deriv50, deriv20) from (y_name, x_name, x, deriv, prob_neg, weights).

    Derivatives are weighted means over the whole grid, its first half and its first fifth (cut upwards). Four metrics give
    the probability of a fall: the mean and the product along the grid, and both of this archetype but of no other. p is one
    less that probability.
    """
    w = Window.partitionBy("y_name", "x_name")
    x = derivs.withColumn("rn", F.row_number().over(w.orderBy("x"))).withColumn("n", F.count("*").over(w))
    part = lambda share: F.try_divide(F.sum(F.when(F.col("rn") <= F.ceil(F.col("n") * share), F.col("weights") * F.col("deriv"))), F.sum(F.when(F.col("rn") <= F.ceil(F.col("n") * share), F.col("weights"))))
    s = x.groupBy("y_name", "x_name").agg(part(1.0).alias("deriv100"), part(0.5).alias("deriv50"), part(0.2).alias("deriv20"), F.avg("prob_neg").alias("mean_prob"), F.product("prob_neg").alias("prod_prob"))
    others = s.select("y_name", F.col("x_name").alias("other"), F.col("mean_prob").alias("m"), F.col("prod_prob").alias("q"))
    o = s.select("y_name", "x_name").join(others, "y_name").filter("x_name <> other")
    o = o.groupBy("y_name", "x_name").agg(F.avg(1 - F.col("m")).alias("om"), F.product(1 - F.col("q")).alias("oq"))
    s = s.join(o, ["y_name", "x_name"], "left").withColumn("mean_prob_excl", F.col("mean_prob") * F.coalesce("om", F.lit(1.0))).withColumn("prod_prob_excl", F.col("prod_prob") * F.coalesce("oq", F.lit(1.0)))
    long = s.unpivot(["y_name", "x_name", "deriv100", "deriv50", "deriv20"], ["mean_prob", "prod_prob", "mean_prob_excl", "prod_prob_excl"], "metric", "p")
    return long.select("y_name", "x_name", (1 - F.col("p")).alias("p"), "metric", "deriv100", "deriv50", "deriv20")


def find_decreasing(dist: DataFrame, long: DataFrame, **options) -> dict[str, DataFrame]:
    """Derivatives, fits and the summary with the fits' quality; pairs missing on either side stay."""
    derivs, fits = fit_curves(dist, long, **options)
    s = summarise(derivs.withColumn("weights", F.lit(1.0)))
    return {"derivs": derivs, "fits": fits, "summary": s.join(fits, ["y_name", "x_name"], "full")}


def curve_with_points(derivs: DataFrame, dist: DataFrame, long: DataFrame, feature: str, arch: str) -> DataFrame:
    """(kind, x, y): the fitted curve of a feature over distance to an archetype, and the samples' own points."""
    c = derivs.filter((F.col("y_name") == feature) & (F.col("x_name") == arch)).select(F.lit("fit").alias("kind"), "x", F.col("fit").alias("y"))
    p = dist.filter(F.col("arch") == arch).join(long.filter(F.col("feature") == feature), "sample_id").select(F.lit("data").alias("kind"), F.col("dist").alias("x"), F.col("value").alias("y"))
    return c.unionByName(p)


def derivative_band(derivs: DataFrame, width: float = 2.0) -> DataFrame:
    """(x_name, y_name, x, deriv, low, high): derivatives with `width` standard deviations to either side."""
    w = F.lit(width) * F.col("deriv_sd")
    return derivs.select("x_name", "y_name", "x", "deriv", (F.col("deriv") - w).alias("low"), (F.col("deriv") + w).alias("high"))
