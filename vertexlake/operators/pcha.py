"""Principal convex hull analysis (Morup and Hansen, 2012): numeric kernel, and the fit of a table too large for a task.

X (dims x samples) is approximated by X C S with the columns of C and S on the simplex (those of C up to a factor in
1 - delta .. 1 + delta). Variance explained is against the uncentred sum of squares.
"""

from __future__ import annotations

import itertools
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexlake.functions import blocks, keyed


@dataclass
class Fit:
    xc: np.ndarray  # dims x k
    s: np.ndarray | None  # k x samples
    c: np.ndarray | None  # samples x k
    sse: float
    varexpl: float
    rounds: int
    converged: bool


def furthest_sum(x: np.ndarray, k: int, rng: np.random.Generator, exchanges: int = 10) -> list[int]:
    """k samples that are far from each other: one at random, then the furthest in sum, then exchanges."""
    n = x.shape[1]
    picked = [int(rng.integers(n))]
    far = lambda j: np.sqrt(((x - x[:, [j]]) ** 2).sum(0))
    dist = {picked[0]: far(picked[0])}
    for step in range(k - 1 + exchanges):
        if len(picked) == k:
            dist.pop(picked.pop(0))
        total = sum(dist.values()) if dist else np.zeros(n)
        total = total.copy()
        total[picked] = -1.0
        j = int(np.argmax(total))
        picked.append(j)
        dist[j] = far(j)
        if k == 1 and step >= 0:
            break
    return picked[:k]


def _descend(v: np.ndarray, gradient, loss, mu: float, value: float, steps: int) -> tuple[np.ndarray, float, float]:
    """Projected gradient steps on simplex columns, the step grown when the loss falls and halved when it does not."""
    for _ in range(steps):
        g = gradient(v)
        g = g - (g * v).sum(0)
        for _ in range(30):
            new = np.maximum(v - mu * g, 0.0)
            new = new / np.maximum(new.sum(0), 1e-300)
            got = loss(new)
            if got <= value * (1 + 1e-9):
                mu *= 1.2
                break
            mu /= 2
        else:
            return v, value, mu
        v, value = new, got
    return v, value, mu


def pcha(x: np.ndarray, k: int, seed: int = 0, delta: float = 0.0, conv: float = 1e-4, maxiter: int = 500, inner: int = 10, dictionary: list[int] | None = None, targets: list[int] | None = None) -> Fit:
    """Fit k archetypes to x (dims x samples). Fewer samples than k, or values that are not finite, give an unconverged fit of NaN.

    `dictionary` names the samples that archetypes may be made of, `targets` those that are to be explained (all, if not given).
    """
    xi = x if dictionary is None else x[:, dictionary]
    x = x if targets is None else x[:, targets]
    d, n = x.shape
    ni = xi.shape[1]
    if ni < k or n == 0 or not np.isfinite(x).all() or not np.isfinite(xi).all():
        return Fit(np.full((d, k), np.nan), None, None, float("nan"), float("nan"), 0, False)
    rng = np.random.default_rng(seed)
    sst = float((x * x).sum()) or 1.0
    c = np.zeros((ni, k))
    c[furthest_sum(xi, k, rng), np.arange(k)] = 1.0
    alpha = np.ones(k)
    s = -np.log(rng.random((k, n)))
    s /= s.sum(0)
    xc = xi @ c
    state = {"mu_s": 1.0, "mu_c": 1.0, "mu_a": 1.0}

    def s_step(s: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        a = xc * alpha
        gram, cross = a.T @ a, a.T @ x
        loss = lambda z: float(sst - 2 * (cross * z).sum() + ((gram @ z) * z).sum())
        grad = lambda z: (gram @ z - cross) * (n / sst)
        s, v, state["mu_s"] = _descend(s, grad, loss, state["mu_s"], loss(s), steps)
        return s, v

    s, sse = s_step(s, 25)
    rounds, done = 0, False
    while rounds < maxiter:
        rounds += 1
        old = sse
        ss, xs = s @ s.T, x @ s.T
        loss = lambda z: float(sst - 2 * (xs * ((xi @ z) * alpha)).sum() + ((((xi @ z) * alpha) @ ss) * ((xi @ z) * alpha)).sum())  # noqa: B023, E731
        grad = lambda z: (xi.T @ ((((xi @ z) * alpha) @ ss - xs) * alpha)) / sst  # noqa: B023, E731
        c, sse, state["mu_c"] = _descend(c, grad, loss, state["mu_c"], loss(c), inner)
        xc = xi @ c
        if delta > 0:
            for _ in range(inner):
                g = (xc * ((xc * alpha) @ ss - xs)).sum(0) / sst
                new = np.clip(alpha - state["mu_a"] * g, 1 - delta, 1 + delta)
                a = xc * new
                got = float(sst - 2 * (xs * a).sum() + ((a @ ss) * a).sum())
                if got <= sse * (1 + 1e-9):
                    alpha, sse, state["mu_a"] = new, got, state["mu_a"] * 1.2
                else:
                    state["mu_a"] /= 2
        s, sse = s_step(s, inner)
        if abs(old - sse) < conv * abs(sse) or sse < 1e-12 * sst:
            done = True
            break
    sse = max(sse, 0.0)
    return Fit(xc * alpha, s, c * alpha, sse, (sst - sse) / sst, rounds, done)


def simplex_weights(x: np.ndarray, xc: np.ndarray, steps: int = 200) -> np.ndarray:
    """For each column of x the simplex weights of its best combination of archetypes: accelerated projected gradient."""
    k, n = xc.shape[1], x.shape[1]
    gram, cross = xc.T @ xc, xc.T @ x
    lip = max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    s = np.full((k, n), 1.0 / k)
    y, t = s, 1.0
    for _ in range(steps):
        z = y - (gram @ y - cross) / lip
        u = -np.sort(-z, axis=0)
        css = np.cumsum(u, 0) - 1.0
        rho = (u - css / np.arange(1, k + 1)[:, None] > 0).sum(0)
        new = np.maximum(z - css[rho - 1, np.arange(n)] / rho, 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - s)
        moved = np.abs(new - s).max() if n else 0.0
        s, t = new, t2
        if moved < 1e-7:
            break
    return s


def nearest_weights(x: np.ndarray, xc: np.ndarray) -> np.ndarray:
    """`simplex_weights`, for up to 4 archetypes exactly: the best of the feet on all faces of their simplex that lie within the face."""
    k, n = xc.shape[1], x.shape[1]
    if k > 4:
        return simplex_weights(x, xc)
    gram, cross = xc.T @ xc, xc.T @ x
    s, best = np.zeros((k, n)), np.full(n, np.inf)
    for size in range(1, k + 1):
        for face in map(list, itertools.combinations(range(k), size)):
            sides = xc[:, face[1:]] - xc[:, face[:1]]
            lengths = np.linalg.svd(sides, compute_uv=False) if size > 1 else np.ones(1)
            if size - 1 > len(xc) or lengths[-1] <= 1e-9 * lengths[0]:
                continue  # a flat face: its points lie on smaller ones too
            w = np.ones((size, n))
            if size > 1:
                w[1:] = np.linalg.pinv(sides) @ (x - xc[:, face[:1]])
                w[0] -= w[1:].sum(0)
            error = ((gram[np.ix_(face, face)] @ w - 2 * cross[face]) * w).sum(0)
            at = np.flatnonzero((error < best) & (w.min(0) >= 0))
            best[at] = error[at]
            s[:, at] = 0.0
            s[np.ix_(face, at)] = w[:, at]
    return s


def least_squares_weights(x: np.ndarray, xc: np.ndarray) -> np.ndarray:
    """For each column of x the weights of its best combination of archetypes without constraints."""
    return np.linalg.lstsq(xc, x, rcond=None)[0]


def dictionary(samples: DataFrame, w: np.ndarray) -> np.ndarray:
    """Extreme samples (dims x m): those furthest along the directions w (directions x dims), both ways, found in one aggregate.

    Its size is at most twice the number of directions, whatever the number of samples.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[float, list[float]]] = {}
        for b in batches:
            x = blocks.rows(b["features"])
            if not len(x):
                continue
            p = x @ w.T
            for sign, at in ((1, p.argmax(0)), (-1, p.argmin(0))):
                for q, i in enumerate(at):
                    v = sign * float(p[i, q])
                    key = (q + 1) * sign
                    if key not in best or v > best[key][0]:
                        best[key] = (v, x[i].tolist())
        if best:
            yield pd.DataFrame({"q": list(best), "v": [v for v, _ in best.values()], "x": [x for _, x in best.values()]})

    parts = samples.select("features").mapInPandas(partial, "q int, v double, x array<double>")
    rows = parts.groupBy("q").agg(F.max(F.struct("v", "x")).alias("b")).select("b.x").distinct().collect()
    return np.array(sorted(r.x for r in rows), float).reshape(len(rows), w.shape[1]).T


def distributed_fit(samples: DataFrame, k: int, dims: int, seed: int = 0, conv: float = 1e-4, maxiter: int = 200, directions: int = 200) -> Fit:
    """Archetypes of (sample_id, features) of any number: one stateless pass over the table for each outer round.

    A pass solves each row's weights for the present archetypes and returns sums of fixed size for each partition; the
    archetypes are then moved over a dictionary of extreme samples by those sums alone. When they rest, samples of the whole
    table towards which the error still falls join the dictionary. Rows with a null entry are left out.
    """
    good = samples.filter((F.size("features") == dims) & ~F.exists("features", lambda x: x.isNull() | F.isnan(x))).select("features").persist()
    try:
        return _distributed(good, k, dims, seed, conv, maxiter, directions)
    finally:
        good.unpersist()


def _distributed(good: DataFrame, k: int, dims: int, seed: int, conv: float, maxiter: int, directions: int) -> Fit:
    steps = search(k, dims, seed, conv, maxiter, directions)
    answer = None
    while True:
        try:
            kind, arg = steps.send(answer)
        except StopIteration as end:
            return end.value
        if kind == "extremes":
            answer = dictionary(good, arg)
        elif kind == "sums":
            answer = _sums(good, k, dims, arg)
        elif kind == "start":
            answer = arg[1]
        else:
            answer = _missing(good, arg)


def search(k: int, dims: int, seed: int, conv: float, maxiter: int, directions: int) -> Generator:
    """The rounds of a fit, which asks for what only a pass over the samples can tell, and returns the fit. Asked and answered:

    ("extremes", directions x dims): the distinct samples furthest along the directions, both ways (dims x m). ("sums", dims x k): S S', X S', the error
    and the sum of squares, S being the weights for these archetypes. ("start", (dictionary, c)): c, or a better one to start with. ("least", dims x k): the least products of samples and columns, and those samples.
    """
    d = yield "extremes", np.random.default_rng(seed).normal(size=(directions, dims))
    m = d.shape[1]
    if m < k:
        return Fit(np.full((dims, k), np.nan), None, None, float("nan"), float("nan"), 0, False)
    c = np.zeros((m, k))
    c[furthest_sum(d, k, np.random.default_rng(seed)), np.arange(k)] = 1.0
    c = yield "start", (d, c)
    mu, old, rounds, done, sst = 1.0, None, 0, False, 1.0
    while rounds < maxiter:
        rounds += 1
        xc = d @ c
        ss, xs, sse, sst = yield "sums", xc
        sst = sst or 1.0
        if old is not None and abs(old - sse) < conv * sse or sse < 1e-12 * sst:
            new = np.zeros((0, dims))
            if sse >= 1e-12 * sst:
                # Samples outside the dictionary towards which the error still falls: none if moving all archetypes there could not lower it enough.
                slope = xc @ ss - xs
                v, at = yield "least", slope
                if 2 * float((slope * xc).sum() - np.sum(v)) > conv * sse:
                    known = {tuple(v) for v in d.T.tolist()}
                    new = np.array(sorted({tuple(v) for v in np.asarray(at).tolist()} - known), float).reshape(-1, dims)
            if not len(new):
                done = True
                break
            d, c = np.hstack([d, new.T]), np.vstack([c, np.zeros((len(new), k))])
        old = sse
        c, mu = _move(d, c, ss, xs, sst, mu)
    return Fit(d @ c, None, c, sse, (sst - sse) / sst, rounds, done)


def _move(d: np.ndarray, c: np.ndarray, ss: np.ndarray, xs: np.ndarray, sst: float, mu: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """The archetypes d c moved over the dictionary by the sums of a pass, and the next step's length."""
    loss = lambda z: float(sst - 2 * (xs * (d @ z)).sum() + (((d @ z) @ ss) * (d @ z)).sum())
    grad = lambda z: (d.T @ ((d @ z) @ ss - xs)) / sst
    c, _, mu = _descend(c, grad, loss, mu, loss(c), steps)
    return c, mu


def settled(x: np.ndarray, d: np.ndarray, c: np.ndarray, conv: float, maxiter: int = 150) -> np.ndarray:
    """c after rounds on some samples in memory, each carried on a little further (never uphill): where the rounds over all samples may start."""
    mu, sst, ahead, least, best, last, resting = 1.0, float((x * x).sum()) or 1.0, 1, np.inf, c, c, 0
    for _ in range(maxiter):
        xc = d @ c
        s = nearest_weights(x, xc)
        sse = float(((x - xc @ s) ** 2).sum())
        if sse > least:  # too far: back to the best, without carrying on
            c, ahead, least = best, 1, np.inf
            continue
        resting = resting + 1 if least - sse < conv * sse else 0
        if resting == 3 or sse < 1e-12 * sst:
            return c
        least, best = sse, c
        new, mu = _move(d, c, s @ s.T, x @ s.T, sst, mu, 100)
        c = np.maximum(new + (ahead - 1) / (ahead + 2) * (new - last), 0.0)
        c, last, ahead = c / np.maximum(c.sum(0), 1e-300), new, ahead + 1
    return best


def _sums(good: DataFrame, k: int, dims: int, xc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ss, xs, sse, sst = np.zeros((k, k)), np.zeros((dims, k)), 0.0, 0.0
        for b in batches:
            x = blocks.rows(b["features"]).T
            if not x.shape[1] or not len(b):
                continue
            s = simplex_weights(x, xc)
            ss += s @ s.T
            xs += x @ s.T
            sse += float(((x - xc @ s) ** 2).sum())
            sst += float((x * x).sum())
        yield pd.DataFrame({"ss": [ss.ravel().tolist()], "xs": [xs.ravel().tolist()], "sse": [sse], "sst": [sst]})

    got = good.mapInPandas(sums, "ss array<double>, xs array<double>, sse double, sst double").toPandas()  # a row for each partition
    ss = np.sum([np.array(v) for v in got["ss"]], 0).reshape(k, k)
    xs = np.sum([np.array(v) for v in got["xs"]], 0).reshape(dims, k)
    return ss, xs, float(got["sse"].sum()), float(got["sst"].sum())


def _missing(good: DataFrame, slope: np.ndarray) -> tuple[list[float], list[list[float]]]:
    """For each column of `slope` the least product with a sample, and that sample."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = blocks.rows(b["features"])
            if len(b):
                p = x @ slope
                at = p.argmin(0)
                yield pd.DataFrame({"q": np.arange(p.shape[1]), "v": p[at, np.arange(p.shape[1])], "x": [x[i].tolist() for i in at]})

    best = good.mapInPandas(partial, "q int, v double, x array<double>").groupBy("q").agg(F.min(F.struct("v", "x")).alias("b")).select("q", "b.*").collect()
    return [r.v for r in best], [r.x for r in best]


def weights(samples: DataFrame, xc: np.ndarray) -> DataFrame:
    """(sample_id, weights): each sample's simplex weights for the archetypes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = blocks.rows(b["features"]).T
            s = simplex_weights(x, xc) if len(b) else np.zeros((xc.shape[1], 0))
            yield pd.DataFrame({"sample_id": b["sample_id"], "weights": list(s.T)})

    id_ = dict(samples.dtypes)["sample_id"]
    return samples.select("sample_id", "features").mapInPandas(run, f"sample_id {id_}, weights array<double>")


def keyed_share(samples: DataFrame, share: float, seed: int, replicate: int) -> DataFrame:
    """A reproducible sample in which each row stands with probability `share`, without an order of all rows."""
    return samples.filter(keyed.uniform(seed, "share", F.lit(replicate), F.col("sample_id")) < share)
