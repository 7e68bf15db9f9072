"""Many fits of a table too large for a task in the same passes over it: replicates on drawn rows, and on permuted features.

The table is packed into blocks of rows in the order of their numbers. A draw names its rows by how many of each block it takes (on the
driver) and which (in the task), so it is never written. A permutation deals each block's values to all blocks, again by counts made on the
driver, and each block shuffles what it gets: one shuffle of arrays, every order equally likely.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexlake.functions import blocks, ranks
from vertexlake.operators import geometry, pcha

#: Numbers in a block, at least; blocks of a table, at most; rows up to which numpy draws the counts.
NUMBERS, BLOCKS, MOST_ROWS = 2**17, 512, 10**9
#: Numbers of permuted tables that are fitted in the same passes.
TOGETHER = 2**27
#: Samples of a job on which its archetypes settle in memory before the rounds over all samples, which alone decide when a fit is done.
START = 2**14
#: Columns multiplied at a time when extremes are looked for.
CHUNK = 8_192


@dataclass
class Job:
    """One fit: of `table`, of its first `dims` dimensions, on `counts` rows of each block if given. `ratio` as in `fit.goodness`."""

    k: int
    seed: int
    dims: int
    table: int = 0
    counts: np.ndarray | None = None
    stream: str = ""
    replace: bool = False
    ratio: str = "none"


def generator(*ids: object) -> np.random.Generator:
    """Random numbers that depend only on the ids."""
    return np.random.default_rng(int.from_bytes(hashlib.md5("|".join(map(str, ids)).encode()).digest()[:8], "big"))


def packed(good: DataFrame, n: int, dims: int) -> tuple[DataFrame, np.ndarray]:
    """(table_, block, x) of table 0, x the bytes of a matrix of rows x dims in the order of ids; and the rows of each block."""
    size = max(1, NUMBERS // dims, -(-n // BLOCKS))
    sizes = np.full(-(-n // size), size)
    sizes[-1] = n - size * (len(sizes) - 1)
    numbered = ranks.numbered(good, [F.col("sample_id"), F.col("features")])
    x = numbered.select("rn", "features", F.floor((F.col("rn") - 1) / size).cast("int").alias("block"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = blocks.rows(pdf.sort_values("rn")["features"], dims)
        return pd.DataFrame({"table_": [0], "block": [int(pdf["block"].iloc[0])], "x": [x.tobytes()]})

    parts = _partitions(len(sizes))
    return x.repartition(parts, "block").groupBy("block").applyInPandas(pack, "table_ int, block int, x binary"), sizes


def _partitions(n_blocks: int) -> int:
    return max(1, min(n_blocks, max(24, n_blocks // 4)))


def drawn(sizes: np.ndarray, m: int, seed: int, stream: str, replace: bool) -> np.ndarray:
    """How many of m drawn rows are of each block."""
    rng = generator(seed, "counts", stream)
    return rng.multinomial(m, sizes / sizes.sum()) if replace else rng.multivariate_hypergeometric(sizes, m, method="marginals")


def permuted(base: DataFrame, sizes: np.ndarray, dims: int, seed: int, replicates: list[int], replace: bool) -> DataFrame:
    """The packed table with each feature permuted by itself (or drawn anew, with `replace`), once for each replicate, which names the table."""
    nb, sc = len(sizes), base.sparkSession.sparkContext
    deal = np.zeros((len(replicates), dims, nb, nb), np.int32)  # values of a block (third) that go to another (last)
    for a, r in enumerate(replicates):
        for j in range(dims):
            rng = generator(seed, "deal", r, j)
            left = sizes.copy()
            for i in range(nb):
                if replace:
                    deal[a, j, :, i] = rng.multinomial(sizes[i], sizes / sizes.sum())
                else:
                    deal[a, j, i] = rng.multivariate_hypergeometric(left, sizes[i], method="marginals")
                    left -= deal[a, j, i]
    told = sc.broadcast(deal)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, raw in zip(b["block"].tolist(), b["x"]):
                x = np.frombuffer(raw).reshape(-1, dims)
                for a, r in enumerate(replicates):
                    pieces = []
                    for j in range(dims):
                        rng, n = generator(seed, "permute", r, j, i), told.value[a, j, i]
                        at = rng.integers(len(x), size=n.sum()) if replace else rng.permutation(len(x))
                        pieces.append(np.split(x[at, j], np.cumsum(n)[:-1]))
                    yield pd.DataFrame({"table_": r, "block": np.arange(nb), "from_": i, "x": [np.concatenate([p[o] for p in pieces]).tobytes() for o in range(nb)]})

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        r, o = int(pdf["table_"].iloc[0]), int(pdf["block"].iloc[0])
        n = told.value[replicates.index(r), :, :, o]
        pieces: list[list[np.ndarray]] = [[] for _ in range(dims)]
        for i, raw in sorted(zip(pdf["from_"].tolist(), pdf["x"])):
            for j, p in enumerate(np.split(np.frombuffer(raw), np.cumsum(n[:, i])[:-1])):
                pieces[j].append(p)
        x = np.stack([generator(seed, "place", r, j, o).permutation(np.concatenate(p)) for j, p in enumerate(pieces)], 1)
        return pd.DataFrame({"table_": [r], "block": [o], "x": [x.tobytes()]})

    sent = base.mapInPandas(send, "table_ int, block int, from_ int, x binary")
    return sent.repartition(_partitions(nb * len(replicates)), "table_", "block").groupBy("table_", "block").applyInPandas(take, "table_ int, block int, x binary")


# What a pass can be asked for: (kind, argument). Each block of a fit (dims x rows) gives a state; states are merged.


def _sums(x: np.ndarray, xc: np.ndarray) -> np.ndarray:
    s = pcha.nearest_weights(x, xc)
    return np.concatenate([(s @ s.T).ravel(), (x @ s.T).ravel(), [((x - xc @ s) ** 2).sum(), (x * x).sum()]])


def _extremes(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of w the sample of largest product."""
    best, at = np.full(len(w), -np.inf), np.zeros(len(w), int)
    for a in range(0, x.shape[1], CHUNK):
        p = w @ x[:, a : a + CHUNK]
        j = p.argmax(1)
        v = p[np.arange(len(w)), j]
        at, best = np.where(v > best, a + j, at), np.maximum(v, best)
    return best, x[:, at].T.copy()


def _larger(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of two extremes the larger; of equal ones that of the larger sample."""
    second = b[0] > a[0]
    for i in np.flatnonzero(a[0] == b[0]):
        second[i] = tuple(b[1][i]) > tuple(a[1][i])
    return np.where(second, b[0], a[0]), np.where(second[:, None], b[1], a[1])


def _moments(x: np.ndarray, _: object) -> tuple[int, np.ndarray, np.ndarray]:
    m = x.mean(1)
    return x.shape[1], m, ((x - m[:, None]) ** 2).sum(1)


def _both_moments(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


KINDS = {
    "sums": (_sums, lambda a, b: a + b),
    "extremes": (_extremes, _larger),
    "outline": (lambda x, dims: geometry.outline(x[:dims].T), lambda a, b: geometry.outline(np.vstack([a, b]))),
    "moments": (_moments, _both_moments),
    "start": (lambda x, arg: x[:, generator("start", *x.shape).permutation(x.shape[1])[: arg[3]]], lambda a, b: np.hstack([a, b])),
}
#: What a job's merged state becomes in the task.
LAST = {"start": lambda x, arg: pcha.settled(x, *arg[:3])}


def ask(table: DataFrame, jobs: list[Job], asked: dict[int, tuple[str, object]], dims: int) -> dict[int, object]:
    """The answers to what some of the jobs ask, by number of the job, in one pass. States are merged in the tasks, and by job after a shuffle."""
    todo = {q: (jobs[q], *asked[q]) for q in asked}
    told = table.sparkSession.sparkContext.broadcast(todo)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, object] = {}
        for b in batches:
            for t, i, raw in zip(b["table_"].tolist(), b["block"].tolist(), b["x"]):
                x = np.frombuffer(raw).reshape(-1, dims)
                for q, (job, kind, arg) in told.value.items():
                    if job.table != t or job.counts is not None and not job.counts[i]:
                        continue
                    y = x
                    if job.counts is not None:
                        rng = generator(job.stream, "rows", i)
                        y = x[rng.integers(len(x), size=job.counts[i]) if job.replace else rng.permutation(len(x))[: job.counts[i]]]
                    state = KINDS[kind][0](np.ascontiguousarray(y[:, : job.dims].T), arg)
                    found[q] = KINDS[kind][1](found[q], state) if q in found else state
        if found:
            yield pd.DataFrame({"q": list(found), "v": [pickle.dumps(v) for v in found.values()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        q, out = int(pdf["q"].iloc[0]), None
        for v in map(pickle.loads, sorted(pdf["v"])):
            out = v if out is None else KINDS[told.value[q][1]][1](out, v)
        _, kind, arg = told.value[q]
        out = LAST[kind](out, arg) if kind in LAST else out
        return pd.DataFrame({"q": [q], "v": [pickle.dumps(out)]})

    got = table.mapInPandas(run, "q int, v binary")
    if any(kind in ("extremes", "outline", "start") for kind, _ in asked.values()):
        got = got.repartition(4 * len(asked), "q").groupBy("q").applyInPandas(merge, "q int, v binary")
    answers: dict[int, object] = {}
    for r in sorted(got.collect()):  # sums: some hundred bytes for each job and partition
        v = pickle.loads(bytes(r.v))
        answers[r.q] = KINDS[asked[r.q][0]][1](answers[r.q], v) if r.q in answers else v
    told.destroy()
    return answers


def _steps(job: Job, n_blocks: int, conv: float, maxiter: int, directions: int) -> Generator:
    """Asks what a fit and its goodness need, one after another; returns (fit, (hull volume, archetype volume, ratio))."""
    search = pcha.search(job.k, job.dims, job.seed, conv, maxiter, directions)
    answer = None
    while True:
        try:
            kind, arg = search.send(answer)
        except StopIteration as end:
            f = end.value
            break
        if kind == "extremes":
            _, x = yield "extremes", np.vstack([arg, -arg])
            answer = np.unique(x, axis=0).T
        elif kind == "sums":
            v = yield "sums", arg
            k, d = job.k, job.dims
            answer = v[: k * k].reshape(k, k), v[k * k : k * k + k * d].reshape(d, k), float(v[-2]), float(v[-1])
        elif kind == "start":
            answer = yield "start", (*arg, conv / 100, -(-START // n_blocks))
        else:
            v, x = yield "extremes", -arg.T
            answer = -v, x
    none, k = float("nan"), job.k
    if not f.xc.size or not np.isfinite(f.xc).all():
        return f, (none, none, none)
    f.xc = f.xc[:, geometry.order_of(f.xc)]
    if job.ratio == "t_ratio" and k > 2 and k - 1 <= 8 and job.dims >= k - 1:
        hv, av = geometry.hull((yield "outline", k - 1))[0], geometry.simplex_volume(f.xc)
        return f, (hv, av, av / hv if hv and hv == hv else none)
    if job.ratio == "variance_ratio" and k > 1:
        n, _, m2 = yield "moments", None
        with np.errstate(invalid="ignore", divide="ignore"):
            return f, (none, none, float(np.nanmean(f.xc.var(1, ddof=1) / (m2 / (n - 1)))))
    return f, (none, none, none)


def fits(table: DataFrame, jobs: list[Job], n_blocks: int, dims: int, conv: float = 1e-4, maxiter: int = 200, directions: int = 200) -> list[tuple[pcha.Fit, tuple[float, float, float]]]:
    """(fit, goodness) of every job: each pass answers all that the jobs ask next."""
    steps = [_steps(j, n_blocks, conv, maxiter, directions) for j in jobs]
    out: list = [None] * len(jobs)
    answers: dict[int, object] = dict.fromkeys(range(len(jobs)))
    while True:
        asked = {}
        for q, a in answers.items():
            try:
                asked[q] = steps[q].send(a)
            except StopIteration as end:
                out[q] = end.value
        if not asked:
            return out
        answers = ask(table, jobs, asked, dims)


def spread(table: DataFrame, jobs: list[Job], dims: int) -> list[float]:
    """The variance of each job's rows, summed over dimensions."""
    got = ask(table, jobs, {q: ("moments", None) for q in range(len(jobs))}, dims)
    return [float(got[q][2].sum() / (got[q][0] - 1)) for q in range(len(jobs))]
