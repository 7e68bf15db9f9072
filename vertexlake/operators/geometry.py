"""Assignment, order, volumes and hulls of archetypes: small numeric work, in tasks or on the driver."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexlake.functions import vectors


def assign(cost: np.ndarray) -> list[int]:
    """For each row the column of the cheapest one-to-one assignment (shortest augmenting paths)."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0, free = owner[j0], ~used
            free[0] = False
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free[1:] & (cur < low[1:])
            low[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.argmin(np.where(free, low, np.inf)))
            step = low[j1]
            u[owner[used]] += step
            v[used] -= step
            low[free] -= step
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def exhaustive(cost: np.ndarray) -> list[int]:
    """The same by trying all orders, for at most ten rows."""
    if len(cost) > 10:
        raise ValueError("too many rows to try all orders")
    return list(min(itertools.permutations(range(len(cost))), key=lambda p: (round(sum(cost[i, j] for i, j in enumerate(p)), 12), p)))


def align(a: np.ndarray, b: np.ndarray, method: str = "assignment") -> tuple[float, list[int]]:
    """(total distance, order): the columns of b in the order that brings them nearest to those of a (dims x k each)."""
    if a.shape != b.shape:
        raise ValueError("archetypes differ in number or dimensions")
    cost = np.sqrt(((a[:, :, None] - b[:, None, :]) ** 2).sum(0))
    order = assign(cost) if method == "assignment" else exhaustive(cost)
    return float(sum(cost[i, j] for i, j in enumerate(order))), order


def order_of(xc: np.ndarray, kind: str = "align") -> np.ndarray:
    """A fixed order of archetypes: by angle to the diagonal ('align', 'cosine'), or by x2 - x1 ('side')."""
    if kind == "side":
        score = -xc[0] + (xc[1] if len(xc) > 1 else 0.0)
    else:
        score = xc.sum(0) / np.sqrt(2 * np.maximum((xc**2).sum(0), 1e-300))
    return np.argsort(score, kind="stable")


def simplex_volume(xc: np.ndarray) -> float:
    """Volume spanned by k archetypes in their first k - 1 dimensions; NaN if there are too few dimensions."""
    k = xc.shape[1]
    if xc.shape[0] < k - 1 or k < 2:
        return float("nan")
    v = xc[: k - 1]
    return abs(float(np.linalg.det(v[:, :-1] - v[:, [-1]]))) / math.factorial(k - 1)


def _facets(points: np.ndarray) -> tuple[dict, np.ndarray, float] | None:
    """(facets, a point inside, the tolerance) of a hull: ids, outward normal and offset by ids. None for flat or too few points."""
    p = np.asarray(points, float)
    n, d = p.shape
    if not 2 <= d <= 8:
        raise ValueError("hulls need 2 to 8 dimensions")
    scale = np.abs(p - p.mean(0)).max() if n else 0.0
    if n <= d or scale == 0:
        return None
    eps = 1e-10 * scale
    base = [int(np.argmin(p[:, 0]))]
    q = p - p[base[0]]
    basis = np.zeros((0, d))
    for _ in range(d):
        rest = q - (q @ basis.T) @ basis
        far = np.sqrt((rest**2).sum(1))
        j = int(np.argmax(far))
        if far[j] <= 1e-9 * scale:
            return None
        base.append(j)
        basis = np.vstack([basis, rest[j] / far[j]])
    inner = p[base].mean(0)

    def facet(ids: tuple[int, ...]) -> tuple[tuple[int, ...], np.ndarray, float]:
        m = p[list(ids)]
        normal = np.linalg.svd(m[1:] - m[0])[2][-1]
        off = float(normal @ m[0])
        if normal @ inner > off:
            normal, off = -normal, -off
        return ids, normal, off

    facets = {tuple(sorted(f)): facet(tuple(sorted(f))) for f in itertools.combinations(base, d)}
    far = np.max(np.stack([p @ f[1] - f[2] for f in facets.values()]), 0)
    for j in np.argsort(-far, kind="stable"):
        if far[j] <= eps:
            break
        seen = [key for key, f in facets.items() if f[1] @ p[j] - f[2] > eps]
        if not seen:
            continue
        edges: dict[tuple[int, ...], int] = {}
        for key in seen:
            for e in itertools.combinations(key, d - 1):
                edges[e] = edges.get(e, 0) + 1
            del facets[key]
        for e, times in edges.items():
            if times == 1:
                ids = tuple(sorted((*e, int(j))))
                facets[ids] = facet(ids)
    return facets, inner, eps


def hull(points: np.ndarray) -> tuple[float, float, list[int]]:
    """(volume, area, vertices) of the convex hull of points (n x dims, 2 to 8 dims) by incremental facets.

    Flat or too few points give (NaN, NaN, []).
    """
    p = np.asarray(points, float)
    d = p.shape[1]
    got = _facets(p)
    if got is None:
        return float("nan"), float("nan"), []
    facets, inner, _ = got
    volume = area = 0.0
    for ids, normal, off in facets.values():
        m = p[list(ids)]
        side = m[1:] - m[0]
        face = math.sqrt(max(float(np.linalg.det(side @ side.T)), 0.0)) / math.factorial(d - 1)
        area += face
        volume += face * (off - float(normal @ inner)) / d
    return volume, area, sorted({i for f in facets for i in f})


def outline(points: np.ndarray) -> np.ndarray:
    """The rows of points (n x dims) that are vertices of their hull; of flat points the distinct ones, as they may be vertices among others.

    Points within the hull of some extreme ones are left out first.
    """
    p = np.asarray(points, float)
    n, d = p.shape
    if n > 200 and d <= 4:
        w = np.random.default_rng(0).normal(size=(32, d))
        v = p @ w.T
        start = np.unique(np.concatenate([v.argmax(0), v.argmin(0)]))
        got = _facets(p[start])
        if got is not None:
            out = np.zeros(n, bool)
            for _, normal, off in got[0].values():
                out |= p @ normal - off > 0
            out[start] = True
            p = p[out]
    at = hull(p)[2] if len(p) > d + 1 else []
    return p[at] if at else np.unique(p, axis=0)


#: Points of a partition that are put into one hull at a time.
HULL_BATCH = 50_000


def table_hull(samples: DataFrame, dims: int) -> tuple[float, float, list]:
    """(volume, area, sample ids) of the hull of a table in its first `dims` dimensions: hulls of the partitions, then the hull of their vertices.

    A partition is worked through in batches, each joined with the vertices found so far, so it is never held whole; rows
    inside never leave the executors. Rows that are null, too short or not finite in these dimensions take no part.
    """
    id_ = dict(samples.dtypes)["sample_id"]

    def part(batches):
        import pandas as pd

        kept = pd.DataFrame({"sample_id": [], "features": []})
        waiting, n = [], 0

        def fold() -> pd.DataFrame:
            pdf = pd.concat([x for x in (kept, *waiting) if len(x)], ignore_index=True) if any(len(x) for x in (kept, *waiting)) else kept
            x = np.array(pdf["features"].tolist(), float).reshape(len(pdf), dims)
            at = hull(x)[2] if len(x) > dims + 1 else []
            # Flat points have no hull of these dimensions yet: their distinct ones stay.
            return pdf.iloc[at] if at else pdf.assign(f=pdf["features"].map(tuple)).drop_duplicates("f").drop(columns="f")

        for b in batches:
            waiting.append(b)
            n += len(b)
            if n >= HULL_BATCH:
                kept, waiting, n = fold(), [], 0
        kept = fold()
        if len(kept):
            yield kept

    first = F.slice("features", 1, dims)
    ok = (F.size("features") >= dims) & ~F.exists(first, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = samples.filter(F.coalesce(ok, F.lit(False))).select("sample_id", first.alias("features"))
    rows = rows.mapInPandas(part, f"sample_id {id_}, features array<double>").toPandas().sort_values("sample_id", ignore_index=True)
    if not len(rows):
        return float("nan"), float("nan"), []
    volume, area, at = hull(np.array(rows["features"].tolist(), float))
    return volume, area, rows["sample_id"].iloc[at].tolist()


def volume_k3(archetypes: DataFrame, by: list[str]) -> DataFrame:
    """(by, volume) of triangles of archetypes (by, arch_id 1..3, position) in the first two dimensions, as an expression."""
    at = lambda i, d: F.max(F.when(F.col("arch_id") == i, F.col("position")[d]))
    x = archetypes.groupBy(*by).agg(*[at(i, d).alias(f"x{i}{d}") for i in (1, 2, 3) for d in (0, 1)])
    m = [[F.col(f"x{i}{d}") - F.col(f"x3{d}") for i in (1, 2)] for d in (0, 1)]
    return x.select(*by, (F.abs(vectors.determinant(m)) / 2).alias("volume"))


def leaf_order(dist: np.ndarray) -> list[int]:
    """The order of leaves of a complete-linkage tree; ties join the lowest numbers first."""
    groups = [[i] for i in range(len(dist))]
    while len(groups) > 1:
        best = min(
            ((max(dist[i, j] for i in a for j in b), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y),
        )
        _, x, y = best
        groups[x] = groups[x] + groups.pop(y)
    return groups[0] if groups else []
