import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertexlake.llm import markov
from vertexlake.llm.components import components


def brute(keys, x, reach):
    n = len(keys)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= reach
    left, out = set(range(n)), set()
    while left:
        todo, got = [left.pop()], []
        while todo:
            i = todo.pop()
            got.append(i)
            nxt = [j for j in left if near[i, j]]
            left -= set(nxt)
            todo += nxt
        if len(got) > 1:
            first = min(keys[i] for i in got)
            out |= {(first, keys[i], len(got)) for i in got}
    return out


def run(spark, keys, x, dims, reach, space="s"):
    df = spark.createDataFrame([(space, k, [float(v) for v in r]) for k, r in zip(keys, x)], "space string, key string, v array<double>")
    members, typical = markov.cluster(df, dims, reach)
    return {(r.cluster_key, r.member_key, r["size"]) for r in members.collect()}, typical


def test_crowds_chains_copies_and_lone_points(spark):
    rng = np.random.default_rng(0)
    crowd = rng.normal(0, 0.08, (150, 3))
    chain = np.column_stack([np.arange(12) * 0.45 + 5, np.zeros(12), np.zeros(12)])
    copies = np.repeat([[20.0, 0, 0]], 9, 0)
    lone = rng.uniform(30, 90, (20, 3))
    x = np.vstack([crowd, chain, copies, lone, lone[:3] + 0.2])
    keys = [f"k{i:04d}" for i in rng.permutation(len(x))]
    got, typical = run(spark, keys, x, 3, 0.5)
    assert got == brute(keys, x, 0.5)
    t = typical().collect()
    assert {r.cluster_key for r in t} == {c for c, _, _ in got} and all(r.place <= 3 for r in t)
    assert {(r.cluster_key, r.member_key) for r in t} <= {(c, m) for c, m, _ in got}


def test_boxes_that_only_some_members_connect(spark, monkeypatch):
    # Large boxes whose two test members are far apart although others are near.
    rng = np.random.default_rng(4)
    x = np.vstack([rng.uniform(0, 0.28, (60, 2)), rng.uniform(0, 0.28, (60, 2)) + [0.7, 0.0], rng.uniform(0, 0.2, (30, 2)) + [3, 3.55]])
    keys = [f"k{i:03d}" for i in range(len(x))]
    assert run(spark, keys, x, 2, 0.5)[0] == brute(keys, x, 0.5)


def test_empty_and_no_links(spark):
    assert run(spark, [], np.zeros((0, 2)), 2, 0.5)[0] == set()
    assert run(spark, ["a", "b"], np.array([[0.0, 0], [9, 9]]), 2, 0.5)[0] == set()


def test_the_edge_of_reach_counts(spark):
    x = np.array([[0.0, 0], [0.5, 0], [1.0000001, 0]])
    assert run(spark, ["a", "b", "c"], x, 2, 0.5)[0] == {("a", "a", 2), ("a", "b", 2)}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    df = spark.createDataFrame(links, "a int, b int") if links else spark.createDataFrame([], "a int, b int")
    root = {n: n for l in links for n in l}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r.node: r.root for r in components(df).collect()} == {n: find(n) for n in root}


def dense(n, links, reach):
    """Markov clustering on a dense matrix."""
    m = np.eye(n)
    for a, b, d2 in links:
        m[a, b] = m[b, a] = np.exp(-d2 / reach**2)
    m /= m.sum(0)
    for _ in range(40):
        m = (m @ m) ** 2
        m[m < markov.SMALL * m.sum(0)] = 0.0
        m /= m.sum(0)
    return m


def test_flow_is_that_of_the_dense_matrix(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.25, (14, 2)) for c in ((0, 0), (1.2, 0), (9, 9))])
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    links = [(i, j, float(d2[i, j])) for i in range(len(x)) for j in range(i + 1, len(x)) if d2[i, j] <= 0.25]
    df = spark.createDataFrame([(a, b, d, 1, 1) for a, b, d in links], "a bigint, b bigint, d2 double, n_a bigint, n_b bigint")
    got = np.zeros((len(x), len(x)))
    for r in markov.flow(df, 0.5).collect():
        got[r.i, r.j] = r.v
    used = sorted({i for a, b, _ in links for i in (a, b)})
    assert np.allclose(got[np.ix_(used, used)], dense(len(x), links, 0.5)[np.ix_(used, used)], atol=0.02)


def found_by_flow(spark, x, reach):
    keys = [f"k{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([("s", k, [float(v) for v in r]) for k, r in zip(keys, x)], "space string, key string, v array<double>")
    got = {(r.cluster_key, r.member_key, r["size"]) for r in markov.cluster(df, x.shape[1], reach, repair=False)[0].collect()}
    want = brute(keys, x, reach)
    return len(got & want) / len(want)


def test_flow_alone_finds_most_clusters(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.uniform(0, 60, (60, 3))
    x = np.vstack([c + rng.normal(0, 0.12, (1 + i % 6, 3)) for i, c in enumerate(centres)])
    assert found_by_flow(spark, x, 0.5) >= 0.9
    monkeypatch.setattr(markov, "flow", lambda links, reach: links.select(F.explode(F.array("a", "b")).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")))
    assert found_by_flow(spark, x, 0.5) < 0.5


def test_crowded_blocks_become_balls_and_are_spread(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 0.06, (300, 4)), rng.normal(3, 0.3, (200, 4)), rng.uniform(20, 60, (20, 4)), [[0.4, 0, 0, 0]]])
    keys = [f"k{i:04d}" for i in rng.permutation(len(x))]
    want = brute(keys, x, 0.5)
    assert run(spark, keys, x, 4, 0.5)[0] == want
    monkeypatch.setattr(markov, "HOT", 20)
    df = spark.createDataFrame([("s", k, [float(v) for v in r]) for k, r in zip(keys, x)], "space string, key string, v array<double>")
    few, many = markov.nodes_of(df, 4, 0.5)[1].count(), len(x)
    assert few < many / 2
    assert run(spark, keys, x, 4, 0.5)[0] == want


def test_typical_members_are_in_the_middle(spark):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.uniform(0.01, 0.16, (40, 2)), [[0.085, 0.085]], rng.uniform(0, 0.1, (3, 2)) + 40])
    keys = [f"k{i:03d}" for i in range(len(x))]
    t = {(r.cluster_key, r.place): r for r in run(spark, keys, x, 2, 0.5)[1]().collect()}
    assert t["k000", 1].size == 41 and t["k041", 1].size == 3 and ("k041", 3) in t
    mid = x[:41].mean(0)
    best = [keys[i] for i in np.argsort(((x[:41] - mid) ** 2).sum(1))[:3]]
    assert [t["k000", p].member_key for p in (1, 2, 3)] == best
