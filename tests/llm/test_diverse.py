import numpy as np

from vertexlake.llm import diverse


def kernel(x, reach):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return np.where(d < reach, (1 - np.minimum(d, reach) / reach) ** 5, 0.0)


def test_greedy_is_determinant_greedy():
    rng = np.random.default_rng(1)
    x = np.unique(rng.uniform(0, 4, (40, 2)), axis=0)
    k = kernel(x, 3.0)
    at, gains = diverse.greedy(x, np.arange(len(x)), 12, 3.0, False)
    chosen = []
    for j, g in zip(at, gains):
        base = np.linalg.det(k[np.ix_(chosen, chosen)]) if chosen else 1.0
        rise = [np.linalg.det(k[np.ix_([*chosen, i], [*chosen, i])]) / base if i not in chosen else -1 for i in range(len(x))]
        assert np.isclose(max(rise), g, atol=1e-8) and np.isclose(rise[j], g, atol=1e-8)
        chosen.append(int(j))


def frame(spark, x, keys=None):
    keys = keys or [f"k{i:04d}" for i in range(len(x))]
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in zip(keys, x)], "key string, v array<double>")


def test_lone_points_are_found_whatever_the_partition(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.5, (300, 2)), rng.uniform(5, 60, (60, 2)), [[100.0, 100.0], [100.0, 100.0]]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {f"k{i:04d}" for i in np.nonzero(d.min(1) > 4.0)[0]}
    for task in (20_000, 40):
        monkeypatch.setattr(diverse, "TASK", task)
        df = frame(spark, x)
        assert {r.key for r in diverse.alone(df, diverse.select(df, None, 4.0), 4.0).collect()} == want


def test_the_crowd_does_not_fill_the_subset(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.1, (500, 2)), rng.uniform(-20, 20, (30, 2))])
    monkeypatch.setattr(diverse, "TASK", 100)
    got = {r.key for r in diverse.select(frame(spark, x), 25, 5.0).collect()}
    assert len(got) == 25 and sum(k >= "k0500" for k in got) >= 18


def test_sizes_ties_and_empty(spark):
    x = [[0.0, 0.0]] * 5 + [[9.0, 0.0]]
    got = sorted((r.place, r.key) for r in diverse.select(frame(spark, x), 10, 2.0).collect())
    assert got == [(1, "k0000"), (2, "k0005")]
    assert diverse.select(frame(spark, x).limit(0), 3, 2.0).count() == 0
    e = frame(spark, x).limit(0)
    assert diverse.alone(e, diverse.select(e, None, 2.0), 2.0).count() == 0


def test_only_the_latest_whole_vector_counts(spark):
    rows = [("a", [1.0, 2.0], 1, 0), ("a", [3.0, 4.0], 2, 0), ("b", [1.0, None], 1, 0), ("c", [1.0, float("nan")], 1, 0), ("d", [1.0], 1, 0), ("e", None, 1, 0), (None, [1.0, 1.0], 1, 0), ("f", [-0.0, 1.0], None, 0), ("g", [1.0, 1.0], 1, 0), ("g", [1.0, None], 2, 0)]
    df = spark.createDataFrame(rows, "sample_id string, features array<double>, t int, v int")
    got = {r.key: r.v for r in diverse.latest_vectors(df, "sample_id", "features", 2, "t").collect()}
    assert got == {"a": [3.0, 4.0], "f": [0.0, 1.0]}


def test_the_subset_covers_crowds_and_outliers(spark):
    rng = np.random.default_rng(6)
    centres = rng.uniform(-60, 60, (8, 2))
    crowds = np.vstack([c + rng.normal(0, 3, (400 * (i + 1), 2)) for i, c in enumerate(centres)])
    x = np.vstack([crowds, rng.uniform(-200, 200, (25, 2))])
    of = np.append(np.repeat(np.arange(8), [400 * (i + 1) for i in range(8)]), [-1] * 25)
    size = 60
    got = diverse.select(frame(spark, x), size).collect()
    at = [int(r.key[1:]) for r in got]
    assert len(at) == size and 0 < sum(r.gain < 0.999 for r in got) < size
    share = [sum(of[i] == c for i in at) for c in range(8)]
    assert min(share) >= 1 and max(share) <= size / 4  # a crowd eight times as large does not take eight times as much
    radius = lambda ids: np.sqrt(((x[:, None] - x[None, ids]) ** 2).sum(2)).min(1).max()
    # A subset at random leaves outliers far away; the best known way to cover (farthest first) is at most twice the optimum.
    far = [0]
    while len(far) < size:
        far.append(int(np.sqrt(((x[:, None] - x[None, far]) ** 2).sum(2)).min(1).argmax()))
    assert radius(at) <= 3 * radius(far) < radius(rng.choice(len(x), size, replace=False))


def test_reach_follows_the_size_and_odd_tables(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, rng.uniform(0, 100, (2000, 2)))
    small, large = diverse.scaled_reach(df, 10), diverse.scaled_reach(df, 200)
    assert small > large > 0
    assert diverse.scaled_reach(df.limit(0), 10) == 1.0 and diverse.scaled_reach(frame(spark, [[1.0, 2.0]] * 3), 10) == 1.0
    assert diverse.select(df.limit(0), 5).count() == 0


def test_a_crowded_block_is_spread(spark, monkeypatch):
    from vertexlake import session

    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 0.1, (400, 3)), [[3.0, 0.0, 0.0], [9.0, 9.0, 9.0]]])
    df = frame(spark, x)
    monkeypatch.setattr(session.attach, "__defaults__", (*session.attach.__defaults__[:-1], 0))  # as if the chosen were too many to broadcast
    assert {r.key for r in diverse.alone(df, diverse.select(df, None, 2.0), 2.0).collect()} == {"k0400", "k0401"}
