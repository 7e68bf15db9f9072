import math

import numpy as np

from vertexlake.llm import percentiles as P

Q = [0.0, 0.1, 0.5, 0.95, 1.0]


def brute(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(q * len(v))) - 1]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, label string, distance double, g string, c int, i int, own int")


def sample():
    rng = np.random.default_rng(0)
    rows = [(k, "hot" if k % 3 == 0 else f"l{k % 7}", float(v), "x", 1, 2, 3) for k, v in enumerate(rng.lognormal(0, 3, 3000))]
    rows += [(3000 + k, "ties", float(k % 3), "x", 1, 2, 3) for k in range(100)]
    return rows


def test_exact_and_bounded(spark):
    rows = sample()
    bad = [(9000, "hot", x, "x", 1, 2, 3) for x in (None, float("nan"), float("inf"), -1.0)] + [(9001, None, 1.0, "x", 1, 2, 3)]
    again = rows[:500]
    u = P.usable(frame(spark, rows + bad + again), "label", "distance", "id")
    by = {}
    for _, l, v, *_ in rows:
        by.setdefault(l, []).append(v)
    exact = P.bisect(u, Q).collect()
    assert len(exact) == len(by) * len(Q)
    for r in exact:
        assert r.value == brute(by[r.g], r.fraction) and r.n == len(by[r.g])
    for r in P.bisect(u, Q, bits=10).collect():
        assert abs(r.value - brute(by[r.g], r.fraction)) <= brute(by[r.g], r.fraction) * 2.0**-10


def test_extremes_of_the_number_range(spark):
    rows = [(k, "a", v, "", 0, 0, 0) for k, v in enumerate([-0.0, 0.0, 5e-324, 1e-310, 1.0, 1.7976931348623157e308])]
    got = {r.fraction: r.value for r in P.bisect(P.usable(frame(spark, rows), "label", "distance", "id"), [0.1, 0.5, 0.6, 1.0]).collect()}
    assert got == {0.1: 0.0, 0.5: 5e-324, 0.6: 1e-310, 1.0: 1.7976931348623157e308}


def test_empty_null_ids_and_single_rows(spark):
    e = frame(spark, []).limit(0)
    assert P.bisect(P.usable(e, "label", "distance", "id"), Q).count() == 0
    assert P.percentiles_of_cells(P.cells(P.usable(e, "label", "distance", "id")), Q).count() == 0
    rows = [(None, "a", 1.0, "", 0, 0, 0)] * 3 + [(1, "a", 5.0, "", 0, 0, 0)] * 3
    got = P.bisect(P.usable(frame(spark, rows), "label", "distance", "id"), [0.5]).collect()
    assert [(r.n, r.value) for r in got] == [(4, 1.0)]


def test_loads_put_together_give_the_whole(spark):
    rows = sample()
    u = P.usable(frame(spark, rows), "label", "distance")
    a, b = u.filter("c % 2 = 0"), u.filter("c % 2 <> 0")
    whole, parts = P.cells(u), P.merge_cells(P.cells(a), P.cells(b))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
    exact = {(r.g, r.fraction): r.value for r in P.bisect(u, Q).collect()}
    for r in P.percentiles_of_cells(parts, Q).collect():
        assert abs(r.value - exact[r.g, r.fraction]) <= exact[r.g, r.fraction] * 2.0**-8 + 1e-300


def test_large_state_takes_the_salted_join(spark, monkeypatch):
    import vertexlake.llm.percentiles as M

    monkeypatch.setattr(M, "attach", lambda rows, state, on, salt_by, how="inner", salts=4, limit=0: M_attach(rows, state, on, salt_by, how, salts, 0))
    from vertexlake.session import attach as M_attach

    rows = sample()[:600]
    got = {(r.g, r.fraction): r.value for r in M.bisect(M.usable(frame(spark, rows), "label", "distance"), [0.5]).collect()}
    by = {}
    for _, l, v, *_ in rows:
        by.setdefault(l, []).append(v)
    assert got == {(l, 0.5): brute(v, 0.5) for l, v in by.items()}
