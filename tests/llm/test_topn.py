import random

from vertexlake.llm.topn import top_n


def brute(rows, n):
    best = {}
    for g, y, p in rows:
        if g is None or y is None or p is None or p != p or not 0 <= p <= 1:
            continue
        k = (g, y)
        best[k] = min(best.get(k, 2.0), p + 0.0)
    by = {}
    for (g, y), p in best.items():
        by.setdefault(g, []).append((p, y.encode()))
    return sorted((g, y.decode(), p) for g, v in by.items() for p, y in sorted(v)[:n])


def run(spark, rows, n):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "x string, y string, p double, c int, s string")
    return sorted((r.g, r.y, r.s) for r in top_n(df, "x", "y", "p", n).collect())


def test_against_sorting(spark):
    rng = random.Random(1)
    ps = [0.0, -0.0, 5e-324, 1e-310, 0.2, 0.2, 0.5, 1.0, None, float("nan"), -0.1, 1.5]
    rows = [("hot", f"gene{rng.randrange(400):03d}", rng.choice([*ps, rng.random()])) for _ in range(1500)]
    rows += [(rng.choice("abc"), f"G{k}", rng.choice(ps)) for k in range(200)] + [("one", "x", 0.3), (None, "x", 0.1), ("one", None, 0.1)]
    rows += rows[:100]
    for n in (1, 3, 12):
        assert run(spark, rows, n) == brute(rows, n)


def test_ties_are_decided_by_names_of_any_length_and_case(spark):
    names = ["prefix" * 5 + s for s in ("", "a", "A", "ab", "\x00", "é", "日本", "z" * 50)] + ["", "Ab", "aB", "AB", "ab"]
    rows = [("g", y, 0.25) for y in names]
    for n in (1, 4, 9, 12):
        assert run(spark, rows, n) == brute(rows, n)


def test_empty_and_unusable(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [("g", "y", None), (None, None, None)], 3) == []
