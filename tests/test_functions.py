import math
import struct

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertexlake.functions import keyed, names, ranks, vectors
from vertexlake.functions.doubles import code_of, signed_code, value_of


def test_codes_are_the_bits_and_keep_the_order(spark):
    xs = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 1e-300, 0.1, 1.0, 1.5, 2.0, 1e300, 1.7976931348623157e308, None, float("nan"), float("inf"), -1.0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = rows.select("i", code_of(F.col("x")).alias("c")).withColumn("back", value_of(F.col("c"))).orderBy("i").collect()
    for x, r in zip(xs, got):
        if x is None or x != x or x < 0 or x == math.inf:
            assert r.c is None and r.back is None
        else:
            assert r.c == struct.unpack("<q", struct.pack("<d", x + 0.0))[0] and r.back == x


def test_codes_at_every_power_of_two_and_of_random_bits(spark):
    bits = np.array([(e << 52) + d for e in range(2047) for d in (0, 1, (1 << 52) - 1)] + np.random.default_rng(5).integers(0, 0x7FEFFFFFFFFFFFFF, 5000).tolist(), np.int64)
    df = spark.createDataFrame(list(zip(bits.tolist(), bits.view(np.float64).tolist())), "b bigint, x double")
    c = df.select("b", "x", code_of(F.col("x")).alias("c")).withColumn("v", value_of(F.col("c")))
    assert c.filter("b <> c or v <> x").count() == 0


def test_signed_codes_keep_the_order_and_let_filters_through(spark, tmp_path):
    xs = [-math.inf, -1e308, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1.7976931348623157e308, math.inf]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.c for r in df.select("x", signed_code(F.col("x")).alias("c")).orderBy("x").collect()]
    assert got == sorted(set(got))
    df.write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).select("x", code_of(F.col("x")).alias("c")).filter("x > 3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,3.0)" in plan


def test_row_numbers_and_value_ranks_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500) / 4))]
    df = spark.createDataFrame(rows, "g int, v double, i int")
    got = {(r.g, r.i): r.rn for r in ranks.row_numbers(df, ["g"], "v", ["i"], bits=51).collect()}
    for g in range(3):
        order = sorted((v, i) for gg, v, i in rows if gg == g)
        assert all(got[(g, i)] == n for n, (_, i) in enumerate(order, 1))
    for r in ranks.value_ranks(df, ["g"], "v", bits=50).collect():
        own = [v for g, v, _ in rows if g == r.g]
        below, same = sum(v < r.v for v in own), own.count(r.v)
        assert (r.n, r.rank, r.n_all) == (same, below + (same + 1) / 2, len(own))


def test_row_numbers_with_nulls_nan_ties_and_no_group(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, float("nan")), (4, 1.0), (5, -2.0)], "i int, v double")
    got = {r.i: r.rn for r in ranks.row_numbers(df, [], "v", ["i"]).collect()}
    assert (got[5], got[2], got[4]) == (1, 2, 3) and {got[1], got[3]} == {4, 5}
    empty = df.filter("i > 9")
    assert ranks.row_numbers(empty, [], "v", ["i"]).count() == 0
    null_group = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 2), (1, 3.0, 3)], "g int, v double, i int")
    assert ranks.value_ranks(null_group.filter("g is not null"), ["g"], "v").count() == 1


def test_numbered_and_running_min(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 1000).alias("v"))
    n = ranks.numbered(df, [F.col("v")])
    assert n.filter("rn <> v + 1").count() == 0
    m = ranks.running_min_from_end(n, "rn", "part_", -F.col("v"), "m")
    assert m.filter("m <> -999").count() == 0


def test_keyed_numbers_are_uniform_and_repeatable(spark):
    x = spark.range(20_000).select(keyed.uniform(1, "a", F.col("id")).alias("u"), keyed.normal(1, "b", F.col("id")).alias("z"))
    r = x.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(r[0] - 0.5) < 0.01 and r[1] >= 0 and r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03


def test_vector_expressions(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.distance(F.col("a"), F.col("b"))).collect()] == [5.0, None, None]
    p = spark.createDataFrame([([0.5, 0.5, 0.0],)], "p array<double>")
    r = p.select(vectors.entropy(F.col("p")).alias("e"), vectors.first_argmax(F.col("p")).alias("m")).first()
    assert (r.e, r.m) == (1.0, 1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=9, max_size=9))
def test_determinant(spark, v):
    m = [[F.lit(v[3 * i + j]) for j in range(3)] for i in range(3)]
    got = spark.range(1).select(vectors.determinant(m)).first()[0]
    assert math.isclose(got, float(np.linalg.det(np.array(v).reshape(3, 3))), rel_tol=1e-6, abs_tol=1e-4)


def test_names(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "x-[y](z),q'/")], "i int, n string")
    assert [r[0] for r in df.orderBy("i").select(names.sanitize(F.col("n"))).collect()] == ["a_b", "a_b", None, "x__y__z__q__"]
    got = {r.i: r.unique_name for r in names.tell_apart(df, "n", "i").collect()}
    assert got[1] == "a b" and got[2] == "a b_2"
