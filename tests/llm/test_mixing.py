import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vertexlake.llm import mixing

T = "source string, target_share double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, source string, text string, block int, uses int")


def sample():
    out, i = [], 0
    for source, n in (("big", 300), ("mid", 90), ("small", 20), ("other", 50)):
        for _ in range(n):
            out.append((i, source, "word " * (5 + i % 40), 0, 0))
            i += 1
    return [*out, (i, None, "x", 0, 0), (i + 1, "mid", None, 0, 0), (i + 2, "mid", "", 0, 0), (i + 3, "mid", " \n", 0, 0)]


def test_shares_caps_and_report(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2), ("none", 0.0, 2)], T)
    m, s, r = mixing.mix(docs(spark, sample()), t, block=64)
    rep = {x.source: x for x in r.collect()}
    assert set(rep) == {"big", "mid", "small", "none"}
    total = sum(x.available_tokens for x in rep.values())
    for x in rep.values():
        assert x.short == (x.available_tokens * x.max_repeats < x.target_share * total)
        if not x.short and x.target_share:
            assert abs(x.used_tokens - x.target_tokens) < 64 * 12
    assert rep["small"].short and not rep["mid"].short
    assert math.isclose(sum(x.actual_share for x in rep.values()), 1.0)
    cap = {"big": 1, "mid": 3, "small": 2}
    rows = m.collect()
    assert len(rows) == 413 and all(0 <= x.uses <= cap[x.source] for x in rows)
    used = Counter()
    for x in rows:
        used[x.source] += x.uses * x.n_tokens
    assert all(rep[k].used_tokens == v for k, v in used.items())
    # A message is used as often as its block is in the schedule.
    times = Counter((x.source, x.block) for x in s.collect())
    assert all(x.uses == times[x.source, x.block] for x in rows)


def test_any_stretch_is_near_the_target(spark):
    t = mixing._targets(spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 1), ("c", 0.1, 1)], T))
    got = [x.source for x in mixing.slots(t, 1000).orderBy("slot").collect()]
    assert len(got) == 1000
    for a in range(0, 900, 100):
        c = Counter(got[a : a + 100])
        assert abs(c["a"] - 60) <= 8 and abs(c["b"] - 30) <= 8 and abs(c["c"] - 10) <= 8
    ranks = mixing.slots(t, 1000).groupBy("source").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.countDistinct("rank").alias("d")).collect()
    assert all(x.n == x.d == x.m + 1 for x in ranks)


def test_ranges_do_not_change_the_mixture(spark, monkeypatch):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2)], T)
    a = {x.doc_id: (x.block, x.uses) for x in mixing.mix(docs(spark, sample()), t, block=64)[0].collect()}
    monkeypatch.setattr(mixing, "RANGE", 16)
    assert a == {x.doc_id: (x.block, x.uses) for x in mixing.mix(docs(spark, sample()), t, block=64)[0].collect()}


@pytest.mark.parametrize("rows", [[], [(1, None, "a", 0, 0)], [(1, "big", None, 0, 0)]])
def test_nothing_to_mix(spark, rows):
    t = spark.createDataFrame([("big", 0.5, 2), (None, 0.5, 1), ("big", 0.1, 3), ("neg", -1.0, None)], T)
    m, s, r = mixing.mix(docs(spark, rows), t)
    assert s.count() == 0 and m.filter("uses > 0").count() == 0
    got = {x.source: x for x in r.collect()}
    assert set(got) == {"big", "neg", None} and all(x.used_tokens == 0 for x in got.values())
