import math
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.test_mixing import T, docs, sample
from vertexlake.llm import mixing


def test_slots_hold_equal_tokens_in_pieces(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2), ("none", 0.0, 2)], T)
    m, s, r = mixing.plan_mixture(docs(spark, sample()), t, block=64)
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
    # Every slot holds its tokens, in pieces that lie in a row; every use of a message is whole, but for the last of a source.
    long = max(x.n_tokens for x in rows)
    pieces = mixing.mixture(m, s, r).collect()
    held, of = Counter(), {}
    for x in pieces:
        held[x.slot] += x.n_tokens
        of.setdefault((x.source, x.doc_id, x.repeat), []).append((x.start, x.n_tokens))
    plan = s.collect()
    assert all(held[x.slot] == x.n_tokens for x in plan) and sum(held.values()) == sum(x.used_tokens for x in rep.values())
    assert all(0 < x.n_tokens <= x.wanted_tokens <= 65 for x in plan if x.source != "small") and any(x.n_tokens == 0 for x in plan if x.source == "small")
    size, cut_off = {x.doc_id: x.n_tokens for x in rows}, Counter()
    for (source, i, _), parts in of.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        cut_off[source] += sum(n for _, n in parts) < size[i]
    assert all(n <= 1 for n in cut_off.values())
    begun = Counter((x.doc_id) for x in pieces if x.start == 0)
    assert all(begun[x.doc_id] == x.uses for x in rows if x.n_tokens)
    for k, x in rep.items():
        assert 0 <= sum(y.uses * y.n_tokens for y in rows if y.source == k) - x.used_tokens < long
        assert x.short or not x.target_share or abs(x.reached_share - x.target_share) < 0.001


def test_the_schedule_decides_what_falls_short(spark, monkeypatch):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2)], T)
    short = lambda: {x.source for x in mixing.plan_mixture(docs(spark, sample()), t, block=64)[2].filter("short").collect()}
    assert short() == {"small"}
    monkeypatch.setattr(mixing, "point", lambda i: F.lit(0.25))
    assert short() != {"small"}


def test_sources_that_are_not_short_keep_their_proportions(spark):
    t = spark.createDataFrame([("big", 0.4, 2), ("mid", 0.2, 9), ("other", 0.1, 9), ("gone", 0.3, 9)], T)
    r = {x.source: x for x in mixing.plan_mixture(docs(spark, sample()), t)[2].collect()}
    assert r["gone"].short and r["gone"].used_tokens == 0
    for a, b in (("big", "mid"), ("mid", "other")):
        assert math.isclose(r[a].actual_share / r[b].actual_share, r[a].target_share / r[b].target_share, rel_tol=0.005)
