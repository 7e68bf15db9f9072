"""Queries and operators that must do the whole job, not a part of it."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import points
from vertexlake.operators import fit, manyfits, neighbours, pcha, sets
from vertexlake.plans import catalogue


def test_gam_summary_all_takes_every_event(spark, tmp_path):
    rows = [(i, i % 5, "ab"[i % 7 % 2], float(i * 37 % 101)) for i in range(1, 90)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.y_name, r.x_name, r.metric): r for r in catalogue.queries()["gam_summary_all"](spark, str(tmp_path)).collect()}
    e = pd.DataFrame(rows, columns=["x", "user", "y_name", "value"])
    e = e.assign(x_name="a" + (e.user % 3).astype(str), deriv=(e.value / 100 - 0.5).round(6), p=0.99 + e.x % 10 / 1000, w=1.0 + e.x % 3)
    groups = {g: t.sort_values("x") for g, t in e.groupby(["y_name", "x_name"])}
    mean, prod = {g: t.p.mean() for g, t in groups.items()}, {g: t.p.prod() for g, t in groups.items()}
    assert len(got) == 4 * len(groups) == 24
    for g, t in groups.items():
        others = [h for h in groups if h[0] == g[0] and h != g]
        want = {"mean_prob": mean[g], "prod_prob": prod[g], "mean_prob_excl": mean[g] * sum(1 - mean[h] for h in others) / len(others), "prod_prob_excl": prod[g] * math.prod(1 - prod[h] for h in others)}
        for metric, p in want.items():
            r = got[(*g, metric)]
            assert abs(r.p - (1 - p)) < 2e-6
            for share, d in ((1.0, r.deriv100), (0.5, r.deriv50), (0.2, r.deriv20)):
                part = t.head(math.ceil(len(t) * share))
                assert abs(d - (part.w * part.deriv).sum() / part.w.sum()) < 2e-6


def two_dims(spark, n=300):
    x = points(n)
    return x, spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x.T)], "sample_id int, features array<double>").repartition(3).persist()


def test_large_fits_keep_method_ratio_share_and_permutation(spark, monkeypatch):
    x, df = two_dims(spark)
    local = fit.fit_table(df, 3).summary.first()
    km = fit.fit_table(df, 3, method="kmeans").summary.first()
    monkeypatch.setattr(fit, "LOCAL", 10)
    s = fit.fit_table(df, 3).summary.first()
    assert abs(s.hull_vol / local.hull_vol - 1) < 1e-9 and abs(s.t_ratio / local.t_ratio - 1) < 0.05
    f = fit.fit_table(df, 3, method="kmeans")
    big = f.summary.first()
    assert big.method == "kmeans" and abs(big.varexpl - km.varexpl) < 0.1
    w = {r.sample_id: r.weights for r in f.weights.collect()}
    own = np.array([np.argmax(w[i]) for i in range(x.shape[1])])
    centres = np.array([r.position for r in f.archetypes.orderBy("arch_id").collect()])
    assert (own == ((x.T[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all()
    assert abs(((x.T - centres[own]) ** 2).sum() - big.sse) < 1e-6 * big.sse
    with pytest.raises(ValueError):
        fit.fit_table(df, 3, method="louvain")
    p = fit.permuted(df, [3], n=1).summary.first()
    assert p.replicate == 1 and p.t_ratio is not None and p.varexpl < s.varexpl


def test_large_draws_are_exact(spark):
    x, df = two_dims(spark)
    num = df.withColumn("sample_id", F.col("sample_id") + 1)
    once = [r.sample_id for r in fit._drawn(num, 300, 0.65, 1, 2, False).collect()]
    assert len(once) == len(set(once)) == 195
    twice = [r.sample_id for r in fit._drawn(num, 300, 0.65, 1, 2, True).collect()]
    assert len(twice) == 195 > len(set(twice))
    got = np.array([r.features for r in fit._permuted_rows(num, 300, 1, 1, False).collect()])
    assert (np.sort(got, 0) == np.sort(x.T, 0)).all() and len({tuple(v) for v in got.tolist()} & {tuple(v) for v in x.T.tolist()}) < 30
    again = np.array([r.features for r in fit._permuted_rows(num, 300, 1, 1, True).collect()])
    assert again.shape == (300, 2) and 100 < len(np.unique(again[:, 0])) < 250


def test_a_small_dictionary_grows_to_all_samples(spark):
    t = np.arange(60) * np.pi / 30
    x = 10 * np.stack([np.cos(t), np.sin(t)])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x.T)], "sample_id int, features array<double>")
    assert pcha.distributed_fit(df, 4, 2, directions=3).sse < 1.02 * pcha.pcha(x, 4, seed=0).sse


@pytest.mark.parametrize("size", [neighbours.BLOCK, 300])
def test_neighbours_among_many_copies_are_those_of_least_id(spark, monkeypatch, size):
    monkeypatch.setattr(neighbours, "BLOCK", size)
    rng = np.random.default_rng(5)
    x = np.vstack([np.tile(rng.normal(size=3) * 100, (200, 1)), rng.integers(0, 2, (200, 3)).astype(float)])[rng.permutation(400)]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "sample_id int, features array<double>")
    got = {(r.sample_id, r.place): r.neighbour for r in neighbours.knn(df, 5).collect()}
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = np.lexsort((np.tile(np.arange(400), (400, 1)), d))[:, :5]
    assert got == {(i, p + 1): int(want[i, p]) for i in range(400) for p in range(5)}


def test_more_than_fifty_kinds_of_events_all_count(spark, tmp_path):
    rows = [(i, i % 20, f"kind {i % 60:02d}") for i in range(600)] + [(600 + i, i, f"kind {50 + i % 10:02d}") for i in range(20)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("wilcox_ties_cnt", "median_diff_cnt", "permute_feature"):
        want = con.execute(catalogue.oracle_sql()[name]).df()
        got = catalogue.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
        key = [c for c in want.columns if want[c].dtype.kind not in "f"]
        pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True), check_dtype=False, atol=2e-6)
    assert catalogue.queries()["poisson_map"](spark, str(tmp_path)).select("feature").distinct().count() == 60


def test_fit_queries_read_the_tables_and_louvain_names_every_sample(spark, tmp_path):
    from datetime import datetime

    x = np.random.default_rng(2).normal(size=(700, 8))
    rows = [(i, [float(a) for a in v], datetime(2026, 1, 1)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "sample_id bigint, features array<double>, loaded_at timestamp").write.parquet(str(tmp_path / "data_matrix.parquet"))
    q = catalogue.queries()
    assert sorted(r.sample_id for r in q["louvain"](spark, str(tmp_path)).collect()) == list(range(700))
    assert max(r.varexpl for r in q["k_sweep"](spark, str(tmp_path)).collect()) < 0.9  # noise has no triangle
    assert q["bootstrap_fit"](spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize("noself", [False, True])
@pytest.mark.parametrize("n_genes,n_sets,side", [(40, 7, 2_000), (7, 40, 2_000), (14, 12, 3)])
def test_scores_of_a_large_matrix_are_those_of_its_inverse(spark, monkeypatch, n_genes, n_sets, side, noself):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (n_genes, n_sets)) * (rng.random((n_genes, n_sets)) < 0.4)
    g[0], g[:, 0] = 1, 1
    g[:, -1] = g[:, 1]  # two alike, so the inverse is a pseudo one
    g[-1] = 0
    g[-1, 2] = 1
    pairs = [(f"k{j}", f"k{i}") for i in range(n_genes) for j in range(n_sets) for _ in range(int(g[i, j]))]
    t = spark.createDataFrame([*pairs, ("k1", "nowhere")], "set_id string, gene string")
    v = rng.normal(size=(5, n_genes))
    rows = [(s, f"k{i}", float(v[s, i])) for s in range(5) for i in range(n_genes)] + [(5, "no set", 1.0), (6, "k0", None), (7, "k1", 2.0), (7, "k1", 1.0)]
    long = spark.createDataFrame(rows, "sample_id int, feature string, value double")
    of = lambda: {(r.sample_id, r.set_id): r.score for r in sets.pinv_scores(long, t, noself).collect()}
    want = of()
    monkeypatch.setattr(sets, "DENSE", 10)
    monkeypatch.setattr(sets, "SIDE", side)
    got = of()
    assert set(got) == set(want) and {s for s, _ in got} == {0, 1, 2, 3, 4, 5, 7} and len(got) == 7 * n_sets
    assert all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_large_replicates_are_fitted_in_the_same_passes(spark, monkeypatch):
    monkeypatch.setattr(fit, "LOCAL", 10)
    monkeypatch.setattr(manyfits, "NUMBERS", 128)
    monkeypatch.setattr(pcha, "distributed_fit", None)  # one replicate after another
    x = points(300)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x.T)], "sample_id int, features array<double>")
    passes = []
    ask = manyfits.ask
    monkeypatch.setattr(manyfits, "ask", lambda *a: passes.append(len(a[2])) or ask(*a))
    b = fit.bootstrap(df, [3], n=4, seed=7)
    rows = b.summary.collect()
    best = pcha.pcha(x, 3, seed=0)
    assert [r.replicate for r in rows] == [1, 2, 3, 4] and all(r.converged for r in rows) and passes[:3] == [4, 4, 4] and len(passes) < 40
    assert all(abs(r.varexpl - best.varexpl) < 0.01 and 0 < r.t_ratio <= 1.1 for r in rows)
    sizes = np.array([64, 64, 64, 64, 44])
    once, twice = manyfits.drawn(sizes, 195, 7, "a", False), manyfits.drawn(sizes, 195, 7, "a", True)
    assert once.sum() == twice.sum() == 195 and (once <= sizes).all()


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_nearest_weights_are_the_best(k):
    rng = np.random.default_rng(k)
    x, xc = rng.normal(size=(5, 400)), rng.normal(size=(5, k))
    xc[:, -1] = xc[:, 0]  # a flat simplex
    s, t = pcha.nearest_weights(x, xc), pcha.simplex_weights(x, xc, 3_000)
    assert np.allclose(s.sum(0), 1) and s.min() >= 0 and (((x - xc @ s) ** 2).sum(0) <= ((x - xc @ t) ** 2).sum(0) + 1e-9).all()


def test_large_permutations_hold_every_value_once(spark, monkeypatch):
    monkeypatch.setattr(fit, "LOCAL", 10)
    monkeypatch.setattr(manyfits, "NUMBERS", 128)
    monkeypatch.setattr(pcha, "distributed_fit", None)  # one replicate after another
    x = points(300)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x.T)], "sample_id int, features array<double>")
    base, sizes = manyfits.packed(df, 300, 2)
    got = manyfits.permuted(base, sizes, 2, 1, [1, 2], False).orderBy("table_", "block").collect()
    tables = [np.vstack([np.frombuffer(r.x).reshape(-1, 2) for r in got if r.table_ == t]) for t in (1, 2)]
    for t in tables:
        assert (np.sort(t, 0) == np.sort(x.T, 0)).all() and len({tuple(v) for v in t.tolist()} & {tuple(v) for v in x.T.tolist()}) < 30
    assert (tables[0] != tables[1]).any()
    rows = fit.permuted(df, [3], n=2).summary.collect()
    assert [r.replicate for r in rows] == [1, 2] and all(r.varexpl is not None and r.t_ratio is not None for r in rows)
