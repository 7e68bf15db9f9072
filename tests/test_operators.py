import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexlake.operators import archetypes, bins, distance, fit, gam, geometry, models, pcha, plotdata, project, ranktest, sets, sketch
from vertexlake.sources import matrix
from vertexlake.streaming import score

TRIANGLE = np.array([[5.0, 0.0], [-10.0, 15.0], [-30.0, -20.0]])


def points(n=1000, seed=0, size=0.99, jitter=0.04, vertices=TRIANGLE):
    rng = np.random.default_rng(seed)
    w = rng.random((n, len(vertices)))
    w = w / w.sum(1, keepdims=True) * size + rng.normal(0, jitter, w.shape)
    return (w @ vertices).T


def test_distance_of_the_345_triangle_and_broken_vectors(spark):
    x = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None), ("c", [1.0])], "sample_id string, features array<double>")
    a = spark.createDataFrame([("m", [3.0, 4.0])], "arch string, position array<double>")
    assert {r.sample_id: r.dist for r in distance.arch_dist(x, a).collect()} == {"a": 5.0, "b": None, "c": None}
    assert distance.arch_dist(x, a.limit(0)).count() == 0


def test_bins_take_half_to_even_and_ties_by_sample(spark):
    d = spark.createDataFrame([("a", i, float(i // 2)) for i in range(25)], "arch string, sample_id int, dist double")
    assert sorted(r.sample_id for r in bins.bins_by_share(d, 0.1).collect()) == [0, 1]  # round(2.5) is 2
    assert bins.bins_by_cutoff(d, -1.0).count() == 0
    b = bins.equal_bins(d, ["arch"], "dist", ["sample_id"], 10).groupBy("bin").count().collect()
    assert {r.bin: r["count"] for r in b}[10] == 25 - 9 * 2


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_rank_test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 8, (60, 3)).astype(float)
    long = spark.createDataFrame([(i, f"f{j}", float(v[i, j])) for i in range(60) for j in range(3)] + [(99, "f0", None)], "sample_id int, feature string, value double")
    inside = [int(i) for i in rng.choice(60, 12, replace=False)]
    b = spark.createDataFrame([("x", i) for i in inside], "arch string, sample_id int")
    got = {r.y_name: r for r in ranktest.find_decreasing_wilcox(long, b).collect()}
    s = {r.y_name: r for r in ranktest.rank_statistics(long, b).collect()}
    for j in range(3):
        a, o = v[inside, j], np.delete(v[:, j], inside)
        assert s[f"f{j}"].u == brute_u(a, o)
        assert math.isclose(got[f"f{j}"].median_diff, np.median(a) - np.median(o))
        assert math.isclose(got[f"f{j}"].mean_diff, a.mean() - o.mean(), rel_tol=1e-9)
        assert 0 <= got[f"f{j}"].p <= 1


def test_rank_test_of_constant_feature_and_full_bin(spark):
    long = spark.createDataFrame([(i, "c", 1.0) for i in range(4)], "sample_id int, feature string, value double")
    b = spark.createDataFrame([("x", i) for i in range(4)], "arch string, sample_id int")
    r = ranktest.rank_statistics(long, b).first()
    assert r.z is None and r.mean_diff is None


def test_bh_is_monotone_and_not_below_p(spark):
    ps = [0.01, 0.02, 0.02, 0.5, None, float("nan"), 0.9]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    got = {r.i: r.p_adj for r in ranktest.adjust_p(df, ties=["i"]).collect()}
    want = [0.01 * 5, 0.02 * 5 / 3, 0.02 * 5 / 3, 0.5 * 5 / 4, None, None, 0.9]
    want[0] = min(want[0], want[1])
    assert all((got[i] is None) == (w is None) and (w is None or math.isclose(got[i], w)) for i, w in enumerate(want))


def test_assignment_equals_trying_all_orders():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 6):
        c = rng.random((n, n))
        a, b = geometry.assign(c), geometry.exhaustive(c)
        assert sorted(a) == list(range(n))
        assert math.isclose(sum(c[i, j] for i, j in enumerate(a)), sum(c[i, j] for i, j in enumerate(b)))


def test_hull_of_cubes_and_flat_points(spark):
    for d in (2, 3, 4):
        cube = np.array(list(itertools.product([0.0, 1.0], repeat=d)))
        v, area, at = geometry.hull(np.vstack([cube, np.random.default_rng(0).random((50, d))]))
        assert math.isclose(v, 1.0, rel_tol=1e-9) and math.isclose(area, 2 * d, rel_tol=1e-9) and sorted(at) == list(range(2**d))
    assert math.isnan(geometry.hull(np.array([[0.0, 0], [1, 1], [2, 2], [3, 3]]))[0])
    x = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(np.random.default_rng(1).random((200, 2)))], "sample_id int, features array<double>")
    whole = geometry.hull(np.array([r.features for r in x.collect()]))[0]
    assert math.isclose(geometry.table_hull(x, 2)[0], whole, rel_tol=1e-9)


def test_volume_of_a_simplex():
    assert geometry.simplex_volume(np.array([[0.0, 1, 0], [0, 0, 1]])) == 0.5


@pytest.mark.parametrize("delta", [0.0, 0.1])
def test_pcha_recovers_the_triangle(delta):
    x = points()
    f = pcha.pcha(x, 3, seed=1, delta=delta)
    assert f.converged and f.varexpl > 0.98
    assert geometry.align(TRIANGLE.T, f.xc)[0] < 12
    assert (f.s >= 0).all() and np.allclose(f.s.sum(0), 1)
    assert (f.c >= 0).all() and (np.abs(f.c.sum(0) - 1) <= delta + 1e-9).all()


def test_pcha_on_too_few_or_broken_samples():
    assert not pcha.pcha(np.zeros((2, 1)), 3).converged
    assert not pcha.pcha(np.array([[1.0, np.nan, 2, 3], [0, 1, 2, 3]]), 2).converged


def test_more_archetypes_do_not_explain_less():
    x = points(500, vertices=np.array([[5.0, 0, 4], [-10, 15, 0], [-30, -20, -5], [10, 10, 30]]))
    v = [pcha.pcha(x, k, seed=2).varexpl for k in (1, 2, 3, 4)]
    assert all(b >= a - 1e-3 for a, b in zip(v, v[1:]))


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(x.T)], "sample_id int, features array<double>")


def test_distributed_fit_comes_near_the_local_fit(spark):
    x = points(800)
    local = pcha.pcha(x, 3, seed=1, conv=1e-5)
    far = pcha.distributed_fit(frame(spark, x), 3, 2, conv=1e-4, maxiter=40)
    assert far.sse <= local.sse * 1.05 + 1e-6 or far.varexpl > 0.999
    w = pcha.weights(frame(spark, x), far.xc).first().weights
    assert abs(sum(w) - 1) < 1e-9 and min(w) >= 0


def test_simplex_weights_solve_an_inner_point():
    s = pcha.simplex_weights(TRIANGLE.T @ np.array([[0.2], [0.3], [0.5]]), TRIANGLE.T)
    assert np.allclose(s[:, 0], [0.2, 0.3, 0.5], atol=1e-3)


def test_bootstrap_align_and_average(spark):
    b = fit.bootstrap(frame(spark, points(300)), [3], n=4, seed=7)
    assert b.archetypes.count() == 12 and b.summary.filter("converged").count() == 4
    vert, total = fit.position_variance(b.archetypes, frame(spark, points(300)))
    assert total.first().total_var < 0.2
    assert fit.average_positions(b.archetypes).count() == 3
    assert "archetype fits" in str(b)


def test_permutation_test_finds_structure(spark):
    x = frame(spark, points(300))
    obs = fit.k_sweep(x, [3])
    dist, p = fit.significance(x, obs, n=12)
    got = {r.var_name: r for r in p.collect()}
    assert 1 / 12 - 1e-9 <= got["t_ratio"].p_value <= 1 - 1 / 12 + 1e-9
    assert obs.summary.first().t_ratio <= 1 + 1e-9


def test_kmeans_and_louvain_find_groups(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (10, 0), (0, 10))]).T
    assert fit.fit_matrix(x, 3, "louvain", neighbours=8).varexpl > 0.9
    assert max(fit.fit_matrix(x, 3, "kmeans", seed=s).varexpl for s in range(4)) > 0.9


def test_empirical_p_is_clamped(spark):
    r = spark.createDataFrame([(2, "a", i, float(i)) for i in range(10)] + [(2, "b", 0, None)], "k int, var_name string, repl int, var_rand double")
    o = spark.createDataFrame([(2, "a", 100.0), (2, "b", 1.0), (3, "c", 1.0)], "k int, var_name string, var_obs double")
    got = {r.var_name: r.p_value for r in fit.empirical_p(r, o)[1].collect()}
    assert math.isclose(got["a"], 0.1) and got["b"] is None and got["c"] is None


def test_permutation_keeps_each_features_values(spark, data):
    c = matrix.event_counts(spark, data)
    kinds = sorted(r.feature for r in c.select("feature").distinct().collect())
    long = matrix.to_long(matrix.from_long(c, kinds), kinds)
    p = archetypes.permute_features(long, 5)
    a = sorted((r.feature, r.value) for r in long.collect())
    assert a == sorted((r.feature, r.value) for r in p.collect())
    assert p.select("sample_id", "feature").distinct().count() == long.count()


def test_svd_round_trip(spark):
    v = np.array([[5.0, 1, 4], [10, 15, 1], [30, 20, 5]])
    x = points(200, vertices=v)
    s = project.fit_svd(frame(spark, x), 3)
    assert np.allclose(s.d, np.linalg.svd(x, compute_uv=False), rtol=1e-6)
    back = project.from_components(s.u.T @ v.T, s)
    assert np.allclose(back, v.T)
    z = project.fit_svd(frame(spark, np.abs(x)), 3, log2=True, zscore=True)
    got = np.array([r.features for r in project.to_components(frame(spark, np.abs(x)), z).orderBy("sample_id").collect()])
    assert np.allclose(project.from_components(got.T, z, True, True), np.abs(x), atol=1e-6)


def test_sketch_spreads_over_space(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.01, (300, 2)), rng.uniform(-10, 10, (40, 2))]).T
    got = sketch.sketch(frame(spark, x), 40)
    assert got.count() == 40 and got.filter(F.col("sample_id") >= 300).count() > 25
    assert sketch.sketch(frame(spark, x[:, :5]), 40).count() == 5


def test_auc_of_a_known_order(spark):
    long = spark.createDataFrame([("s", g, float(9 - i)) for i, g in enumerate("abcde")], "sample_id string, feature string, value double")
    t = spark.createDataFrame([("top", "a"), ("top", "b"), ("low", "e"), ("none", "z")], "set_id string, gene string")
    got = {r.set_id: r.auc for r in sets.auc_scores(long, t, 4).collect()}
    assert got == {"top": 1.0}


def test_pinv_of_disjoint_sets_gives_means(spark):
    long = spark.createDataFrame([("s", g, v) for g, v in zip("abc", (1.0, 3.0, 5.0))], "sample_id string, feature string, value double")
    t = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("z", "q")], "set_id string, gene string")
    got = {r.set_id: r.score for r in sets.pinv_scores(long, t).collect()}
    assert set(got) == {"x", "y"} and math.isclose(got["x"], 2.0) and math.isclose(got["y"], 5.0)


def test_catalogue_splits_lists_by_place(spark):
    c = spark.createDataFrame([("u1, u2", "n1, n2", "A, B - C", "x"), ("u3, u4", "only", "A", "y"), ("", "e", "A", "x"), (None, None, None, None)], "MAPPED_TRAIT_URI string, MAPPED_TRAIT string, MAPPED_GENE string, CONTEXT string")
    t, g = sets.explode_catalogue(c)
    assert {(r.uri, r["name"]) for r in t.collect()} == {("u1", "n1"), ("u2", "n2"), ("u3", "only"), ("u4", "only")}
    assert {r.gene_name for r in g.collect()} == {"A", "B", "C"}


def test_deviance_is_least_for_poisson_counts(spark):
    rng = np.random.default_rng(2)
    a, b = rng.poisson(5, 400), rng.poisson(5 * rng.gamma(1, 1, 400))
    rows = [(i, "p", float(v)) for i, v in enumerate(a) if v] + [(i, "g", float(v)) for i, v in enumerate(b) if v]
    got = {r.feature: r for r in models.deviance(spark.createDataFrame(rows, "sample_id int, feature string, value double"), 400).collect()}
    mu = a.mean()
    want = 2 * sum((y * math.log(y / mu) if y else 0) - y + mu for y in a)
    assert math.isclose(got["p"].deviance, want, rel_tol=1e-9) and got["p"].deviance < got["g"].deviance


def test_poisson_map_meets_its_gradient(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, 200).astype(float)
    y = rng.poisson(np.exp(0.5 + 0.8 * x)).astype(float)
    b = models.poisson_map(y, x[:, None])
    a = np.column_stack([np.ones(200), x])
    assert np.abs(a.T @ (y - np.exp(a @ b)) - b / 9).max() < 1e-5
    long = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(y)], "sample_id int, feature string, value double")
    cov = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "sample_id int, x array<double>")
    assert np.allclose(models.poisson_regression(long, cov).first().coef, b, atol=1e-6)


def test_softmax_learns_and_stops(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 300)
    x = rng.normal(0, 0.5, (300, 2)) + np.array([[0, 0], [4, 0], [0, 4]])[y]
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "sample_id int, features array<double>, label int")
    w, b, losses = models.fit_softmax_full(df, "features", "label", 3, epochs=30)
    assert losses[-1] < losses[0]
    p = models.classify(df.withColumn("probabilities", models.probabilities(F.col("features"), w, b)))
    assert p.filter("pred_class = label + 1").count() > 270
    m = models.coefficients(models.fit_softmax(df, "features", "label", kind="l2"))
    assert m[0].shape == (3, 2)
    c = models.confusion(p, "label", "pred_class", zeros=True)
    assert c.count() == 9 and c.agg(F.sum("N")).first()[0] == 300


def test_split_is_exact_per_class(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "sample_id int, label int")
    v = models.split_by_class(df, "label", "sample_id", 0.3)
    assert {r.label: r["count"] for r in v.filter("validation").groupBy("label").count().collect()} == {0: 8, 1: 8}  # round(7.5) is 8
    assert models.split_by_class(df, "label", "sample_id", 0.3, per_class=False).filter("validation").count() == 15


def test_curves_fall_where_the_feature_falls(spark):
    rng = np.random.default_rng(8)
    d = rng.uniform(0, 10, 300)
    dist = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(d)], "sample_id int, arch string, dist double")
    rows = [(i, "falls", float(10 - v + rng.normal(0, 0.1))) for i, v in enumerate(d)] + [(i, "rises", float(v)) for i, v in enumerate(d)]
    long = spark.createDataFrame(rows, "sample_id int, feature string, value double")
    out = gam.find_decreasing(dist, long, n_points=40)
    s = {(r.y_name, r.metric): r for r in out["summary"].collect()}
    assert s[("falls", "mean_prob")].p < 0.05 < 0.95 < s[("rises", "mean_prob")].p
    assert s[("falls", "mean_prob")].deriv100 < -0.8 and s[("falls", "mean_prob")].r_sq > 0.9 and s[("falls", "mean_prob")].smooth_term_p_val < 1e-6


def test_embedding_keeps_groups_apart(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3))]).T
    a = spark.createDataFrame([("a1", [0.0, 0.0, 0.0])], "arch_name string, position array<double>")
    for m in ("umap", "tsne"):
        got = {r.id: (r.x1, r.x2) for r in plotdata.embed(frame(spark, x), a, m, 5, 60).collect()}
        assert len(got) == 41 and all(map(math.isfinite, itertools.chain(*got.values())))


def test_lines_and_structure(spark):
    a = spark.createDataFrame([(i, f"archetype_{i}", [float(i), 0.0]) for i in range(1, 12)], "arch_id int, arch_name string, position array<double>")
    assert plotdata.lines(a).select("a", "b").distinct().count() == 55
    s = plotdata.structure(a)
    assert s.filter("dist is null").count() == 11 and s.count() == 121


def test_stream_scores_each_row(spark, tmp_path):
    x = frame(spark, points(50))
    x.withColumn("t", F.timestamp_seconds("sample_id")).write.parquet(str(tmp_path / "in"))
    a = spark.createDataFrame([("p", [5.0, 0.0]), ("q", [-30.0, -20.0])], "arch string, position array<double>")
    s = spark.readStream.schema("sample_id int, features array<double>, t timestamp").parquet(str(tmp_path / "in"))
    q = score.to_parquet(score.nearest(s, a), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 50 and got.filter("arch is null").count() == 0


def test_obo_and_delimited_sources(spark, tmp_path):
    (tmp_path / "o.obo").write_text("format-version: 1\n\n[Term]\nid: GO:1\nname: one\nis_a: GO:2 ! two\n\n[Term]\nid: XX:9\nname: no\n\n[Typedef]\nid: GO:7\n")
    got = matrix.read_obo(spark, str(tmp_path / "o.obo")).collect()
    assert [(r.id, r["name"], r.parents) for r in got] == [("GO:1", "one", ["GO:2"])]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert matrix.read_delimited(spark, str(tmp_path / "t.tsv")).first().asDict() == {"a": "1", "b": "x"}


def test_neighbours_against_brute_force(spark, monkeypatch):
    from vertexlake.operators import neighbours

    x = points(120, seed=9)
    d = np.sqrt(((x[:, :, None] - x[:, None, :]) ** 2).sum(0))
    for size in (2_000_000, 60):
        monkeypatch.setattr(neighbours, "BLOCK", size)
        got = {(r.sample_id, r.place): r.neighbour for r in neighbours.knn(frame(spark, x), 5).collect()}
        assert all(got[i, p + 1] == j for i in range(120) for p, j in enumerate(np.argsort(d[i], kind="stable")[:5]))
    near = neighbours.knn(frame(spark, x), 5)
    sets_ = {i: {got[i, p] for p in range(1, 6)} for i in range(120)}
    w = {(r.a, r.b): r.weight for r in neighbours.shared_neighbours(near).collect()}
    assert all(math.isclose(v, len(sets_[a] & sets_[b]) / len(sets_[a] | sets_[b])) for (a, b), v in w.items())
    assert neighbours.knn(frame(spark, x).limit(0), 5).count() == 0


def test_pcha_of_a_dictionary_and_targets():
    x = points(300)
    f = pcha.pcha(x, 3, seed=1, dictionary=list(range(100)), targets=list(range(50, 300)))
    assert f.c.shape == (100, 3) and f.s.shape == (3, 250) and f.varexpl > 0.95
    w = pcha.least_squares_weights(x[:, :4], TRIANGLE.T[:, :2])
    assert np.allclose(TRIANGLE.T[:, :2] @ w, x[:, :4])


def test_every_public_name_is_there_and_prediction_runs(spark):
    from vertexlake import api

    dist = spark.createDataFrame([("a", i, float(i)) for i in range(40)], "arch string, sample_id int, dist double")
    long = spark.createDataFrame([(i, f, float(i if f == "f" else -i)) for i in range(40) for f in "fg"], "sample_id int, feature string, value double")
    p = api.predict(dist, long, np.eye(2), np.zeros(2), ["f", "g"], n_bins=4)
    assert p.count() == 4 and p.filter("pred_class in (1, 2)").count() == 4


def test_nulls_empty_tables_and_repeats_do_not_crash(spark):
    e = spark.createDataFrame([], "sample_id int, feature string, value double")
    b = spark.createDataFrame([], "arch string, sample_id int")
    assert ranktest.find_decreasing_wilcox(e, b).count() == 0
    assert ranktest.adjust_p(spark.createDataFrame([], "p double")).count() == 0
    assert sets.auc_scores(e, spark.createDataFrame([], "set_id string, gene string"), 5).count() == 0
    assert models.deviance(e, 0).count() == 0
    d = spark.createDataFrame([], "sample_id int, arch string, dist double")
    assert bins.bins_by_share(d).count() == 0 and distance.rank_distances(d).count() == 0
    one = spark.createDataFrame([(1, "f", 2.0)], "sample_id int, feature string, value double")
    assert ranktest.rank_statistics(one, spark.createDataFrame([("a", 1)], "arch string, sample_id int")).first().z is None
    s = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0])], "sample_id int, features array<double>")
    assert fit.fit_table(s, 2).archetypes.count() == 0
    assert sketch.sketch(s, 3).count() == 0
    n = spark.createDataFrame([("a", None, 1.0), (None, 1, None)], "arch string, sample_id int, dist double")
    assert bins.equal_bins(n, ["arch"], "dist", ["sample_id"], 3).count() == 2
