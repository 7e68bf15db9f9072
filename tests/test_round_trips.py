"""Operators that SQL cannot say: against brute force, round trips and known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexlake import api
from vertexlake.operators import archetypes, fit, gam, geometry, models, sets
from vertexlake.plans import catalogue
from vertexlake.sources import matrix
from vertexlake.session import cut


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id bigint, features array<double>")


@pytest.mark.parametrize("method", ["pcha", "kmeans", "louvain"])
def test_fits_work_without_arrow(spark, method):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        f = fit.fit_table(vectors(spark, x), 3, method=method)
        assert f.archetypes.count() == 3 and f.summary.first().method == method
        w = f.weights.collect()
        assert len(w) == 120 and all(math.isclose(sum(r.weights), 1, abs_tol=1e-6) for r in w)
        assert f.coeffs.count() == 120
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)


def test_the_commonest_size_of_vector_counts(spark):
    x = vectors(spark, np.ones((50, 3))).unionByName(vectors(spark, np.ones((1, 1)), 50)).unionByName(vectors(spark, np.ones((2, 5)), 60))
    bad = spark.createDataFrame([(90, None), (91, [1.0, float("nan"), 1.0]), (92, [1.0, None, 2.0])], "sample_id bigint, features array<double>")
    good, n, dims = fit.whole_rows(x.unionByName(bad))
    assert (good.count(), n, dims) == (50, 50, 3) and fit.whole_rows(x, 5)[1] == 2 and fit.whole_rows(x.limit(0))[1:] == (0, 0)
    got = {(r["size"], r.finite): r.n for r in fit.left_out(x.unionByName(bad), 3).collect()}
    assert got == {(1, True): 1, (5, True): 2, (None, False): 1, (3, False): 2}


def test_hull_of_tables_with_empty_partitions_and_broken_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (200, 2))
    x[:4] = [[0, 0], [1, 0], [0, 1], [1, 1]]
    df = vectors(spark, x).unionByName(spark.createDataFrame([(900, [float("nan"), 1.0]), (901, None), (902, [5.0]), (903, [1.0, None])], "sample_id bigint, features array<double>"))
    for parts, batch in ((300, 50_000), (3, 20), (1, 7)):
        monkeypatch.setattr(geometry, "HULL_BATCH", batch)
        volume, area, ids = geometry.table_hull(df.repartition(parts), 2)
        assert math.isclose(volume, 1.0) and math.isclose(area, 4.0) and sorted(ids) == [0, 1, 2, 3]
    flat = vectors(spark, [[1.0, 2.0]] * 30)
    assert math.isnan(geometry.table_hull(flat, 2)[0]) and geometry.table_hull(flat.limit(0), 2)[2] == []


def test_permutations_of_rows_and_weighted_draws(spark):
    table = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0]), ("b", [5.0] * 3), ("c", None), ("d", [])], "feature string, values array<double>")
    got = {r.feature: r["values"] for r in archetypes.permute_rows(table, 3).collect()}
    assert sorted(got["a"]) == [1, 2, 3, 4] and got["b"] == [5.0] * 3 and got["c"] is None and got["d"] == []
    again = {r.feature: r["values"] for r in archetypes.permute_rows(table.repartition(3), 3).collect()}
    assert again == got and any({r.feature: r["values"] for r in archetypes.permute_rows(table, 3, k).collect()}["a"] != got["a"] for k in range(1, 6))
    long = spark.range(4000).select(F.col("id").alias("sample_id"), F.lit("f").alias("feature"), (F.col("id") % 2).cast("double").alias("value"))
    w = spark.range(4000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 2 == 1, 3.0).otherwise(1.0).alias("weight"))
    drawn = archetypes.permute_features(long, 5, replace=True, weights=w)
    assert drawn.count() == 4000 and abs(drawn.agg(F.avg("value")).first()[0] - 0.75) < 0.03
    dealt = archetypes.permute_features(long, 5, weights=w)
    assert dealt.count() == 4000 and dealt.agg(F.sum("value")).first()[0] == 2000


def test_bootstrap_inside_permutations(spark):
    x = vectors(spark, np.random.default_rng(2).normal(size=(80, 2)))
    s = fit.permuted(x, [3], n=2, bootstrap_n=3, ratio="none", maxiter=30).summary.collect()
    assert len(s) == 2 and all(r.total_var is not None and r.total_var >= 0 for r in s)
    assert all(r.total_var is None for r in fit.permuted(x, [3], n=1, ratio="none", maxiter=20).summary.collect())
    d, p = fit.significance(x, fit.k_sweep(x, [3], ratio="none"), n=2, columns=("varexpl", "total_var"), bootstrap_n=2, ratio="none", maxiter=20)
    assert {r.var_name for r in p.collect()} == {"varexpl", "total_var"}


def test_dimension_significance_keeps_both_sides(spark):
    t = "k int, replicate int, arch_id int, position array<double>"
    obs = spark.createDataFrame([(3, 0, 1, [0.0, 1.0]), (3, 0, 2, [4.0, 1.0]), (4, 0, 1, [1.0]), (4, 0, 2, [2.0])], t)
    rand = spark.createDataFrame([(3, r, a, [float(a), float(a)]) for r in range(5) for a in (1, 2)] + [(5, 0, 1, [1.0]), (5, 0, 2, [2.0])], t)
    got = {(r.k, r.var_name): r.p_value for r in fit.dimension_significance(obs, rand)[1].collect()}
    assert got == {(3, "V1"): 0.2, (3, "V2"): 0.8, (4, "V1"): None, (5, "V1"): None}


def test_ontology_closure_and_propagation(spark, tmp_path):
    (tmp_path / "o.obo").write_bytes(b"format-version: 1\r\n\r\n[Term]\r\nid: GO:1\r\nname: one\r\nis_a: GO:2 ! two\r\nis_a: GO:3\r\n\r\n[Term]\r\nid: GO:2\r\nname: two\r\nis_a: GO:4\r\n\r\n[Term]\r\nid: GO:3\r\nis_a: GO:4\r\n\r\n[Term]\r\nid: GO:4\r\nname: top\r\n\r\n[Typedef]\r\nid: GO:9\r\n")
    terms = matrix.read_obo(spark, str(tmp_path / "o.obo"))
    assert {(r.id, r["name"], tuple(r.parents)) for r in terms.collect()} == {("GO:1", "one", ("GO:2", "GO:3")), ("GO:2", "two", ("GO:4",)), ("GO:3", "", ("GO:4",)), ("GO:4", "top", ())}
    up = {(r.id, r.ancestor) for r in sets.ancestors(terms).collect()}
    assert up == {("GO:1", x) for x in ("GO:1", "GO:2", "GO:3", "GO:4")} | {("GO:2", "GO:2"), ("GO:2", "GO:4"), ("GO:3", "GO:3"), ("GO:3", "GO:4"), ("GO:4", "GO:4")}
    a = spark.createDataFrame([("GO:1", "g"), ("GO:7", "h"), ("GO:2", "g")], "set_id string, gene string")
    assert {tuple(r) for r in sets.propagate(a, terms).collect()} == {("GO:1", "g"), ("GO:2", "g"), ("GO:3", "g"), ("GO:4", "g"), ("GO:7", "h")}
    ring = spark.createDataFrame([("a", ["b"]), ("b", ["a"]), (None, ["a"])], "id string, parents array<string>")
    assert {tuple(r) for r in sets.ancestors(ring).collect()} == {(x, y) for x in "ab" for y in "ab"}


def test_activity_by_kind_of_table_and_lookup(spark):
    long = spark.createDataFrame([(1, "g1", 5.0), (1, "g2", 3.0), (2, "g3", 4.0), (2, "g1", 1.0)], "sample_id int, feature string, value double")
    cat = spark.createDataFrame([("u1, u2", "t1, t2", "g1 - g2", "intron"), ("u2", "t2", "g3", "exon"), ("u3", "t3", "zz", "exon")], "MAPPED_TRAIT_URI string, MAPPED_TRAIT string, MAPPED_GENE string, CONTEXT string")
    assert {r.set_id for r in sets.activity_of(long, "gwas", cat, max_share=1.0).collect()} == {"u1", "u2"}
    assert {r.set_id for r in sets.activity_of(long, "gwas", cat, context=["exon"], max_share=1.0).collect()} == {"u2"}
    t = spark.createDataFrame([("s", "g1"), ("s", "other"), ("q", "g1")], "set_id string, gene string")
    assert {r.set_id for r in sets.activity_of(long, "promoter_TF", t, lower=2, max_share=1.0).collect()} == {"s"}
    assert sets.activity_of(long, "custom", t, lower=2, max_share=1.0).count() == 0
    with pytest.raises(ValueError):
        sets.activity_of(long, "nothing", t)
    hub = spark.createDataFrame([("x", 10090, "OrgDb")], "title string, taxonomyid int, rdataclass string")
    assert api.catalogue_lookup(hub, 10090, "OrgDb").count() == 1
    with pytest.raises(LookupError):
        api.catalogue_lookup(hub, 9606, "OrgDb")


def test_curves_with_points_and_bands(spark):
    dist = spark.range(60).select(F.col("id").alias("sample_id"), F.lit("archetype_1").alias("arch"), (F.col("id") / 60).alias("dist"))
    long = dist.select("sample_id", F.lit("f").alias("feature"), (1 - F.col("dist")).alias("value"))
    d = gam.find_decreasing(dist, long, n_points=20)["derivs"]
    c = gam.curve_with_points(d, dist, long, "f", "archetype_1").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in c} == {"fit": 20, "data": 60}
    assert gam.derivative_band(d).filter("low <= deriv and deriv <= high").count() == 20
    assert abs(d.agg(F.avg("deriv")).first()[0] + 1) < 0.01


def test_confusion_with_zeros_has_all_classes_however_many(spark):
    df = spark.range(30).select((F.col("id") % 3).alias("o"), F.col("id").alias("p"))
    x = models.confusion(df, "o", "p", zeros=True)
    assert x.count() == 90 and x.agg(F.sum("N")).first()[0] == 30


def test_shares_outside_0_to_1_are_refused(spark):
    d = spark.createDataFrame([("a", 1, 1.0)], "arch string, sample_id int, dist double")
    with pytest.raises(ValueError):
        api.bins_by_share(d, 1.5)


def test_a_loop_of_cuts_stays_quick_to_plan(spark):
    x = spark.range(50).select("id", (F.col("id") % 7).alias("v"))
    for _ in range(25):
        x = cut(x.join(x.select("id", F.col("v").alias("w")), "id").select("id", (F.col("v") + F.col("w")).alias("v")))
    assert x.count() == 50


@pytest.mark.parametrize("name,rows", [("k_sweep", 3), ("bootstrap_fit", 3), ("louvain", None), ("logistic_full", 640), ("logistic_fit", None), ("gam_fit", 768)])
def test_slow_queries_give_their_rows(spark, data, name, rows):
    got = catalogue.queries()[name](spark, data).toPandas()
    assert len(got) == rows if rows else len(got) > 3
