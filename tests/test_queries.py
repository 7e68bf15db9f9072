"""Every core query equals its SQL on the smallest tables; those without SQL run."""

import math
import os

import duckdb
import pandas as pd
import pytest

from vertexlake.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


def plain(v):
    if pd.isna(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-5)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, data, con, name):
    want = con.execute(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(near(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("name", ["pcha_tri", "kmeans_emb", "svd_project", "pinv_activity", "poisson_map", "hull", "sketch_sample", "plot_points", "rank_probabilities", "weighted_sample"])
def test_other_query_runs(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0
