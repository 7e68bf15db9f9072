import duckdb
import pytest

from vertexlake.llm import queries

TABLES = ["data_attr", "rank_test", "data_matrix", "pch_fit", "annot_dt", "mix_targets", "documents"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, data).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_run(spark, data, name):
    if name == "p6_ids" or name.startswith("p7"):
        pytest.importorskip("tiktoken")
    assert queries.queries()[name](spark, data).count() >= 0
