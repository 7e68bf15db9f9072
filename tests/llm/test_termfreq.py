import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vertexlake.llm.termfreq import frequencies


def values(cell):
    return [v for v in (x.strip(" \t").upper() for x in re.split("[,;|]", cell or "")) if v not in ("", "NA", "N/A")]


def test_against_sets_of_records(spark):
    rng = random.Random(2)
    pool = ["hot", "Hot ", "\thot", "rare", "n/a", "NA", "", " ", *[f"v{k}" for k in range(30)]]
    rows = []
    for i in range(400):
        cell = lambda: None if rng.random() < 0.1 else rng.choice(",;|").join(rng.choice(pool[:6] + pool) for _ in range(rng.randrange(4)))
        rows.append((i, cell(), cell(), 1, "x", "y", 7))
    rows += [(i, a, b, 2, "x", "y", 7) for i, a, b, *_ in rows[:100]]
    rows.append((400, "hot," * 20_000, None, 1, "x", "y", 7))
    df = spark.createDataFrame(rows, "id int, alias string, goall string, t int, field string, value string, record int")
    last = {r[0]: r for r in rows}
    occ, rec = Counter(), defaultdict(set)
    for i, a, b, *_ in last.values():
        for f, cell in (("alias", a), ("goall", b)):
            for v in values(cell):
                occ[f, v] += 1
                rec[f, v].add(i)
    got = {(r.field, r.value_norm): (r.n_occurrences, r.n_records, r.mark) for r in frequencies(df, "id", ["alias", "goall"], "t", salts=3).collect()}
    mark = lambda n: "rare" if n < 3 else "common" if n > 0.05 * len(last) else None
    assert got == {k: (occ[k], len(rec[k]), mark(len(rec[k]))) for k in occ}


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a,A"), (5, None)], "id bigint, alias string")
    r = frequencies(df, "id", ["alias"]).collect()
    assert [(x.value_norm, x.n_occurrences, x.n_records) for x in r] == [("A", 3, 2)]
    assert frequencies(df.limit(0), "id", ["alias"]).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "a")], "id string, alias string")
    r = frequencies(df, "id", ["alias"]).first()
    assert (r.n_occurrences, r.n_records) == (3, 2)


def test_text_ids_are_kept_and_null_ids_are_records_of_their_own(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "a"), ("", "a"), ("x", "a,a"), ("x", "b"), ("y", "b")], "id string, v string")
    got = {r.value_norm: (r.n_occurrences, r.n_records) for r in frequencies(df, "id", ["v"]).collect()}
    assert got == {"A": (6, 5), "B": (2, 2)}
    marks = {r.value_norm: r.mark for r in frequencies(df, "id", ["v"], min_records=1, max_share=0.5).collect()}
    assert marks == {"A": "common", "B": None}  # 5 and 2 of 6 records


def test_counts_do_not_depend_on_batches_or_salts(spark):
    df = spark.range(3000).select((F.col("id") % 700).cast("string").alias("id"), F.concat_ws(";", F.concat(F.lit("v"), F.col("id") % 3), F.lit("hot"), F.lit("hot")).alias("v"))
    want = None
    for batch, salts in ((10_000, 16), (7, 1), (64, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(r.value_norm, r.n_occurrences, r.n_records) for r in frequencies(df, "id", ["v"], salts=salts).collect()}
        want = want or got
        assert got == want and ("HOT", 6000, 700) in got
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
