"""The queries of this subpackage, and their SQL where SQL can say the same on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlake.llm import bpe, diverse, markov, mixing, percentiles, termfreq, topn, truncation
from vertexlake.session import ship

#: Fixed values of the stated problems.
FRACTIONS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
TOP, CLUSTER_REACH, LONE_REACH, DIMS, SUBSET = 12, 0.5, 10.0, 8, 200


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _distances(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "data_attr").filter(F.trim("label") != "")
    return percentiles.usable(t, "label", "distance", "obs_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    p = percentiles.bisect(_distances(spark, d), [0.5, 0.95], bits=20)
    p = p.groupBy("g").agg(F.max(F.when(F.col("fraction") == 0.5, F.col("value"))).alias("mid"), F.max(F.when(F.col("fraction") == 0.95, F.col("value"))).alias("high"))
    return p.filter(F.col("high") > 4 * F.col("mid")).select(F.col("g").alias("label"))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = percentiles.bisect(_distances(spark, d), FRACTIONS)
    return p.select(F.col("g").alias("label"), "fraction", "n", "value")


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable form of each day of measurement, put together: relative error at most 2**-8."""
    t = _table(spark, d, "data_attr").filter(F.trim("label") != "")
    day = F.struct("label", F.to_date("measured_at").alias("day")).alias("lot")
    lots = percentiles.cells(percentiles.usable(t.select("obs_id", day, "distance"), "lot", "distance", "obs_id"))
    merged = percentiles.merge_cells(lots.withColumn("g", F.col("g.label")))
    return percentiles.percentiles_of_cells(merged, FRACTIONS).select(F.col("g").alias("label"), "fraction", "n", "value")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    t = topn.top_n(_table(spark, d, "rank_test"), "x_name", "y_name", "p", TOP)
    return t.select(F.col("g").alias("x_name"), F.col("y").alias("y_name"), F.col("s").alias("p"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top(spark, d).select("x_name", "y_name")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    a = diverse.latest_vectors(_table(spark, d, "data_matrix"), "sample_id", "features", DIMS, "loaded_at")
    b = diverse.latest_vectors(_table(spark, d, "pch_fit"), "arch_key", "xc", DIMS)
    return a.withColumn("space", F.lit("data_matrix")).unionByName(b.withColumn("space", F.lit("pch_fit")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = markov.cluster(_vectors(spark, d), DIMS, CLUSTER_REACH)
    return members.filter("cluster_key <> member_key").select("cluster_key", "member_key")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each cluster."""
    return markov.cluster(_vectors(spark, d), DIMS, CLUSTER_REACH)[1]()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.frequencies(_table(spark, d, "annot_dt"), "annot_id", ["alias", "goall"], version="loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_counts(spark, d).filter("mark is not null").select("field", "value_norm")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return diverse.latest_vectors(_table(spark, d, "data_matrix"), "sample_id", "features", DIMS, "loaded_at")


def p5_select(spark: SparkSession, d: str) -> DataFrame:
    s = diverse.select(_samples(spark, d), SUBSET)
    return s.select(F.col("key").alias("sample_id"), "place", F.round("gain", 9).alias("gain"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = diverse.cut(_samples(spark, d))
    chosen = diverse.select(rows, None, LONE_REACH)
    return diverse.alone(rows, chosen, LONE_REACH).select(F.col("key").alias("sample_id"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_table(spark, d, "documents"), keep=["doc_id"])


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return mixing.plan_mixture(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[2].filter("short").select("source")


def p7_messages(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[2]


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture itself: the pieces of messages in each slot."""
    return mixing.mixture(*_mix(spark, d))


def p7_slots(spark: SparkSession, d: str) -> DataFrame:
    """The schedule of the targets alone, in 4096 slots."""
    return mixing.slots(mixing._targets(_table(spark, d, "mix_targets")), 4096)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(_table(spark, d, "documents"))[0].filter("truncated").select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.judge(_table(spark, d, "documents"))[0])


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(_table(spark, d, "documents"))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_USABLE = """usable as (
  select distinct case when obs_id is null then -1 - row_number() over () else obs_id end as obs_id, label, distance + 0.0 as distance
  from data_attr where label is not null and trim(label) <> '' and distance >= 0 and distance < 'infinity'::double and not isnan(distance))"""
_LATEST = """latest as (
  select sample_id as key, features as v from (
    select *, row_number() over (partition by sample_id order by loaded_at desc nulls last, features) as rn from data_matrix where sample_id is not null)
  where rn = 1 and len(features) = 8 and len(list_filter(features, lambda x: x is null or isnan(x) or isinf(x))) = 0)"""
_PAIRS = """pairs as (
  select x_name, y_name, min(p + 0.0) as p from rank_test
  where x_name is not null and y_name is not null and p >= 0 and p <= 1 and not isnan(p) group by 1, 2),
ranked as (select *, row_number() over (partition by x_name order by p, y_name) as rn from pairs)"""
_TERMS = """rows_ as (
  select * from (select *, row_number() over (partition by annot_id order by loaded_at desc nulls last, alias, goall) as rn from annot_dt where annot_id is not null) where rn = 1),
cells as (select annot_id, 'alias' as field, alias as cell from rows_ union all select annot_id, 'goall', goall from rows_),
tokens as (select annot_id, field, upper(trim(x, ' ' || chr(9))) as value_norm from (
  select annot_id, field, unnest(string_split_regex(cell, '[,;|]')) as x from cells)),
counted as (select field, value_norm, count(*) as n_occurrences, count(distinct annot_id) as n_records,
  case when count(distinct annot_id) < 3 then 'rare' when count(distinct annot_id) > 0.05 * (select count(*) from rows_) then 'common' end as mark
  from tokens where value_norm not in ('', 'NA', 'N/A') group by 1, 2)"""


def oracle_sql() -> dict[str, str]:
    fractions = ", ".join(f"({q}::double)" for q in FRACTIONS)
    return {
        "p1_found": f"with {_USABLE} select label from usable group by label having quantile_cont(distance, 0.95) > 4 * quantile_cont(distance, 0.5)",
        "p1_percentiles": f"""with {_USABLE}, ranked as (
  select label, distance, row_number() over (partition by label order by distance) as rn, count(*) over (partition by label) as n from usable)
  select label, fraction, n, distance as value from ranked, (values {fractions}) as f(fraction) where rn = greatest(1, ceil(fraction * n))""",
        "p2_found": f"with {_PAIRS} select x_name, y_name from ranked where rn <= 12",
        "p2_top": f"with {_PAIRS} select x_name, y_name, p from ranked where rn <= 12",
        "p3_found": f"""with recursive {_LATEST}, v as (
  select 'm' as space, key, v from latest union all
  select 'p', arch_key, min(xc) from pch_fit where arch_key is not null and len(xc) = 8 and len(list_filter(xc, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by 2),
links as (select a.space, a.key as a, b.key as b from v a join v b on a.space = b.space and a.key <> b.key and abs(a.v[1] - b.v[1]) <= 0.5 and list_distance(a.v, b.v) <= 0.5),
reach as (select space, a, b from links union select r.space, r.a, l.b from reach r join links l on r.space = l.space and r.b = l.a)
select least(a, min(b)) as cluster_key, a as member_key from reach group by space, a having min(b) < a""",
        "p4_found": f"with {_TERMS} select field, value_norm from counted where mark is not null",
        "p4_counts": f"with {_TERMS} select * from counted",
        "p7_slots": """with t as (select source, sum(target_share) as share from mix_targets where source is not null group by 1 having sum(target_share) > 0),
c as (select source, sum(share) over (order by source rows unbounded preceding) as z, share, sum(share) over () as total from t),
s as (select i as slot, list_sum(list_transform(range(0, 40), lambda b: ((i >> b) & 1) / (1::bigint << (b + 1))::double)) as u from range(0, 4096) r(i))
select slot, source, row_number() over (partition by source order by slot) - 1 as rank from s join c on u >= (z - share) / total and u < z / total""",
        "p5_found": f"""with {_LATEST} select a.key as sample_id from latest a
  where not exists (select 1 from latest b where a.key <> b.key and list_distance(a.v, b.v) <= 10)""",
    }
