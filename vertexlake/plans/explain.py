"""Queries that explain archetypes: distances, bins, rank tests, corrections, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlake.functions import ranks
from vertexlake.operators import bins, distance, ranktest
from vertexlake.plans import sqlviews as v
from vertexlake.session import cut
from vertexlake.sources import matrix

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def arch_of(spark: SparkSession, d: str) -> DataFrame:
    e = matrix.embeddings(spark, d).filter("sample_id < 3")
    return e.select((F.col("sample_id") + 1).cast("int").alias("arch_id"), F.concat(F.lit("archetype_"), F.col("sample_id") + 1).alias("arch"), F.col("features").alias("position"))


def emb_dist(spark: SparkSession, d: str) -> DataFrame:
    return distance.arch_dist(matrix.embeddings(spark, d), arch_of(spark, d), digits=6)


def emb_bins(spark: SparkSession, d: str) -> DataFrame:
    return bins.bins_by_share(emb_dist(spark, d), 0.1)


def emb_tests(spark: SparkSession, d: str) -> DataFrame:
    return ranktest.rank_statistics(matrix.to_long(matrix.embeddings(spark, d)), emb_bins(spark, d))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, so that the order of summation does not show."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


NAMES = ["archetype_1", "archetype_2", "archetype_3"]
_R = "round(u, 6) as u, round(z, 6) as z, round(mean_diff, 6) as mean_diff, round(top_bin_mean, 6) as top_bin_mean"


@query(f"with {v.EMB}, {v.ARCH}, {v.DIST} select * from dist")
def arch_dist_emb(spark: SparkSession, d: str) -> DataFrame:
    return emb_dist(spark, d)


@query(f"""with {v.EMB}, {v.ARCH}, {v.DIST} select sample_id, arch,
  round((rank() over (partition by arch order by dist) + (count(*) over (partition by arch, dist) - 1) / 2.0::double) / count(*) over (partition by arch), 6) as dist from dist""")
def arch_dist_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distance.rank_distances(emb_dist(spark, d)))


@query(f"with {v.EMB_ALL} select * from bins")
def bins_prop(spark: SparkSession, d: str) -> DataFrame:
    return emb_bins(spark, d)


@query(f"with {v.EMB}, {v.ARCH}, {v.DIST} select arch, sample_id from dist where dist < 1.3")
def bins_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return bins.bins_by_cutoff(emb_dist(spark, d), 1.3)


@query(f"""with {v.EMB_ALL} select b.arch, 'cell_' || b.sample_id as name, e.label from bins b join emb e using (sample_id)""")
def bins_names(spark: SparkSession, d: str) -> DataFrame:
    e = matrix.embeddings(spark, d).select("sample_id", "label")
    return emb_bins(spark, d).join(e, "sample_id").select("arch", F.concat(F.lit("cell_"), "sample_id").alias("name"), "label")


@query(f"""with {v.EMB}, {v.ARCH}, {v.DIST}, wide as (select sample_id, max(case when arch = 'archetype_1' then dist end) as archetype_1,
  max(case when arch = 'archetype_2' then dist end) as archetype_2, max(case when arch = 'archetype_3' then dist end) as archetype_3 from dist group by 1)
select w.*, round(e.f[1], 6) as "V1", round(e.f[2], 6) as "V2", c.c_mktsegment as segment from wide w left join emb e on e.sample_id = w.sample_id and e.label < 5
left join customer c on c.c_custkey = w.sample_id""")
def merge_dist_left(spark: SparkSession, d: str) -> DataFrame:
    e = matrix.embeddings(spark, d).filter("label < 5").select("sample_id", F.round(F.col("features")[0], 6).alias("V1"), F.round(F.col("features")[1], 6).alias("V2"))
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return distance.merge_distances(emb_dist(spark, d), NAMES, e, c, "c_custkey")


@query(f"""with {v.EMB_ALL}, {v.EMB_LONG}, {v.rank_test('long_')} select x_name, y_name, sample_count, {_R} from tests""")
def wilcox_emb(spark: SparkSession, d: str) -> DataFrame:
    return rounded(emb_tests(spark, d))


def _cnt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All (user, event type) counts with zeros, and the tenth of users nearest the first user's counts."""
    c = matrix.event_counts(spark, d)
    long = cut(matrix.zero_filled(c))
    x = long.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("l")).select("sample_id", F.transform("l", lambda e: e["value"]).alias("features"))
    first = x.orderBy("sample_id").limit(1).select(F.lit("archetype_1").alias("arch"), F.col("features").alias("position"))
    return long, bins.bins_by_share(distance.arch_dist(x, first, 6))


_CNT_BINS = """first_ as (select feature, value from cnt_long where sample_id = (select min(sample_id) from cnt_long)),
cdist as (select c.sample_id, 'archetype_1' as arch, round(sqrt(sum((c.value - f.value) * (c.value - f.value))), 6) as dist from cnt_long c join first_ f using (feature) group by 1),
bins as (select arch, sample_id from (select *, row_number() over (order by dist, sample_id) as rn, count(*) over () as n from cdist) where rn <= round_even(n * 0.1, 0))"""


@query(f"""with {v.CNT}, {v.CNT_FULL}, {_CNT_BINS}, {v.rank_test('cnt_long')} select x_name, y_name, sample_count, {_R} from tests""")
def wilcox_ties_cnt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranktest.rank_statistics(*_cnt(spark, d)))


@query(f"""with {v.CNT}, {v.CNT_FULL}, {_CNT_BINS} select 'archetype_1' as x_name, feature as y_name,
  round(median(case when b.sample_id is not null then value end) - median(case when b.sample_id is null then value end), 6) as median_diff
from cnt_long c left join bins b on b.sample_id = c.sample_id group by feature""")
def median_diff_cnt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranktest.median_differences(*_cnt(spark, d)))


@query(f"""with {v.EMB_ALL}, {v.EMB_LONG}, two as (select * from bins where arch <> 'archetype_3'),
rows_ as (select l.sample_id || '|' || b.arch as sample_id, l.feature, l.value from long_ l join two b on b.sample_id = l.sample_id),
tbins as (select a.arch, a.sample_id || '|' || b.arch as sample_id from two a join two b on a.sample_id = b.sample_id),
{v.rank_test('rows_', 'tbins')} select x_name, y_name, sample_count, {_R} from tests""")
def tradeoff_emb(spark: SparkSession, d: str) -> DataFrame:
    b = emb_bins(spark, d).filter("arch <> 'archetype_3'")
    return rounded(ranktest.rank_statistics(*ranktest.tradeoff(matrix.to_long(matrix.embeddings(spark, d)), b)))


_P = "pv as (select x_name, y_name, p from (select *, row_number() over (partition by x_name, y_name order by loaded_at, p) as rn from rank_test where p >= 0 and p <= 1 and not isnan(p) and x_name is not null and y_name is not null) where rn = 1)"


def _pvalues(spark: SparkSession, d: str) -> DataFrame:
    """The first valid result of each pair."""
    t = spark.read.parquet(f"{d}/rank_test.parquet").filter("p between 0 and 1 and not isnan(p) and x_name is not null and y_name is not null")
    best = F.min(F.struct("loaded_at", "p", "median_diff", "mean_diff", "top_bin_mean", "sample_count", "metric")).alias("m")
    return t.groupBy("x_name", "y_name").agg(best).select("x_name", "y_name", "m.*")


_ADJ = """adj as (select *, least(1.0::double, min(p * n / rn) over (order by rn rows between current row and unbounded following)) as p_adj from (
  select *, row_number() over (order by p, x_name, y_name) as rn, count(*) over () as n from pv))"""


@query(f"with {_P}, {_ADJ} select x_name, y_name, round(p_adj, 9) as p_adj from adj")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranktest.adjust_p(_pvalues(spark, d).select("x_name", "y_name", "p"), ties=["x_name", "y_name"]).drop("p"), 9)


_PF = _P.replace("select x_name, y_name, p from", "select x_name, y_name, p, mean_diff from").replace("where rn = 1", "where rn = 1 and metric = 'wilcoxon_p_val'").replace("order by loaded_at, p)", "order by loaded_at, p, median_diff, mean_diff)")
_TOP = f"{_PF}, {_ADJ}, top as (select *, row_number() over (partition by x_name order by mean_diff desc nulls last, y_name) as place from adj where p_adj < 0.01 and mean_diff > 0.3)"


@query(f"with {_TOP} select x_name, y_name, place, round(mean_diff, 6) as mean_diff from top where place <= 12")
def top_genes(spark: SparkSession, d: str) -> DataFrame:
    x = ranktest.select_top(_pvalues(spark, d)).filter("place <= 12")
    return rounded(x.select("x_name", "y_name", F.col("place").cast("bigint").alias("place"), "mean_diff"))


@query(f"""with {_TOP}, g as (select x_name, string_agg(y_name, ', ' order by place) as genes from top where place <= 12 and x_name < 'm' group by 1),
s as (select x_name, string_agg(y_name, ', ' order by place) as sets from top where place <= 3 and x_name > 'd' group by 1)
select coalesce(g.x_name, s.x_name) as x_name, genes, sets from g full join s on g.x_name = s.x_name""")
def top_labels_full_join(spark: SparkSession, d: str) -> DataFrame:
    top = ranktest.select_top(_pvalues(spark, d))
    return ranktest.join_labels(ranktest.labels(top.filter("x_name < 'm'"), 12, "genes"), ranktest.labels(top.filter("x_name > 'd'"), 3, "sets"))


@query("""with ranked as (select event_id, event_type, row_number() over (partition by event_type order by value, event_id) as rn, count(*) over (partition by event_type) as n from events),
b as (select event_id, event_type, least(10, ceil(rn / round_even(n / 10.0::double, 0)))::int as bin from ranked)
select event_id, event_type, case bin when 1 then 1 when 2 then 1 when 9 then 2 when 10 then 2 end as bin from b where bin in (1, 2, 9, 10)""")
def equal_bins(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    b = bins.equal_bins(e, ["event_type"], "value", ["event_id"], 10)
    return bins.choose_bins(b, [1, 2, 9, 10], [1, 1, 0, 0, 0, 0, 0, 0, 2, 2]).select("event_id", "event_type", "bin")


@query("select l_returnflag, value, n, round(rank, 6) as rank from (select l_returnflag, l_quantity as value, count(*) as n, min(rk) + (count(*) - 1) / 2.0::double as rank from (select *, rank() over (partition by l_returnflag order by l_quantity) as rk from lineitem) group by 1, 2)")
def value_ranks(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("value", F.col("l_quantity"))
    return ranks.value_ranks(x, ["l_returnflag"], "value").select("l_returnflag", "value", "n", "rank")


@query(f"""with {v.EMB_ALL}, {v.EMB_LONG}, {v.rank_test('long_')}, t as (select x_name, y_name, round(z, 6) as z, round(mean_diff, 6) as mean_diff,
  row_number() over (partition by x_name order by round(z, 6) desc, y_name) as place from tests) select * from t where place <= 5""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which features are highest near each archetype: distances, bins, rank tests, the five first."""
    from pyspark.sql import Window

    t = rounded(emb_tests(spark, d)).select("x_name", "y_name", "z", "mean_diff")
    n = F.row_number().over(Window.partitionBy("x_name").orderBy(F.col("z").desc(), "y_name"))
    return t.withColumn("place", n.cast("bigint")).filter("place <= 5")
