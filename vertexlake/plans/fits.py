"""Queries of fits and other iterative work: no SQL can say them, tests check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlake.operators import archetypes, fit, gam, geometry, models, plotdata, project, sets, sketch
from vertexlake.plans import sqlviews as v
from vertexlake.plans.explain import arch_of, emb_dist, emb_tests, rounded
from vertexlake.session import cut
from vertexlake.sources import matrix

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def equals(sql: str):
    """A query that SQL can say after all."""

    def add(f):
        SQL[f.__name__] = sql
        return f

    return add


TRIANGLE = [[5.0, 0.0], [-10.0, 15.0], [-30.0, -20.0]]


def _triangle(spark: SparkSession) -> DataFrame:
    return matrix.generate_data(spark, TRIANGLE, 10_000, jitter=0.04, size=0.99)


def samples_of(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of data_matrix that are whole, one for each sample."""
    x = spark.read.parquet(f"{d}/data_matrix.parquet")
    good = x.filter((F.size("features") == 8) & ~F.exists("features", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return good.groupBy("sample_id").agg(F.max_by("features", F.struct("loaded_at", "features")).alias("features"))


@query
def pcha_tri(spark: SparkSession, d: str) -> DataFrame:
    """Archetypes of a known triangle."""
    return fit.fit_table(_triangle(spark), 3).archetypes


@query
def pcha_distributed(spark: SparkSession, d: str) -> DataFrame:
    """Archetypes of all samples in passes over the table."""
    return fit.fit_table(samples_of(spark, d), 3, strategy="distributed", conv=1e-3, maxiter=20).summary


@query
def kmeans_emb(spark: SparkSession, d: str) -> DataFrame:
    return fit.spark_kmeans(matrix.embeddings(spark, d), 4)


@query
def k_sweep(spark: SparkSession, d: str) -> DataFrame:
    return fit.k_sweep(samples_of(spark, d), [2, 3, 4], ratio="variance_ratio").summary


@query
def bootstrap_fit(spark: SparkSession, d: str) -> DataFrame:
    x = samples_of(spark, d)
    b = fit.bootstrap(x, [3], n=8)
    return fit.position_variance(b.archetypes, x)[0]


@query
def randomise_fit(spark: SparkSession, d: str) -> DataFrame:
    x = samples_of(spark, d)
    return fit.significance(x, fit.k_sweep(x, [3]), n=16)[1]


@query
def svd_project(spark: SparkSession, d: str) -> DataFrame:
    e = matrix.embeddings(spark, d)
    return project.to_components(e, project.fit_svd(e, 3))


@query
@equals(f"""with {v.QTY}, s as (select p_brand as set_id, p_partkey::varchar as gene from part where p_partkey::varchar in (select feature from qty)), n as (select set_id, count(*) as m from s group by 1),
got as (select q.sample_id, s.set_id, sum(q.value) as t from qty q join s on s.gene = q.feature group by 1, 2)
select i.sample_id, n.set_id, round(coalesce(t, 0) / m, 6) as score from (select distinct sample_id from qty) i cross join n left join got g on g.sample_id = i.sample_id and g.set_id = n.set_id""")
def pinv_activity(spark: SparkSession, d: str) -> DataFrame:
    """As every part is of one brand, the pseudo-inverse is a mean over the brand's parts."""
    return rounded(sets.pinv_scores(matrix.quantities(spark, d), matrix.part_sets(spark, d)))


@query
def poisson_map(spark: SparkSession, d: str) -> DataFrame:
    c = matrix.event_counts(spark, d)
    long = matrix.zero_filled(c)
    cov = long.select("sample_id").distinct().withColumn("x", F.array((F.col("sample_id") % 2).cast("double")))
    return models.poisson_regression(long, cov)


@query
def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    e = matrix.embeddings(spark, d)
    w, b = models.coefficients(models.fit_softmax(e, "features", "label", kind="l2", rounds=20))
    return models.confusion(models.classify(e.withColumn("probabilities", models.probabilities(F.col("features"), w, b))), "label", "pred_class")


@query
def logistic_full(spark: SparkSession, d: str) -> DataFrame:
    e = matrix.embeddings(spark, d)
    w, _, _ = models.fit_softmax_full(e, "features", "label", 10, epochs=10)
    return models.top_weights(models.weight_table(spark, w, [f"V{i}" for i in range(1, 65)]))


@query
def gam_fit(spark: SparkSession, d: str) -> DataFrame:
    long = matrix.to_long(matrix.embeddings(spark, d))
    return rounded(gam.find_decreasing(emb_dist(spark, d), long, n_points=50)["summary"])


@query
def hull(spark: SparkSession, d: str) -> DataFrame:
    volume, area, ids = geometry.table_hull(samples_of(spark, d), 3)
    return spark.createDataFrame([(volume, area, len(ids))], "volume double, area double, vertices int")


@query
def sketch_sample(spark: SparkSession, d: str) -> DataFrame:
    return sketch.sketch(samples_of(spark, d), 200)


@query
def louvain(spark: SparkSession, d: str) -> DataFrame:
    """The community of every sample: those of a sketch, carried to all by the nearest sample of the sketch."""
    samples = samples_of(spark, d)
    x = cut(sketch.sketch(samples, 500))
    return fit.carry_groups(samples, x, fit.fit_table(x, 6, method="louvain", ratio="none").weights)


@query
def umap(spark: SparkSession, d: str) -> DataFrame:
    a = arch_of(spark, d).withColumnRenamed("arch", "arch_name")
    return plotdata.embed(matrix.embeddings(spark, d), a, "umap", rounds=50)


@query
def tsne(spark: SparkSession, d: str) -> DataFrame:
    a = arch_of(spark, d).withColumnRenamed("arch", "arch_name")
    return plotdata.embed(matrix.embeddings(spark, d), a, "tsne", rounds=50)


@query
@equals("""select vec_id::varchar as id, 'data' as kind, 'data' as label, embedding[1]::double as x1, embedding[2]::double as x2, embedding[3]::double as x3 from embeddings union all
select 'archetype_' || (vec_id + 1), 'archetype', 'archetype_' || (vec_id + 1), embedding[1]::double, embedding[2]::double, embedding[3]::double from embeddings where vec_id < 3""")
def plot_points(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.points(matrix.embeddings(spark, d), arch_of(spark, d).withColumnRenamed("arch", "arch_name"), [1, 2, 3])


@query
@equals(f"""with {v.EMB_ALL}, {v.EMB_LONG}, {v.rank_test('long_')} select x_name, y_name,
  round(0.5::double - z / 3000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1001), lambda i: (case when i in (0, 1000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-(z * i / 1000) * (z * i / 1000) / 2))), 6) as p from tests""")
def rank_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """p of each rank test; the SQL integrates the normal density by Simpson's rule."""
    from vertexlake.operators.ranktest import upper_tail

    return rounded(emb_tests(spark, d).select("x_name", "y_name", upper_tail("z").alias("p")))


@query
@equals("""with k as (select c_custkey as sample_id, c_acctbal, -ln(greatest(('0x' || substr(md5(concat_ws('|', '435', 'weighted', c_custkey::varchar)), 1, 12))::bigint / 281474976710656.0::double, pow(16.0::double, -12))) / c_acctbal as key_ from customer where c_acctbal > 0)
select sample_id, c_acctbal from k order by key_, sample_id limit 100""")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("sample_id"), "c_acctbal")
    return archetypes.resample_weighted(x, 100, "c_acctbal")
