"""Queries whose SQL says the same in another way: known optima, invariants of fits, closures, draws by key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexlake.operators import archetypes as at
from vertexlake.operators import fit, models, project, sets, sketch
from vertexlake.plans import sqlviews as v
from vertexlake.plans.explain import rounded
from vertexlake.plans.fits import samples_of
from vertexlake.plans.tables import _FITS, _KEY, _fits
from vertexlake.session import cut
from vertexlake.sources import matrix

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: The whole vectors of data_matrix, one for each sample.
_WHOLE = """whole as (select sample_id, features as f from (select *, row_number() over (partition by sample_id order by loaded_at desc nulls last, features desc) as rn from data_matrix
  where len(features) = 8 and len(list_filter(features, lambda x: x is null or isnan(x) or isinf(x))) = 0) where rn = 1)"""


def _loss(x: DataFrame, f: fit.Fits) -> DataFrame:
    """(lost, least, weights): the sum of squares that archetypes and weights leave, from the tables alone, the least weight and the widest miss of a sum of 1."""
    a = f.archetypes.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("arch_id", "position"))).alias("l")).select(F.transform("l", lambda e: e["position"]).alias("p"))
    both = x.join(f.weights.select("sample_id", "weights"), "sample_id").join(F.broadcast(a))  # one row
    made = F.transform("features", lambda _, d: F.aggregate(F.zip_with("p", "weights", lambda q, w: q[d] * w), F.lit(0.0), lambda s, e: s + e))
    miss = F.aggregate(F.zip_with("features", made, lambda y, z: (y - z) * (y - z)), F.lit(0.0), lambda s, e: s + e)
    one = F.abs(F.aggregate("weights", F.lit(0.0), lambda s, e: s + e) - 1)
    return both.agg(F.sum(miss).alias("lost"), F.min(F.array_min("weights")).alias("least"), F.max(one).alias("off"), F.count("*").alias("n"))


@query(f"""with {_WHOLE} select method, strategy, n, true as weights_on_simplex, true as loss_as_told, true as near_local
from (values ('pcha', 'local'), ('pcha', 'distributed'), ('kmeans', 'local'), ('kmeans', 'distributed')) m(method, strategy), (select count(*) as n from whole)""")
def fit_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each method, in memory and in passes: all samples weighted, weights on the simplex, the told loss that of the tables, and no worse than 2 % above that in memory."""
    x = cut(samples_of(spark, d))
    out, local = [], {}
    for method, conv in (("pcha", {"conv": 1e-5}), ("kmeans", {"iter_max": 60})):
        for strategy in ("local", "distributed"):
            f = fit.fit_table(x, 3, method=method, strategy=strategy, ratio="none", **conv)
            told, r = f.summary.first().sse, _loss(x, f).first()
            best = local.setdefault(method, told)
            out.append((method, strategy, r.n, r.least > -1e-9 and r.off < 1e-6, abs(told / r.lost - 1) < 1e-3, told < 1.02 * best))
    return spark.createDataFrame(out, "method string, strategy string, n bigint, weights_on_simplex boolean, loss_as_told boolean, near_local boolean")


@query(f"""with {_WHOLE} select k::int as k, round(total, 2) as total, true as better_than_before
from (select sum(list_sum(list_transform(f, lambda x: x * x))) as total from whole), (values (2), (3), (4)) s(k)""")
def sweep_totals(spark: SparkSession, d: str) -> DataFrame:
    """A sweep over k: loss over unexplained share is the data's sum of squares, and every k explains more than the one before."""
    s = sorted(fit.k_sweep(samples_of(spark, d), [2, 3, 4], ratio="none").summary.collect(), key=lambda r: r.k)
    rows = [(r.k, round(r.sse / (1 - r.varexpl), 2), i == 0 or r.varexpl > s[i - 1].varexpl) for i, r in enumerate(s)]
    return spark.createDataFrame(rows, "k int, total double, better_than_before boolean")


@query(f"""with {_FITS}, each as (select k, fit_id, i as pos, var_samp(xc[i]) as v from fits, range(1, 9) t(i) group by 1, 2, 3),
obs as (select k, pos, max(v) as o from each where fit_id = (select min(fit_id) from fits) group by 1, 2),
r as (select k, pos, v from each where fit_id <> (select min(fit_id) from fits)),
flags as (select coalesce(r.k, obs.k) as k, coalesce(r.pos, obs.pos) as pos, o, case when o >= v then 1 when o < v then 0 end as flag from r full join obs on r.k = obs.k and r.pos = obs.pos)
select k, 'V' || pos as var_name, round(max(o), 6) as var_obs, case when count(flag) > 0 then round(greatest(1.0::double / count(flag), least(1 - 1.0::double / count(flag), 1 - avg(flag))), 6) end as p_value from flags group by 1, 2""")
def dim_p(spark: SparkSession, d: str) -> DataFrame:
    """Variance of each dimension in the first fit against that in the others."""
    a = _fits(spark, d).withColumn("replicate", F.col("fit_id"))
    first = a.agg(F.min("fit_id")).first()[0]
    return rounded(fit.dimension_significance(a.filter(F.col("fit_id") == first), a.filter(F.col("fit_id") != first))[1])


@query(f"""with {v.EMB} select 64 as components, round(sum(list_sum(list_transform(f, lambda x: x * x))), 4) as total, true as orthonormal, true as solves from emb""")
def svd_totals(spark: SparkSession, d: str) -> DataFrame:
    """All components: their squares sum up to the data's, they are orthonormal, and G u = d^2 u for the sums of products G."""
    e = matrix.embeddings(spark, d)
    s = project.fit_svd(e, 64)
    g = project.gram(e.select("sample_id", "features"), 64)
    ortho = bool(np.abs(s.u.T @ s.u - np.eye(64)).max() < 1e-9)
    solves = bool(np.abs(g @ s.u - s.u * s.d**2).max() < 1e-8 * s.d[0] ** 2)
    return spark.createDataFrame([(64, round(float((s.d**2).sum()), 4), ortho, solves)], "components int, total double, orthonormal boolean, solves boolean")


@query(f"""with {_WHOLE}, three as (select * from whole order by sample_id limit 3)
select dense_rank() over (order by sample_id)::int as arch_id, i::int as pos, round(f[i], 6) as v from three, range(1, 9) t(i)""")
def from_pcs(spark: SparkSession, d: str) -> DataFrame:
    """Three samples as archetypes: to all components of the z-scored data, and back to the units of the data."""
    x = samples_of(spark, d)
    s = project.fit_svd(x, 8, zscore=True)
    first = x.orderBy("sample_id").limit(3)
    p = project.to_components(first, s).orderBy("sample_id").toPandas()
    back = project.from_components(np.array(p["features"].tolist(), float).T, s, undo_zscore=True)
    rows = [(j + 1, i + 1, round(float(back[i, j]), 6) + 0.0) for j in range(back.shape[1]) for i in range(len(back))]
    return spark.createDataFrame(rows, "arch_id int, pos int, v double")


@query(f"""with recursive {v.CNT}, {v.CNT_FULL}, g as (select feature, (sample_id % 2)::double as x, sum(value) as y, count(*)::double as n, sum(case when value > 0 then value * ln(value) else 0 end) as l from cnt_long group by 1, 2),
step as (select distinct feature, 0.0::double as b0, 0.0::double as b1, 0 as it from g union all
  select feature, b0 + greatest(-5, least(5, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01))), b1 + greatest(-5, least(5, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01))), it + 1 from (
    select s.feature, b0, b1, it, sum(m) + 1 / 9.0::double as h00, sum(m * x) as h01, sum(m * x * x) + 1 / 9.0::double as h11, sum(y - m) - b0 / 9 as g0, sum(x * (y - m)) - b1 / 9 as g1
    from (select s.*, g.x, g.y, g.n * exp(b0 + b1 * x) as m from step s join g using (feature) where it < 60) s group by 1, 2, 3, 4)),
last_ as (select * from step where it = 60)
select feature, round(any_value(b0), 6) as intercept, round(any_value(b1), 6) as slope, round(2 * (sum(l) - sum(y * (b0 + b1 * x)) - sum(y) + sum(n * exp(b0 + b1 * x))), 4) as deviance from last_ join g using (feature) group by feature""")
def poisson_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """The Poisson regression of each kind of event on a covariate of the user."""
    long = matrix.zero_filled(matrix.event_counts(spark, d))
    cov = long.select("sample_id").distinct().withColumn("x", F.array((F.col("sample_id") % 2).cast("double")))
    x = models.poisson_regression(long, cov)
    return rounded(x.select("feature", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope"), F.round("deviance", 4).alias("deviance")))


@query("select label as observed_class, count(*) as n, true as stationary from embeddings group by 1")
def softmax_stationary(spark: SparkSession, d: str) -> DataFrame:
    """The classes as the classifier sees them, and whether the gradient of its penalised loss is 0 at the weights it finds."""
    e = cut(matrix.embeddings(spark, d))
    w, b = models.coefficients(models.fit_softmax(e, "features", "label", kind="l2", rounds=500))
    c = models.classify(e.withColumn("probabilities", models.probabilities(F.col("features"), w, b)))
    n = e.count()
    at_ = F.transform("probabilities", lambda p, i: p - (i == F.col("label")).cast("double"))
    g = c.select("features", F.posexplode(at_).alias("c", "r")).select("c", "r", F.posexplode("features").alias("i", "x")).groupBy("c", "i").agg((F.sum(F.col("r") * F.col("x")) / n).alias("g")).collect()
    worst = max((abs(r.g + 2 * 0.01 * float(w[r.c, r.i])) for r in g), default=0.0)
    return models.confusion(c, "label", "pred_class").groupBy("observed_class").agg(F.sum("N").alias("n")).withColumn("stationary", F.lit(worst < 1e-4))


@query("""with recursive t as (select 'N' || n_nationkey as id, 'R' || n_regionkey as up from nation union all select 'R' || r_regionkey, 'ROOT' from region union all select 'S' || s_suppkey, 'N' || s_nationkey from supplier),
up as (select distinct id, id as ancestor from t union select u.id, t.up from up u join t on t.id = u.ancestor) select id, ancestor from up""")
def term_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, nations and regions as terms, each below the next."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    t = read("nation").select(name("N", "n_nationkey").alias("id"), F.array(name("R", "n_regionkey")).alias("parents"))
    t = t.unionByName(read("region").select(name("R", "r_regionkey").alias("id"), F.array(F.lit("ROOT")).alias("parents")))
    return sets.ancestors(t.unionByName(read("supplier").select(name("S", "s_suppkey").alias("id"), F.array(name("N", "s_nationkey")).alias("parents"))))


@query("select p_partkey, p_brand, p_type from part where p_size = 10 and p_brand = (select min(p_brand) from part where p_size = 10)")
def hub_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a catalogue for one taxon and class; here parts of a size and brand."""
    p = spark.read.parquet(f"{d}/part.parquet")
    brand = p.filter("p_size = 10").agg(F.min("p_brand")).first()[0]
    return sets.catalogue_lookup(p, 10, brand, "p_size", "p_brand").select("p_partkey", "p_brand", "p_type")


_ACT = """{qty}, s0 as ({sets}), sz as (select set_id, least(count(*), t - 1) as m from s group by 1, t),
r as (select *, row_number() over (partition by sample_id order by value desc, feature) as r from qty)
select r.sample_id, s.set_id, regexp_replace(s.set_id, '[ \\-,/''\\[\\]()]', '_', 'g') as set_key, round(sum(t - r.r) / (any_value(m) * any_value(t) - any_value(m) * (any_value(m) + 1) / 2.0::double), 6) as score
from r join s on s.gene = r.feature join sz on sz.set_id = s.set_id where r.r < t group by 1, 2"""


def _activity_sql(rows: str) -> str:
    top = "nt as (select greatest(2, round_even(count(distinct feature) * 0.05::double, 0))::int as t from qty)"
    return "with " + _ACT.replace("{qty}", f"{v.QTY}, {top}").replace("s0 as ({sets})", f"s as (select x.*, t from ({rows}) x, nt)")


@query(_activity_sql("select distinct p_brand as set_id, p_partkey::varchar as gene from part where p_size % 3 = 0 and p_brand in (select p_brand from part where p_size % 3 = 0 group by 1 having count(*) >= 5 and count(*) < 1000000)"))
def activity_branch(spark: SparkSession, d: str) -> DataFrame:
    """Sets of one branch of an annotation, sized within it."""
    p = spark.read.parquet(f"{d}/part.parquet")
    branch = F.array(*map(F.lit, sets.BRANCHES))[F.col("p_size") % 3]
    t = p.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").cast("string").alias("gene"), branch.alias("ontology"))
    return rounded(sets.activity_of(matrix.quantities(spark, d), "BP", t, lower=5, upper=1_000_000))


@query(_activity_sql("select distinct p_type as set_id, p_partkey::varchar as gene from part where p_partkey::varchar in (select feature from qty) and p_type in (select p_type from part where p_partkey::varchar in (select feature from qty) group by 1 having count(*) between 3 and 1000000)"))
def activity_custom(spark: SparkSession, d: str) -> DataFrame:
    """Sets of the user's own, sized by the genes that are features."""
    p = spark.read.parquet(f"{d}/part.parquet")
    t = p.select(F.col("p_type").alias("set_id"), F.col("p_partkey").cast("string").alias("gene"))
    return rounded(sets.activity_of(matrix.quantities(spark, d), "custom", t, lower=3, upper=1_000_000))


@query(f"""with {v.CNT}, {v.CNT_FULL}, n as (select *, row_number() over (partition by feature order by sample_id) - 1 as at, count(*) over (partition by feature) as n from cnt_long),
w as (select sample_id, feature, floor({_KEY.format("concat_ws('|', '9', 'permute', feature, sample_id::varchar)")} * n)::bigint as at from n)
select w.sample_id, w.feature, n.value from w join n on n.feature = w.feature and n.at = w.at""")
def permute_replace(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's values drawn anew with replacement."""
    return at.permute_features(matrix.zero_filled(matrix.event_counts(spark, d)), 9, replace=True)


@query(f"""with {v.CNT}, {v.CNT_FULL}, x as (select *, (1 + sample_id % 4)::double as w from cnt_long),
a as (select sample_id, feature, row_number() over (partition by feature order by {_KEY.format("concat_ws('|', '9', 'place', sample_id::varchar)")}, sample_id) as rn from x),
b as (select feature, value, row_number() over (partition by feature order by -ln(greatest({_KEY.format("concat_ws('|', '9', 'permute', feature, sample_id::varchar)")}, pow(16.0::double, -12))) / w, sample_id) as rn from x)
select sample_id, feature, value from a join b using (feature, rn)""")
def permute_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's values dealt anew, those of heavy samples early."""
    long = matrix.zero_filled(matrix.event_counts(spark, d))
    w = long.select("sample_id", (1 + F.col("sample_id") % 4).alias("weight")).distinct()
    return at.permute_features(long, 9, weights=w)


@query(f"""with {_WHOLE}, k as (select *, {_KEY.format("concat_ws('|', '4563', 'sketch', sample_id)")} as key_ from whole where sample_id is not null), m as (select {", ".join(f"min(f[{i}]) as a{i}" for i in range(1, 9))} from whole),
b as (select sample_id, key_, row_number() over (partition by {", ".join(f"floor((f[{i}] - a{i}) / 20.0::double)" for i in range(1, 9))} order by key_, sample_id) as turn from k, m)
select sample_id, turn from (select sample_id, turn, row_number() over (order by turn, key_, sample_id) as place from b) where place <= 200""")
def sketch_turns(spark: SparkSession, d: str) -> DataFrame:
    """A sketch of 200 samples over boxes of a given side, with the turn in which each was drawn."""
    return sketch.draw(samples_of(spark, d).filter("sample_id is not null"), 200, 20.0).select("sample_id", "turn")
