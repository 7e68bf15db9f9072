"""Queries on archetype tables, gene sets, counts, classes and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexlake.functions import keyed, names, ranks, vectors
from vertexlake.operators import archetypes as at
from vertexlake.operators import fit, models, plotdata, project, sets, sketch
from vertexlake.operators import gam as gam_ops
from vertexlake.plans import sqlviews as v
from vertexlake.plans.explain import arch_of, emb_dist, rounded
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


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


# Archetype tables. pch_fit holds the archetypes of many fits.

_FITS = """fits as (select fit_id, arch_id, k, xc from (select *, row_number() over (partition by fit_id, arch_id order by arch_key) as rn from pch_fit) where rn = 1
  and len(xc) = 8 and len(list_filter(xc, lambda x: x is null or isnan(x) or isinf(x))) = 0)"""


def _fits(spark: SparkSession, d: str) -> DataFrame:
    """One row for each archetype of each fit whose position is whole."""
    w = Window.partitionBy("fit_id", "arch_id").orderBy("arch_key")
    bad = F.exists("xc", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return _read(spark, d, "pch_fit").withColumn("rn", F.row_number().over(w)).filter("rn = 1").filter((F.size("xc") == 8) & ~bad).select("fit_id", "arch_id", "k", F.col("xc").alias("position"))


@query(f"""with {_FITS}, s as (select fit_id, arch_id, round(list_sum(xc) / sqrt(2 * list_sum(list_transform(xc, lambda x: x * x))), 9) as score from fits)
select fit_id, arch_id, row_number() over (partition by fit_id order by score, arch_id) as place from s""")
def order_cosine(spark: SparkSession, d: str) -> DataFrame:
    return at.ordered(_fits(spark, d), ["fit_id"], "cosine")


@query(f"""with {_FITS} select fit_id, arch_id, row_number() over (partition by fit_id order by round(xc[2] - xc[1], 9), arch_id) as place from fits""")
def order_side(spark: SparkSession, d: str) -> DataFrame:
    return at.ordered(_fits(spark, d), ["fit_id"], "side")


@query(f"""with {_FITS} select fit_id, arch_id, case when arch_id = 1 then 'periportal_1' when arch_id = 3 then 'pericentral_3' else 'archetype_' || arch_id end as arch_name from fits""")
def annotate(spark: SparkSession, d: str) -> DataFrame:
    return at.annotate(_fits(spark, d), {"periportal": [1], "pericentral": [3]}).select("fit_id", "arch_id", "arch_name")


_DATA = f"""{v.EMB}, {v.ARCH}, apos as (select arch_id, i - 1 as pos, p[i] as v from arch, range(1, 65) t(i)), dpos as (select i - 1 as pos, f[i] as v from emb, range(1, 65) t(i)),
vd as (select a.pos::int as pos, var_samp(a.v) / any_value(d.dv) as var_dim from apos a join (select pos, var_samp(v) as dv from dpos group by 1) d on d.pos = a.pos group by 1)"""


def _arch(spark: SparkSession, d: str) -> DataFrame:
    return arch_of(spark, d).withColumn("k", F.lit(3))


@query(f"with {_DATA} select 3 as k, pos, round(var_dim, 6) as var_dim from vd")
def var_dim(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.dimension_variance(_arch(spark, d), matrix.embeddings(spark, d)))


@query(f"with {_DATA} select 3 as k, round(avg(var_dim), 6) as ratio from vd")
def var_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit.variance_ratio(_arch(spark, d), matrix.embeddings(spark, d)))


@query(f"""with {_FITS}, t as (select fit_id, max(case when arch_id = 1 then xc end) as a, max(case when arch_id = 2 then xc end) as b, max(case when arch_id = 3 then xc end) as c from fits group by 1)
select fit_id, round(abs((a[1] - c[1]) * (b[2] - c[2]) - (b[1] - c[1]) * (a[2] - c[2])) / 2, 6) as volume from t""")
def simplex_volume_k3(spark: SparkSession, d: str) -> DataFrame:
    from vertexlake.operators.geometry import volume_k3

    return rounded(volume_k3(_fits(spark, d), ["fit_id"]))


_THREE = f"""{_FITS}, three as (select * from fits where arch_id <= 3 and fit_id in (select fit_id from fits where arch_id <= 3 group by 1 having count(*) = 3)),
ref as (select arch_id, xc from three where fit_id = (select min(fit_id) from three)),
costs as (select t.fit_id, r.arch_id as i, t.arch_id as j, list_distance(r.xc, t.xc) as cost from three t, ref r),
perms as (select * from (values (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) p(a, b, c)),
sums as (select fit_id, a, b, c, round(sum(cost), 6) as total from perms join costs on (i = 1 and j = a) or (i = 2 and j = b) or (i = 3 and j = c) group by all)"""


def _three(spark: SparkSession, d: str) -> DataFrame:
    x = _fits(spark, d).filter("arch_id <= 3")
    full = x.groupBy("fit_id").count().filter("count = 3").select("fit_id")
    return x.join(full, "fit_id", "left_semi")


@query(f"with {_THREE} select fit_id, min(total) as total from sums group by 1")
def align_exhaustive_k3(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each fit's first three archetypes to those of the first fit, in the best order (by assignment)."""
    return at.align_tables(_three(spark, d)).select("fit_id", F.round("total", 6).alias("total"))


@query("""with n as (select unnest(range(1, 5)) as i) select a.i || ',' || b.i || ',' || c.i || ',' || d.i as perm from n a, n b, n c, n d
where len(list_distinct([a.i, b.i, c.i, d.i])) = 4""")
def permutations_n4(spark: SparkSession, d: str) -> DataFrame:
    return at.permutations(spark, 4).select(F.array_join(F.transform("perm", lambda x: x.cast("string")), ",").alias("perm"))


_KEY = "('0x' || substr(md5({}), 1, 12))::bigint / 281474976710656.0::double"


@query(f"""with k as (select vec_id as sample_id, {_KEY.format("concat_ws('|', '235', 'boot', '1', vec_id::varchar)")} as u, count(*) over () as n from embeddings),
r as (select *, row_number() over (order by u, sample_id) as rn from k) select sample_id from r where rn <= round_even(n * 0.65, 0)""")
def boot_sample(spark: SparkSession, d: str) -> DataFrame:
    return fit.resample(matrix.embeddings(spark, d), 0.65).select("sample_id")


@query(f"""with {_FITS}, ap as (select k, arch_id, i as pos, var_samp(xc[i]) as v from fits, range(1, 9) t(i) group by 1, 2, 3),
dm as (select i as pos, var_samp(features[i]) as dv from (select * from data_matrix where len(features) = 8 and len(list_filter(features, lambda x: x is null or isnan(x) or isinf(x))) = 0), range(1, 9) t(i) group by 1)
select k, arch_id, round(sum(v) / sum(case when v is not null then dv end), 6) as var_vert from ap join dm using (pos) group by 1, 2""")
def boot_variance(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "data_matrix").withColumnRenamed("loaded_at", "t")
    good = x.filter((F.size("features") == 8) & ~F.exists("features", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return rounded(fit.position_variance(_fits(spark, d), good)[0])


@query(f"""with {v.CNT}, {v.CNT_FULL}, a as (select sample_id, feature, row_number() over (partition by feature order by {_KEY.format("concat_ws('|', '9', 'place', sample_id::varchar)")}, sample_id) as rn from cnt_long),
b as (select feature, value, row_number() over (partition by feature order by {_KEY.format("concat_ws('|', '9', 'permute', feature, sample_id::varchar)")}, sample_id) as rn from cnt_long)
select sample_id, feature, value from a join b using (feature, rn)""")
def permute_feature(spark: SparkSession, d: str) -> DataFrame:
    c = matrix.event_counts(spark, d)
    return at.permute_features(matrix.zero_filled(c), seed=9)


_RAND = """rand as (select o_orderpriority as var_name, (o_custkey % 3)::int as k, o_orderkey as repl, o_totalprice as var_rand from orders where o_orderpriority <> '5-LOW'),
obs as (select o_orderpriority as var_name, (o_custkey % 3)::int as k, max(o_totalprice) * 0.9::double as var_obs from orders where o_orderpriority <> '1-URGENT' group by 1, 2),
flags as (select coalesce(r.k, o.k) as k, coalesce(r.var_name, o.var_name) as var_name, var_obs, case when var_obs >= var_rand then 1 when var_obs < var_rand then 0 end as flag from rand r full join obs o on r.k = o.k and r.var_name = o.var_name),
ps as (select k, var_name, any_value(var_obs) as var_obs, count(flag) as n, 1 - avg(flag) as p from flags group by 1, 2)"""


@query(f"with {_RAND} select k, var_name, round(var_obs, 6) as var_obs, case when n > 0 then round(greatest(1.0::double / n, least(1 - 1.0::double / n, p)), 6) end as p_value from ps")
def empirical_p(spark: SparkSession, d: str) -> DataFrame:
    """Empirical p values of a full join of 'permuted' and 'observed' values, here order prices."""
    o = _read(spark, d, "orders").select(F.col("o_orderpriority").alias("var_name"), (F.col("o_custkey") % 3).cast("int").alias("k"), "o_orderkey", "o_totalprice")
    rand = o.filter("var_name <> '5-LOW'").select("k", "var_name", F.col("o_orderkey").alias("repl"), F.col("o_totalprice").alias("var_rand"))
    obs = o.filter("var_name <> '1-URGENT'").groupBy("k", "var_name").agg((F.max("o_totalprice") * 0.9).alias("var_obs"))
    return rounded(fit.empirical_p(rand, obs)[1])


_SUMMARY = f"""{_FITS}, summary as (select k, round(avg(xc[1] * xc[1]), 6) as varexpl, round(stddev_samp(xc[2]), 6) as t_ratio, round(max(xc[3]), 6) as total_var from fits group by 1)"""


def _summary(spark: SparkSession, d: str) -> DataFrame:
    """A table shaped like the summary of a sweep over k."""
    p = F.col("position")
    return rounded(_fits(spark, d).groupBy("k").agg(F.avg(p[0] * p[0]).alias("varexpl"), F.stddev_samp(p[1]).alias("t_ratio"), F.max(p[2]).alias("total_var")))


@query(f"with {_SUMMARY} select * from summary where k in (4, 5)")
def subset_k(spark: SparkSession, d: str) -> DataFrame:
    s = _summary(spark, d)
    return fit.Fits(_fits(spark, d), s).subset([4, 5]).summary


@query(f"with {_SUMMARY} select * from summary where k = 4 union all select * from summary where k <> 4")
def concat_k(spark: SparkSession, d: str) -> DataFrame:
    s, a = _summary(spark, d), _fits(spark, d)
    f = fit.Fits(a, s)
    return f.subset([4]).union(fit.Fits(a.filter("k <> 4"), s.filter("k <> 4"))).summary


@query(f"""with {_SUMMARY} select s.k, s.varexpl as value, round(s.varexpl - coalesce(p.varexpl, 0), 6) as res_value from summary s left join summary p on p.k = s.k - 1""")
def res_varexpl(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plotdata.by_k(_summary(spark, d)))


@query(f"with {_SUMMARY} select k, var_name, value from summary unpivot (value for var_name in (varexpl, t_ratio, total_var))")
def dim_var_melt(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).unpivot("k", ["varexpl", "t_ratio", "total_var"], "var_name", "value")


@query(f"""with {v.EMB}, x as (select sample_id, i as pos, round(f[i], 6) as v, count(*) over (partition by i) as n from emb, range(1, 5) t(i)),
r as (select *, row_number() over (partition by pos order by v, sample_id) as up, row_number() over (partition by pos order by v desc, sample_id desc) as down, floor(n * 0.2::double / 4 / 2) as m from x)
select pos::int - 1 as pos, round(var_samp(v), 9) as v from r where up <= m or down <= m group by pos""")
def extreme_var(spark: SparkSession, d: str) -> DataFrame:
    x = matrix.embeddings(spark, d).select("sample_id", F.transform(F.slice("features", 1, 4), lambda e: F.round(e, 6)).alias("features"))
    return rounded(at.extreme_variance(x, 0.2, 4), 9)


@query(f"""with {v.QTY}, p as (select sample_id, feature, log2(value + 1) as v from qty), z as (select sample_id, feature,
  (v - avg(v) over (partition by feature)) / nullif(stddev_samp(v) over (partition by feature), 0) as z from p) select sample_id, feature, round(z, 6) as value from z""")
def zscore_log2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.zscore(matrix.quantities(spark, d).withColumn("value", F.log2(F.col("value") + 1)), ["feature"]))


@query(f"with {v.EMB} select i::int - 1 as i, j::int - 1 as j, round(sum(f[i] * f[j]), 6) as v from emb, range(1, 65) a(i), range(1, 65) b(j) where i <= j group by 1, 2")
def gram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(project.gram_table(matrix.embeddings(spark, d)))


_DEV = """n as (select count(distinct sample_id) as n from {t}), sums as (select feature, sum(value) as s, sum(case when value > 0 then value * ln(value) else 0 end) as l from {t} group by 1)
select feature, round(s / n, 6) as mean, round(2 * (l - s * ln(s / n)), 4) as deviance from sums, n"""


@query(f"with {v.CNT}, {_DEV.format(t='cnt')}")
def deviance_cnt(spark: SparkSession, d: str) -> DataFrame:
    c = matrix.event_counts(spark, d)
    x = models.deviance(c, c.select("sample_id").distinct().count())
    return x.select("feature", F.round("mean", 6).alias("mean"), F.round("deviance", 4).alias("deviance"))


@query(f"""with {v.QTY}, r as (select *, row_number() over (partition by sample_id order by value desc, feature) as r from qty),
s as (select distinct p_brand as set_id, p_partkey::varchar as gene from part), sz as (select set_id, least(count(*), 99) as m from s group by 1)
select r.sample_id, s.set_id, round(sum(100 - r.r) / (any_value(m) * 100 - any_value(m) * (any_value(m) + 1) / 2.0::double), 6) as auc
from r join s on s.gene = r.feature join sz on sz.set_id = s.set_id where r.r < 100 group by 1, 2""")
def auc_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sets.auc_scores(matrix.quantities(spark, d), matrix.part_sets(spark, d), 100))


@query("select p_partkey::varchar as gene, p_brand as set_id, count(*) as n from part group by 1, 2")
def set_matrix(spark: SparkSession, d: str) -> DataFrame:
    return sets.set_matrix(matrix.part_sets(spark, d))


_ANN = "ann as (select annot_id, goall as set_id, alias as gene, ontologyall as ontology, evidenceall as evidence, term from annot_dt)"


def _annotation(spark: SparkSession, d: str) -> DataFrame:
    a = _read(spark, d, "annot_dt")
    return a.select("annot_id", F.col("goall").alias("set_id"), F.col("alias").alias("gene"), F.col("ontologyall").alias("ontology"), F.col("evidenceall").alias("evidence"), "term")


@query(f"with {_ANN} select * from ann where set_id in (select set_id from ann group by 1 having count(*) >= 5 and count(*) < 100) and ontology in ('BP', 'MF')")
def set_filter_half_open(spark: SparkSession, d: str) -> DataFrame:
    return sets.filter_go(_annotation(spark, d), None, 5, 100, ["BP", "MF"])


@query(f"with {_ANN} select * from ann where set_id in (select set_id from ann group by 1 having count(distinct gene) >= 5 and count(distinct gene) <= 100)")
def set_filter_closed(spark: SparkSession, d: str) -> DataFrame:
    return sets.filter_by_size(_annotation(spark, d), 5, 100, closed=True, distinct="gene")


@query(f"""with {_ANN} select distinct k.gene, a.annot_id, a.set_id, a.ontology, a.term from (select distinct gene from ann where gene is not null) k left join ann a on a.gene = k.gene
where a.ontology in ('BP') and a.evidence in ('IEA', 'TAS')""")
def go_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = _annotation(spark, d)
    return sets.map_annotation(a.filter("gene is not null").select("gene").distinct(), a, "gene", ["BP"], ["IEA", "TAS"]).select("gene", "annot_id", "set_id", "ontology", "term")


@query(f"""with {_ANN}, t as (select set_id as term_id, max(term) as set_name from ann where ontology <> 'CC' and set_id is not null group by 1), a as (select distinct set_id, gene from ann where ontology <> 'MF' and set_id is not null)
select coalesce(set_id, term_id) as set_id, gene, set_name from a full join t on set_id = term_id""")
def go_terms_full(spark: SparkSession, d: str) -> DataFrame:
    a = _annotation(spark, d).filter("set_id is not null")
    t = a.filter("ontology <> 'CC'").groupBy(F.col("set_id").alias("term_id")).agg(F.max("term").alias("set_name"))
    return sets.add_terms(a.filter("ontology <> 'MF'").select("set_id", "gene").distinct(), t)


_CAT = """cat as (select annot_id, goall as "MAPPED_TRAIT_URI", term as "MAPPED_TRAIT", alias as "MAPPED_GENE", evidenceall as "CONTEXT" from annot_dt where goall is not null),
t0 as (select distinct "MAPPED_TRAIT_URI", "MAPPED_TRAIT" from cat where "MAPPED_TRAIT_URI" <> ''),
t1 as (select *, string_split("MAPPED_TRAIT_URI", ', ') as us, string_split("MAPPED_TRAIT", ', ') as ns from t0),
t as (select "MAPPED_TRAIT_URI", unnest(us) as uri, unnest(case when len(us) = len(ns) then ns else list_transform(us, lambda x: "MAPPED_TRAIT") end) as name from t1),
g as (select distinct "MAPPED_GENE", gene_name from (select "MAPPED_GENE", unnest(string_split_regex("MAPPED_GENE", ', | - ')) as gene_name from (select distinct "MAPPED_GENE" from cat where "MAPPED_GENE" <> '')) where gene_name <> ''),
j as (select c.annot_id, t.uri, t.name, g.gene_name, c."CONTEXT" from cat c join t using ("MAPPED_TRAIT_URI") join g using ("MAPPED_GENE") join (select distinct alias as gene_name from annot_dt) k using (gene_name))"""


@query(f"""with {_CAT} select annot_id, uri, name, gene_name from j where uri in (select uri from j group by 1 having count(distinct gene_name) between 2 and 500) and regexp_matches("CONTEXT", 'IEA|TAS')""")
def gwas_explode(spark: SparkSession, d: str) -> DataFrame:
    """Lists in cells become rows; the joins are many to many."""
    a = _read(spark, d, "annot_dt").filter("goall is not null")
    c = a.select("annot_id", F.col("goall").alias("MAPPED_TRAIT_URI"), F.col("term").alias("MAPPED_TRAIT"), F.col("alias").alias("MAPPED_GENE"), F.col("evidenceall").alias("CONTEXT"))
    keys = _read(spark, d, "annot_dt").select(F.col("alias").alias("gene")).distinct()
    return sets.map_catalogue(c, keys, 2, 500, ["IEA", "TAS"]).select("annot_id", "uri", "name", "gene_name")


@query("""select o_orderkey, l_partkey from orders left join (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_partkey, l_linenumber) as rn from lineitem) l on l_orderkey = o_orderkey and rn = 1""")
def first_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    li = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.struct("l_partkey", "l_linenumber").alias("place"))
    return sets.first_match(_read(spark, d, "orders").select("o_orderkey"), li, "o_orderkey", "place").select("o_orderkey", "l_partkey")


@query("""with p as (select sample_id, min(batch) as batch from sample_design where sample_id is not null group by 1), k as (select distinct sample_id from data_matrix where sample_id is not null)
select k.sample_id, batch, coalesce(batch, k.sample_id) as "ROWNAMES" from k left join p using (sample_id)""")
def pick_one(spark: SparkSession, d: str) -> DataFrame:
    k = _read(spark, d, "data_matrix").select("sample_id").filter("sample_id is not null").distinct()
    return sets.map_identifiers(k, _read(spark, d, "sample_design").select("sample_id", "batch"), "sample_id", "batch")


@query("select distinct p_type, regexp_replace(p_type || '-(' || p_brand || ')', '[ \\-,/''\\[\\]()]', '_', 'g') as clean from part")
def sanitize_names(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "part")
    return p.select("p_type", names.sanitize(F.concat("p_type", F.lit("-("), "p_brand", F.lit(")"))).alias("clean")).distinct()


@query("select p_partkey, p_name, case when row_number() over (partition by p_name order by p_partkey) > 1 then p_name || '_' || p_partkey else p_name end as unique_name from part")
def dedupe_names(spark: SparkSession, d: str) -> DataFrame:
    return names.tell_apart(_read(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query(f"""with {v.EMB}, k as (select sample_id, label, {_KEY.format("concat_ws('|', '5', 'split', sample_id::varchar)")} as u, count(*) over (partition by label) as n from emb)
select sample_id, label, row_number() over (partition by label order by u, sample_id) <= round_even(n * 0.3, 0) as validation from k""")
def split_train_val(spark: SparkSession, d: str) -> DataFrame:
    return models.split_by_class(matrix.embeddings(spark, d).select("sample_id", "label"), "label", "sample_id")


@query(f"""with {v.EMB}, {v.ARCH}, {v.DIST}, {v.EMB_LONG}, r as (select *, row_number() over (partition by arch order by dist, sample_id) as rn, count(*) over (partition by arch) as n from dist),
b as (select arch, sample_id, least(5, ceil(rn / round_even(n / 5.0::double, 0)))::int as bin, floor({_KEY.format("concat_ws('|', '3', 'example', arch, sample_id::varchar)")} * 4)::int as example from r),
m as (select arch, bin, example, feature, avg(value) as value from b join long_ using (sample_id) group by all)
select arch, bin, example, feature, round((value - avg(value) over w) / stddev_samp(value) over w, 6) as value from m window w as (partition by feature, example)""")
def bin_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.make_features(emb_dist(spark, d), matrix.to_long(matrix.embeddings(spark, d)), 5, 4))


_PROB = f"""{v.EMB}, e as (select sample_id, label, list_transform(f[1:10], lambda x: exp(3 * x)) as e from emb), pr as (select sample_id, label, list_transform(e, lambda x: x / list_sum(e)) as p from e),
cl as (select sample_id, label, p, list_position(p, list_max(p)) as pred_class, list_sum(list_transform(p, lambda x: -x * log2(x))) as class_entropy from pr)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    """Fixed 'probabilities': the softmax of three times the first ten entries."""
    import numpy as np

    x = matrix.embeddings(spark, d).withColumn("features", F.slice("features", 1, 10))
    return models.classify(x.withColumn("probabilities", models.probabilities(F.col("features"), 3 * np.eye(10), np.zeros(10))))


@query(f"with {_PROB} select sample_id, pred_class::int as pred_class, round(class_entropy, 6) as class_entropy from cl")
def entropy_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_classified(spark, d).select("sample_id", "pred_class", "class_entropy"))


@query(f"""with {_PROB} select o.label as observed_class, p.pred_class::int as predicted_class, coalesce(n, 0) as "N" from (select distinct label from cl) o, (select distinct pred_class from cl) p
left join (select label, pred_class, count(*) as n from cl group by 1, 2) c on c.label = o.label and c.pred_class = p.pred_class""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return models.confusion(_classified(spark, d), "label", "pred_class", zeros=True).drop("proportion")


@query(f"""with {_PROB} select label as observed_class, pred_class::int as predicted_class, count(*) as "N", round(count(*)::double / sum(count(*)) over (partition by label), 6) as proportion from cl group by 1, 2""")
def confusion_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.confusion(_classified(spark, d), "label", "pred_class"))


@query("""with w as (select s_nationkey as class, s_suppkey::varchar as feature, s_acctbal / 1e6::double as weight from supplier)
select class, feature, weight, row_number() over (partition by class order by weight desc, feature) as place, case when abs(weight) >= 0.001 then feature end as name from w""")
def top_weights(spark: SparkSession, d: str) -> DataFrame:
    w = _read(spark, d, "supplier").select(F.col("s_nationkey").alias("class"), F.col("s_suppkey").cast("string").alias("feature"), (F.col("s_acctbal") / 1e6).alias("weight"))
    return models.top_weights(w)


_DERIV = """der as (select event_type as y_name, 'a' || (user_id % 3) as x_name, event_id as x, round(value / 100 - 0.5::double, 6) as deriv, 0.99::double + (event_id % 10) / 1000.0::double as prob_neg, 1.0::double + event_id % 3 as weights
  from events), dn as (select *, row_number() over (partition by y_name, x_name order by x) as rn, count(*) over (partition by y_name, x_name) as n from der),
s as (select y_name, x_name, sum(weights * deriv) / sum(weights) as deriv100, sum(weights * deriv) filter (rn <= ceil(n * 0.5::double)) / sum(weights) filter (rn <= ceil(n * 0.5::double)) as deriv50,
  sum(weights * deriv) filter (rn <= ceil(n * 0.2::double)) / sum(weights) filter (rn <= ceil(n * 0.2::double)) as deriv20, avg(prob_neg) as mean_prob, product(prob_neg) as prod_prob from dn group by 1, 2),
o as (select a.y_name, a.x_name, avg(1 - b.mean_prob) as om, product(1 - b.prod_prob) as oq from s a join s b on a.y_name = b.y_name and a.x_name <> b.x_name group by 1, 2),
l as (select s.*, mean_prob * coalesce(om, 1) as mean_prob_excl, prod_prob * coalesce(oq, 1) as prod_prob_excl from s left join o using (y_name, x_name))"""


def _gam_summary(e: DataFrame) -> DataFrame:
    x = e.select(F.col("event_type").alias("y_name"), F.concat(F.lit("a"), F.col("user_id") % 3).alias("x_name"), F.col("event_id").alias("x"), F.round(F.col("value") / 100 - 0.5, 6).alias("deriv"),
                 (0.99 + (F.col("event_id") % 10) / 1000.0).alias("prob_neg"), (1.0 + F.col("event_id") % 3).alias("weights"))
    return rounded(gam_ops.summarise(x))


@query(f"""with {_DERIV}, u as (unpivot l on mean_prob, prod_prob, mean_prob_excl, prod_prob_excl into name metric value p)
select y_name, x_name, round(1 - p, 6) as p, metric, round(deriv100, 6) as deriv100, round(deriv50, 6) as deriv50, round(deriv20, 6) as deriv20 from u""")
def gam_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of a fixed table of derivatives, with every event in its grid."""
    return _gam_summary(_read(spark, d, "events"))


@query()
def gam_summary_all(spark: SparkSession, d: str) -> DataFrame:
    """`gam_summary` by its former name; tests hold it against brute force."""
    return _gam_summary(_read(spark, d, "events"))


@query(f"""with {_FITS}, m as (select arch_id, i - 1 as pos, avg(xc[i]) as v from fits, range(1, 9) t(i) group by 1, 2)
select a.arch_id as a, b.arch_id as b, a.pos::int as pos, round(a.v, 6) as "from", round(b.v, 6) as "to" from m a join m b on a.pos = b.pos and a.arch_id < b.arch_id""")
def arch_lines(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plotdata.lines(_fits(spark, d)))


@query("select a.i::int as x, b.i::int as y from range(1, 9) a(i), range(1, 9) b(i) where a.i < b.i")
def panel_pairs(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.panels(8, spark)


@query(f"with {v.EMB}, {v.ARCH} select a.arch_id::int as a, b.arch_id::int as b, case when a.arch_id <> b.arch_id then round(list_distance(a.p, b.p), 6) end as dist from arch a, arch b")
def struct_dist(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plotdata.structure(arch_of(spark, d)).select("a", "b", "dist"))


@query(f"""with {v.EMB}, m as (select list_min(list(f[1])) as a, list_min(list(f[2])) as b from emb)
select floor((f[1] - a) / 0.25)::bigint as b1, floor((f[2] - b) / 0.25)::bigint as b2, count(*) as n from emb, m group by 1, 2""")
def sketch_boxes(spark: SparkSession, d: str) -> DataFrame:
    x = matrix.embeddings(spark, d).withColumn("features", F.slice("features", 1, 2))
    lows = x.agg(F.min(F.col("features")[0]), F.min(F.col("features")[1])).first()
    return x.groupBy(sketch.box_of(F.col("features"), list(lows), 0.25).alias("b")).agg(F.count("*").alias("n")).select(F.col("b")[0].alias("b1"), F.col("b")[1].alias("b2"), "n")


@query(f"""with {v.QTY}, nf as (select count(distinct feature)::double as n from qty), hi as (select feature from qty group by 1 having sum(value) > 100)
select sample_id, sum(value) as total, round(count(*) / any_value(n), 6) as detected, round(sum(case when feature in (select feature from hi) then value else 0 end) / sum(value), 6) as marker_share
from qty, nf group by 1 having count(*) / any_value(n) > 0.01""")
def qc_filter(spark: SparkSession, d: str) -> DataFrame:
    """Samples by total, share of features present, and share of a marker set."""
    q = matrix.quantities(spark, d)
    marker = q.groupBy("feature").agg(F.sum("value").alias("s")).filter("s > 100").select("feature")
    return rounded(at.quality(q, marker).filter("detected > 0.01"))


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty, count(distinct l_suppkey) as suppliers from lineitem group by cube (l_returnflag, l_linestatus)")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return x.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.countDistinct("l_suppkey").alias("suppliers"))


@query(f"""with {v.CNT} select sample_id, coalesce(max(value) filter (feature = 'click'), 0) as click, coalesce(max(value) filter (feature = 'view'), 0) as view, coalesce(max(value) filter (feature = 'purchase'), 0) as purchase from cnt group by 1""")
def wide_counts(spark: SparkSession, d: str) -> DataFrame:
    c = matrix.event_counts(spark, d)
    return c.groupBy("sample_id").pivot("feature", ["click", "view", "purchase"]).agg(F.max("value")).na.fill(0.0)


@query("""with g as (select p_brand as set_id, list_sort(list(p_partkey::varchar)) as genes from part group by 1) select set_id, array_to_string(genes, ',') as genes, len(genes) as n from g""")
def set_lists(spark: SparkSession, d: str) -> DataFrame:
    g = matrix.part_sets(spark, d).groupBy("set_id").agg(F.sort_array(F.collect_list("gene")).alias("genes"))
    return g.select("set_id", F.array_join("genes", ",").alias("genes"), F.size("genes").cast("bigint").alias("n"))


@query("select sample_id, batch, umi_total, n from (select *, count(*) over (partition by sample_id) as n from sample_design where sample_id in (select sample_id from data_matrix)) where umi_total is not null")
def design_semi(spark: SparkSession, d: str) -> DataFrame:
    s, m = _read(spark, d, "sample_design"), _read(spark, d, "data_matrix")
    n = F.count("*").over(Window.partitionBy("sample_id"))
    return s.join(m, "sample_id", "left_semi").withColumn("n", n).filter("umi_total is not null").select("sample_id", "batch", "umi_total", "n")


@query("select sample_id from data_matrix where sample_id is not null except select sample_id from sample_design")
def design_missing(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "data_matrix").select("sample_id").filter("sample_id is not null").subtract(_read(spark, d, "sample_design").select("sample_id"))


@query("select sample_id from data_matrix where sample_id is not null intersect select sample_id from sample_design")
def design_common(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "data_matrix").select("sample_id").intersect(_read(spark, d, "sample_design").select("sample_id")).filter("sample_id is not null")


@query(f"""select sample_id, round({_KEY.format("concat_ws('|', '4355', 'weight', sample_id::varchar, '1')")}, 9) as u from (select unnest(range(0, 1000)) as sample_id)""")
def keyed_uniform(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("sample_id"), F.round(keyed.uniform(4355, "weight", F.col("id"), F.lit(1)), 9).alias("u"))


@query(f"""with w as (select sample_id, list_transform(range(1, 4), lambda j: {_KEY.format("concat_ws('|', '4355', 'weight', sample_id::varchar, j::varchar)")}) as w from (select unnest(range(0, 500)) as sample_id)),
n as (select sample_id, list_transform(w, lambda x: x / list_sum(w) * 0.9::double) as w from w)
select sample_id, round(w[1] * 5 + w[2] * -10 + w[3] * -30, 6) as x, round(w[1] * 0 + w[2] * 15 + w[3] * -20, 6) as y from n""")
def generated(spark: SparkSession, d: str) -> DataFrame:
    x = matrix.generate_data(spark, [[5, 0], [-10, 15], [-30, -20]], 500, jitter=0.0, size=0.9)
    return rounded(x.select("sample_id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y")))


@query(f"""with {v.EMB}, m as (select label, avg(f[1]) as m from emb group by 1) select sample_id, round(f[1] - m, 6) as centred, round(list_sum(list_transform(f, lambda x: x * x)), 6) as square from emb join m using (label)""")
def grouped_mean(spark: SparkSession, d: str) -> DataFrame:
    e = matrix.embeddings(spark, d)
    x = e.withColumn("m", F.avg(F.col("features")[0]).over(Window.partitionBy("label")))
    return rounded(x.select("sample_id", (F.col("features")[0] - F.col("m")).alias("centred"), vectors.dot(F.col("features"), F.col("features")).alias("square")))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() over (order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn from lineitem")
def total_order(spark: SparkSession, d: str) -> DataFrame:
    """Numbering of a whole table without one task that holds it."""
    x = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ranks.numbered(x, [F.col(c) for c in ("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).drop("part_")


_KNN = f"""{v.EMB}, d as (select a.sample_id, b.sample_id as neighbour, round(list_distance(a.f, b.f), 9) as dist from emb a, emb b),
k as (select * from (select *, row_number() over (partition by sample_id order by dist, neighbour) as place from d) where place <= 10)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    from vertexlake.operators import neighbours

    return neighbours.knn(matrix.embeddings(spark, d), 10)


@query(f"with {_KNN} select sample_id, neighbour, place::int as place, round(dist, 6) as dist from k")
def knn_emb(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_near(spark, d))


@query(f"""with {_KNN}, p as (select x.sample_id as a, y.sample_id as b, count(*) as shared from k x join k y on x.neighbour = y.neighbour and x.sample_id < y.sample_id group by 1, 2)
select a, b, round(shared / (20.0::double - shared), 6) as weight from p where shared / (20.0::double - shared) >= 1 / 15.0::double""")
def snn_emb(spark: SparkSession, d: str) -> DataFrame:
    from vertexlake.operators import neighbours

    return rounded(neighbours.shared_neighbours(_near(spark, d)))


@query(f"""with {_PROB} select i::int as observed_class, j::int as predicted_class, round(sum(p[i] * p[j]), 6) as "N" from cl, range(1, 11) a(i), range(1, 11) b(j) group by 1, 2""")
def confusion_soft(spark: SparkSession, d: str) -> DataFrame:
    """Reference and predicted probabilities are the same here, so the table is symmetric."""
    x = _classified(spark, d).withColumn("reference", F.col("probabilities"))
    return rounded(models.soft_confusion(x, "reference", "probabilities"))


@query(f"""with {v.QTY}, r as (select *, row_number() over (partition by sample_id order by value desc, feature) as r from qty),
s as (select distinct p_brand as set_id, p_partkey::varchar as gene from part), sz as (select set_id, least(count(*), 99) as m from s group by 1),
a as (select r.sample_id, s.set_id, round(sum(100 - r.r) / (any_value(m) * 100 - any_value(m) * (any_value(m) + 1) / 2.0::double), 6) as auc
  from r join s on s.gene = r.feature join sz on sz.set_id = s.set_id where r.r < 100 group by 1, 2), t as (select set_id, round(avg(auc), 6) as threshold from a group by 1)
select sample_id, a.set_id, auc, (auc > threshold)::int as active from a join t on t.set_id = a.set_id""")
def auc_binary(spark: SparkSession, d: str) -> DataFrame:
    """Scores above their set's mean."""
    a = rounded(sets.auc_scores(matrix.quantities(spark, d), matrix.part_sets(spark, d), 100))
    t = a.groupBy("set_id").agg(F.round(F.avg("auc"), 6).alias("threshold"))
    return sets.binary_scores(a, t).select("sample_id", "set_id", "auc", "active")


@query(f"with {v.EMB} select i::int - 1 as pos, round(avg(f[i]), 6) as mean, round(stddev_samp(f[i]), 6) as sd from emb, range(1, 65) t(i) group by 1")
def moments_emb(spark: SparkSession, d: str) -> DataFrame:
    return rounded(project.moments(matrix.embeddings(spark, d)))


@query("""with t as (select evidenceall as set_id, alias as gene, annot_id from annot_dt), ok as (select set_id from t where set_id is not null group by 1 having count(distinct gene) between 3 and 400),
k as (select distinct alias as gene from annot_dt where ontologyall = 'CC' and alias is not null) select t.annot_id, t.set_id, t.gene from t join ok on ok.set_id = t.set_id join k on k.gene = t.gene""")
def targets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of sets are counted before the keys are matched."""
    a = _read(spark, d, "annot_dt").select("annot_id", F.col("evidenceall").alias("set_id"), F.col("alias").alias("gene"), "ontologyall")
    keys = a.filter("ontologyall = 'CC' and gene is not null").select("gene").distinct()
    return sets.map_targets(a.drop("ontologyall"), keys, 3, 400).select("annot_id", "set_id", "gene")


@query(f"""with {_PROB} select sample_id, 'archetype_' || i as arch, round(1 - p[i], 6) as dist from cl, range(1, 11) t(i)""")
def weight_dist(spark: SparkSession, d: str) -> DataFrame:
    """One less the weight of each archetype as a distance."""
    from vertexlake.operators import distance

    w = _classified(spark, d).select("sample_id", F.col("probabilities").alias("weights"))
    return rounded(distance.weight_distances(w, [f"archetype_{i}" for i in range(1, 11)]))


@query("""with q as (select l_suppkey as sample_id, l_returnflag as feature, sum(l_quantity) as value from lineitem group by 1, 2)
select sample_id, coalesce(max(value) filter (feature = 'A'), 0) as a, coalesce(max(value) filter (feature = 'N'), 0) as n, coalesce(max(value) filter (feature = 'R'), 0) as r from q group by 1""")
def long_to_vectors(spark: SparkSession, d: str) -> DataFrame:
    q = _read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_returnflag").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    f = F.col("features")
    return matrix.from_long(q, ["A", "N", "R"]).select("sample_id", f[0].alias("a"), f[1].alias("n"), f[2].alias("r"))


@query("select event_type, date_trunc('day', ts) as day, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2")
def daily_means(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    return rounded(e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))
