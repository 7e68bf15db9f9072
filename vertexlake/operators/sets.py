"""Gene sets: annotation tables, their filters, and the activity of sets in samples.

An annotation is the long table (set_id, gene) with optional set_name, ontology and evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.functions import names
from vertexlake.session import broadcast_if_small, cut


def map_annotation(keys: DataFrame, table: DataFrame, key: str, ontology: list[str] | None = None, evidence: list[str] | None = None) -> DataFrame:
    """Keys with their rows of an annotation table (a left lookup: keys without any keep nulls), of the given kinds, once each."""
    x = keys.join(table, key, "left")
    x = x if ontology is None else x.filter(F.col("ontology").isin(ontology))
    x = x if evidence is None else x.filter(F.col("evidence").isin(evidence))
    return x.drop("evidence").distinct()


def add_terms(annotation: DataFrame, terms: DataFrame, key: str = "set_id", term_key: str = "term_id") -> DataFrame:
    """Names of the sets; sets without a name and names without a set both stay."""
    t = terms.withColumnRenamed(term_key, key)
    return annotation.join(t, key, "full")


def filter_by_size(annotation: DataFrame, lower: float, upper: float, set_id: str = "set_id", closed: bool = False, distinct: str | None = None) -> DataFrame:
    """Rows of sets of lower <= size < upper (<= upper if closed); size is the rows, or the distinct values of a column."""
    size = F.count("*") if distinct is None else F.countDistinct(distinct)
    n = annotation.groupBy(set_id).agg(size.alias("n_"))
    ok = (F.col("n_") >= lower) & ((F.col("n_") <= upper) if closed else (F.col("n_") < upper))
    return annotation.join(n.filter(ok).select(set_id), set_id, "left_semi")


def filter_go(annotation: DataFrame, ontology_ids: DataFrame | None = None, lower: float = 1, upper: float = float("inf"), branch: list[str] | None = None) -> DataFrame:
    """The annotation restricted to terms of an ontology subset, by size (rows, upper end open), then to branches."""
    x = annotation if ontology_ids is None else annotation.join(ontology_ids, annotation["set_id"] == ontology_ids["id"], "left_semi")
    x = filter_by_size(x, lower, upper)
    return x if branch is None else x.filter(F.col("ontology").isin(branch))


def explode_catalogue(catalogue: DataFrame, trait_uri: str = "MAPPED_TRAIT_URI", trait: str = "MAPPED_TRAIT", gene: str = "MAPPED_GENE") -> tuple[DataFrame, DataFrame]:
    """Maps (trait_uri, uri, name) and (gene, gene_name) of the cells that hold lists.

    Distinct cells are split, not rows. Names go with addresses by place where both lists are of one length; otherwise each
    address keeps the whole name cell. Genes are parted by comma or hyphen.
    """
    t = catalogue.filter((F.col(trait_uri) != "")).select(trait_uri, trait).distinct()
    uris, labels = F.split(F.col(trait_uri), ", "), F.split(F.col(trait), ", ")
    pairs = F.when(F.size(uris) == F.size(labels), F.arrays_zip(uris.alias("uri"), labels.alias("name"))).otherwise(F.transform(uris, lambda u: F.struct(u.alias("uri"), F.col(trait).alias("name"))))
    t = t.select(trait_uri, F.explode(pairs).alias("p")).select(trait_uri, F.col("p.uri").alias("uri"), F.col("p.name").alias("name"))
    g = catalogue.filter(F.col(gene) != "").select(gene).distinct()
    return t, g.select(gene, F.explode(names.split_cell(F.col(gene), ", | - ")).alias("gene_name")).distinct()


def map_catalogue(catalogue: DataFrame, keys: DataFrame, lower: float = 1, upper: float = float("inf"), context: list[str] | None = None, context_col: str = "CONTEXT") -> DataFrame:
    """A trait catalogue with one row for each trait and gene of the keys; traits of lower..upper distinct genes, of the given contexts."""
    t, g = explode_catalogue(catalogue)
    x = catalogue.join(t, "MAPPED_TRAIT_URI", "right").join(g, "MAPPED_GENE", "right").join(keys.withColumnRenamed("gene", "gene_name"), "gene_name")
    x = filter_by_size(x, lower, upper, "uri", closed=True, distinct="gene_name")
    return x if context is None else x.filter(F.col(context_col).rlike("|".join(context)))


def map_targets(table: DataFrame, keys: DataFrame, lower: float = 1, upper: float = float("inf")) -> DataFrame:
    """Sets of targets: sizes are counted before the keys are matched."""
    return filter_by_size(table, lower, upper, closed=True, distinct="gene").join(keys, "gene")


def map_identifiers(keys: DataFrame, table: DataFrame, key: str, column: str, pick_one: bool = True, order: str | None = None) -> DataFrame:
    """Keys with an annotation column; with `pick_one` only the first by `order`. ROWNAMES holds it, or the key where it is null."""
    x = keys.join(table, key, "left")
    if pick_one:
        n = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order or column).asc_nulls_last()))
        x = x.withColumn("n_", n).filter("n_ = 1").drop("n_")
    return x.withColumn("ROWNAMES", F.coalesce(column, key))


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left rows with the first matching right row by `order`; none keeps nulls."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return left.join(right.withColumn("n_", n).filter("n_ = 1").drop("n_"), key, "left")


def auc_scores(long: DataFrame, sets: DataFrame, max_rank: int) -> DataFrame:
    """(sample_id, set_id, auc): area under the recovery curve of each set in the sample's first max_rank features.

    Features are ranked from high to low within a sample, ties by name; a hit at rank r < T counts T - r, over the most a
    set of its size could reach. Sets without a hit in a sample are absent there. Absent (zero) features rank nowhere.
    """
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.col("value").desc(), "feature"))
    hits = long.filter(F.col("value").isNotNull()).withColumn("r", place).filter(F.col("r") < max_rank)
    s = sets.distinct()
    size = s.groupBy("set_id").agg(F.count("*").alias("m"))
    m = F.least(F.col("m"), F.lit(max_rank - 1))
    size = size.select("set_id", (m * max_rank - m * (m + 1) / 2).alias("most"))
    small, _ = broadcast_if_small(s.join(size, "set_id"))
    x = hits.join(small, hits["feature"] == small["gene"])
    return x.groupBy("sample_id", "set_id").agg((F.sum(max_rank - F.col("r")) / F.first("most")).alias("auc"))


def binary_scores(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores as 0 or 1 by a threshold for each set (set_id, threshold)."""
    t, _ = broadcast_if_small(thresholds)
    return scores.join(t, "set_id").withColumn("active", (F.col("auc") > F.col("threshold")).cast("int")).drop("threshold")


def otsu_thresholds(scores: DataFrame, bins: int = 100) -> DataFrame:
    """(set_id, threshold): the cut of the score histogram that parts it best (largest variance between the two sides)."""
    h = scores.groupBy("set_id", F.least(F.lit(bins - 1), F.floor(F.col("auc") * bins)).alias("b")).agg(F.count("*").alias("n"), F.sum("auc").alias("s"))
    w = Window.partitionBy("set_id")
    up = w.orderBy("b")
    h = h.withColumns({"n0": F.sum("n").over(up), "s0": F.sum("s").over(up), "na": F.sum("n").over(w), "sa": F.sum("s").over(w)}).filter("n0 < na")
    gap = F.col("s0") / F.col("n0") - (F.col("sa") - F.col("s0")) / (F.col("na") - F.col("n0"))
    h = h.withColumn("v", F.col("n0") * (F.col("na") - F.col("n0")) * gap * gap)
    return h.groupBy("set_id").agg((F.max_by("b", "v") + 1).alias("b")).select("set_id", (F.col("b") / bins).alias("threshold"))


def set_matrix(sets: DataFrame) -> DataFrame:
    """(gene, set_id, n): how often each gene stands in each set; absent pairs are zeros."""
    return sets.groupBy("gene", "set_id").agg(F.count("*").alias("n"))


#: Entries of a gene-by-set matrix that is inverted as it is, and sets or genes, whichever are fewer, of a larger one whose products are.
DENSE, SIDE = 20_000_000, 2_000


def pinv_scores(long: DataFrame, sets: DataFrame, noself: bool = False) -> DataFrame:
    """(sample_id, set_id, score): pseudo-inverse of the gene-by-set counts times each sample's values.

    Genes that no sample has take no part; empty sets are dropped. A matrix of at most DENSE entries is inverted on the driver. Of a larger one
    the products of its sets with each other are, or those of its genes if these are fewer; where both are more than SIDE, the scores are
    found by conjugate gradients in joins.
    """
    genes = long.select(F.col("feature").alias("gene")).distinct()
    m = cut(set_matrix(sets.join(genes, "gene", "left_semi")))
    n_genes, n_sets = m.agg(F.countDistinct("gene"), F.countDistinct("set_id")).first()
    rows = long.filter(F.col("value").isNotNull())
    if n_genes * n_sets > DENSE:
        return _large_pinv(rows, m, n_genes, n_sets, noself)
    m = m.toPandas()
    genes_, cols = sorted(m["gene"].unique()), sorted(m["set_id"].unique())
    g = np.zeros((len(genes_), len(cols)))
    at, to = {x: i for i, x in enumerate(genes_)}, {x: i for i, x in enumerate(cols)}
    for r in m.itertuples():
        if not (noself and r.gene == r.set_id):
            g[at[r.gene], to[r.set_id]] = r.n
    inv = long.sparkSession.sparkContext.broadcast((at, cols, np.linalg.pinv(g)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, sets_, p = inv.value
        for b in batches:
            out = []
            for i, f, v in zip(b["sample_id"], b["features"], b["values"]):
                idx = [place[x] for x in f if x in place]
                val = np.array([y for x, y in zip(f, v) if x in place], float)
                out.append(p[:, idx] @ val if idx else np.zeros(len(sets_)))
            yield pd.DataFrame({"sample_id": b["sample_id"], "scores": out})

    id_ = dict(long.dtypes)["sample_id"]
    rows_ = rows.groupBy("sample_id").agg(F.collect_list("feature").alias("features"), F.collect_list("value").alias("values"))
    got = rows_.mapInPandas(run, f"sample_id {id_}, scores array<double>")
    x = got.select("sample_id", F.posexplode("scores").alias("j", "score"))
    return x.select("sample_id", F.array(*map(F.lit, cols))[F.col("j")].alias("set_id"), "score") if cols else x.select("sample_id", F.lit("").alias("set_id"), "score").limit(0)


def _large_pinv(rows: DataFrame, m: DataFrame, n_genes: int, n_sets: int, noself: bool) -> DataFrame:
    """`pinv_scores` of a large matrix (gene, set_id, n): (G'G)+ G' or G' (GG')+ times the values, whichever has the smaller products."""
    kept = m.filter(F.col("gene") != F.col("set_id")) if noself else m
    kept = kept.select("gene", "set_id", F.col("n").cast("double").alias("n"))
    if min(n_genes, n_sets) > SIDE:
        return _scores_by_gradients(rows, m, kept)
    by, over = ("set_id", "gene") if n_sets <= n_genes else ("gene", "set_id")
    names_ = sorted(r[0] for r in m.select(by).distinct().collect())  # at most SIDE
    spark = rows.sparkSession
    place = spark.createDataFrame(list(enumerate(names_)), f"j int, {by} {dict(m.dtypes)[by]}")
    e = cut(kept.join(F.broadcast(place), by))
    inv = spark.sparkContext.broadcast(_pinv_of_products(_products(e, over, "j").toPandas(), len(names_)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = inv.value
        for b in batches:
            out = []
            for js, vs in zip(b["js"], b["vs"]):
                y = np.zeros(len(p))
                np.add.at(y, np.asarray(js, int), np.asarray(vs, float))
                out.append(p @ y)
            yield pd.DataFrame({"sample_id": b["sample_id"], "scores": out})

    key = e.select(F.col("gene").alias("feature"), "j", "n") if by == "set_id" else place.select(F.col("gene").alias("feature"), "j", F.lit(1.0).alias("n"))
    # A sample without any such gene keeps a row with a null j, and so its zeros.
    y = rows.join(key, "feature", "left").groupBy("sample_id", "j").agg(F.sum(F.col("n") * F.col("value")).alias("v"))
    held = F.col("j").isNotNull()
    y = y.groupBy("sample_id").agg(F.collect_list(F.when(held, F.col("j"))).alias("js"), F.collect_list(F.when(held, F.col("v"))).alias("vs"))
    got = y.mapInPandas(run, f"sample_id {dict(rows.dtypes)['sample_id']}, scores array<double>")
    x = got.select("sample_id", F.posexplode("scores").alias("j", "score"))
    if by == "set_id":
        return x.select("sample_id", F.array(*map(F.lit, names_))[F.col("j")].alias("set_id"), "score")
    alone = m.select("set_id").distinct().join(kept, "set_id", "left_anti").select("set_id", F.lit(0).alias("j"), F.lit(0.0).alias("n"))
    x = x.join(e.select("set_id", "j", "n").unionByName(alone), "j")
    return x.groupBy("sample_id", "set_id").agg(F.sum(F.col("n") * F.col("score")).alias("score"))


def _products(e: DataFrame, over: str, of: str) -> DataFrame:
    """(a, b, w): the sum over `over` of the products of the entries of each two `of`, both ways round; absent pairs are zeros."""
    x = e.select(over, F.col(of).alias("a"), F.col("n").alias("n_a")).join(e.select(over, F.col(of).alias("b"), F.col("n").alias("n_b")), over)
    return x.groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("w"))


def _pinv_of_products(pairs: pd.DataFrame, n: int) -> np.ndarray:
    """The pseudo-inverse of a symmetric matrix of (a, b, w); parts that no entry links are inverted by themselves, so each has its own measure of what is zero."""
    a, b, w = pairs["a"].to_numpy(int), pairs["b"].to_numpy(int), pairs["w"].to_numpy(float)
    g = np.zeros((n, n))
    g[a, b] = w
    part = np.arange(n)
    while True:
        low = part.copy()
        np.minimum.at(low, a, part[b])
        low = low[low]
        if (low == part).all():
            break
        part = low
    out = np.zeros((n, n))
    for q in np.unique(part):
        at = np.flatnonzero(part == q)
        own = np.ix_(at, at)
        out[own] = np.linalg.pinv(g[own], rcond=4 * len(at) * np.finfo(float).eps, hermitian=True)
    return out


def _scores_by_gradients(rows: DataFrame, m: DataFrame, kept: DataFrame, least: float = 1e-11) -> DataFrame:
    """Scores x of G'G x = G'v by conjugate gradients from 0, which lead to the shortest solution: a join with the products for each step.

    A sample rests when its residual is `least` of that at the start; if some never do, that is an error.
    """
    w = cut(_products(kept, "gene", "set_id"))
    y = rows.join(kept, rows["feature"] == kept["gene"]).groupBy("sample_id", "set_id").agg(F.sum(F.col("n") * F.col("value")).alias("r"))
    state = cut(y.select("sample_id", "set_id", F.lit(0.0).alias("x"), "r", F.col("r").alias("p")))
    norms = cut(state.groupBy("sample_id").agg(F.sum(F.col("r") * F.col("r")).alias("rr")).withColumn("rr0", F.col("rr")))
    for _ in range(10_000):
        open_ = norms.filter(~F.isnan("rr") & (F.col("rr") > F.col("rr0") * least**2))
        if not open_.take(1):
            break
        p = state.join(open_.select("sample_id"), "sample_id", "left_semi")
        q = p.select("sample_id", F.col("set_id").alias("a"), "p").join(w, "a").groupBy("sample_id", F.col("b").alias("set_id")).agg(F.sum(F.col("w") * F.col("p")).alias("q"))
        s = state.join(q, ["sample_id", "set_id"], "full").na.fill(0.0, ["x", "r", "p", "q"])
        s = cut(s)
        step = s.groupBy("sample_id").agg(F.sum(F.col("p") * F.col("q")).alias("pq")).join(norms, "sample_id").select("sample_id", "rr", "rr0", F.when(F.col("pq") > 0, F.col("rr") / F.col("pq")).otherwise(0.0).alias("alpha"))
        s = s.join(step, "sample_id").withColumns({"x": F.col("x") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * F.col("q")})
        s = cut(s.select("sample_id", "set_id", "x", "r", "p", "rr", "rr0"))
        new = cut(s.groupBy("sample_id").agg(F.sum(F.col("r") * F.col("r")).alias("new")))
        s = s.join(new, "sample_id").withColumn("p", F.col("r") + F.when(F.col("rr") > 0, F.col("new") / F.col("rr")).otherwise(0.0) * F.col("p"))
        norms = cut(norms.join(new, "sample_id").select("sample_id", F.col("new").alias("rr"), "rr0"))
        state = cut(s.select("sample_id", "set_id", "x", "r", "p"))
    else:
        raise RuntimeError("the scores did not converge")
    every = rows.select("sample_id").distinct().crossJoin(m.select("set_id").distinct())
    broken = norms.filter(F.isnan("rr")).select(F.col("sample_id").alias("s_"), F.lit(float("nan")).alias("nan_"))
    x = every.join(state.select(F.col("sample_id").alias("s_"), F.col("set_id").alias("c_"), "x"), F.col("sample_id").eqNullSafe(F.col("s_")) & (F.col("set_id") == F.col("c_")), "left").drop("s_")
    x = x.join(broken, F.col("sample_id").eqNullSafe(F.col("s_")), "left")
    return x.select("sample_id", "set_id", F.coalesce("nan_", "x", F.lit(0.0)).alias("score"))


def measure_activity(long: DataFrame, annotation: DataFrame, method: str = "auc", max_share: float = 0.05, lower: float = 1, upper: float = float("inf"), branch: list[str] | None = None) -> DataFrame:
    """(sample_id, set_id, set_key, score): filtered sets scored by 'auc' or 'pseudoinverse', with cleaned set names."""
    sets = filter_go(annotation, None, lower, upper, branch).select("set_id", "gene")
    if method == "auc":
        n = long.select("feature").distinct().count()
        s = auc_scores(long, sets, max(2, round(n * max_share))).withColumnRenamed("auc", "score")
    else:
        s = pinv_scores(long, sets)
    return s.withColumn("set_key", names.sanitize(F.col("set_id")))


#: The branches of the ontology, and the sources of sets besides.
BRANCHES, OTHERS = ("BP", "MF", "CC"), ("gwas", "promoter_TF", "custom")


def activity_of(long: DataFrame, which: str, table: DataFrame, method: str = "auc", lower: float = 1, upper: float = float("inf"), context: list[str] | None = None, max_share: float = 0.05) -> DataFrame:
    """`measure_activity` by the kind of table that holds the sets.

    A branch (BP, MF, CC): an annotation (set_id, gene, ontology), of which the branch counts, with the upper size open. gwas: a trait catalogue
    with lists in its cells, sets are traits. promoter_TF: targets (set_id, gene), sized before they meet the features. custom: (set_id, gene),
    sized after. Only genes that are features count in gwas and custom.
    """
    keys = long.select(F.col("feature").alias("gene")).distinct()
    if which in BRANCHES:
        sets = filter_by_size(table.filter(F.col("ontology") == which), lower, upper)
    elif which == "gwas":
        sets = map_catalogue(table, keys, lower, upper, context).select(F.col("uri").alias("set_id"), F.col("gene_name").alias("gene")).distinct()
    elif which == "promoter_TF":
        sets = map_targets(table, keys, lower, upper)
    elif which == "custom":
        sets = filter_by_size(table.join(keys, "gene"), lower, upper, closed=True, distinct="gene")
    else:
        raise ValueError(f"{which} is none of {', '.join(BRANCHES + OTHERS)}")
    return measure_activity(long, sets.select("set_id", "gene"), method, max_share)


def ancestors(terms: DataFrame) -> DataFrame:
    """(id, ancestor) of every term of (id, parents array<string>): itself and all it is reached from by parents, whatever the way; circles are harmless."""
    up = cut(terms.filter("id is not null").select("id", F.explode("parents").alias("up")).filter("up is not null").distinct())
    own = terms.filter("id is not null").select("id", F.col("id").alias("ancestor")).distinct()
    found = new = cut(own)
    while new.take(1):
        step = new.join(up.select(F.col("id").alias("ancestor"), "up"), "ancestor").select("id", F.col("up").alias("ancestor")).distinct()
        new = cut(step.join(found, ["id", "ancestor"], "left_anti"))
        found = cut(found.unionByName(new))
    return found


def propagate(annotation: DataFrame, terms: DataFrame, set_id: str = "set_id") -> DataFrame:
    """The annotation with each row also under all ancestors of its term, once; terms that the ontology does not have stay as they are."""
    a = ancestors(terms).withColumnRenamed("id", set_id)
    x = annotation.join(a, set_id, "left").withColumn(set_id, F.coalesce("ancestor", set_id)).drop("ancestor")
    return x.distinct()


def catalogue_lookup(catalogue: DataFrame, taxon: str | int, kind: str, taxon_col: str = "taxonomyid", kind_col: str = "rdataclass") -> DataFrame:
    """The entries of a catalogue of annotation tables for a taxon and a class of table; none is an error."""
    x = catalogue.filter((F.col(taxon_col) == F.lit(taxon)) & (F.col(kind_col) == kind))
    if not x.take(1):
        raise LookupError(f"no table of class {kind} for taxon {taxon}")
    return x
