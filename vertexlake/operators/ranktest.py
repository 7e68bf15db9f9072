"""Rank tests of each feature near each archetype against all other samples, corrections for many tests, labels.

One pass ranks every feature's values (`value_ranks`), all archetypes share it; sums over a bin then give each
statistic. Neither a feature nor a bin is gathered in one task. Values that are null or NaN take no part; a bin without
values, or one that holds all of them, gives null statistics; constant features give a null z.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vertexlake.functions import ranks
from vertexlake.session import broadcast_if_small


@F.pandas_udf(DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """P(Z >= z) of a standard normal number."""
    return z.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / math.sqrt(2.0)))


def rank_statistics(long: DataFrame, bins: DataFrame) -> DataFrame:
    """(x_name, y_name, sample_count, u, z, mean_diff, top_bin_mean) for each archetype and feature.

    `long` is (sample_id, feature, value), each pair once; bins (arch, sample_id), repeats counting again. z has the tie and
    half-unit continuity corrections, for the question whether the bin is higher.
    """
    good = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    r = ranks.value_ranks(good, ["feature"], "value")
    per = r.groupBy("feature").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("sum_all"), F.sum(F.pow(F.col("n"), 3.0) - F.col("n")).alias("ties"))
    small, _ = broadcast_if_small(bins)
    inside = good.join(small, "sample_id").groupBy(F.col("arch"), "feature", "value").agg(F.count("*").alias("m"))
    inside = inside.join(r.select("feature", "value", "rank"), ["feature", "value"])
    got = inside.groupBy("arch", "feature").agg(F.sum("m").alias("n1"), F.sum(F.col("m") * F.col("rank")).alias("r1"), F.sum(F.col("m") * F.col("value")).alias("s1"))
    x = got.join(per, "feature")
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n0 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0)))
    z = F.when(var > 0, (u - n1 * n0 / 2 - 0.5) / F.sqrt(var))
    mean1, mean0 = F.col("s1") / n1, F.when(n0 > 0, (F.col("sum_all") - F.col("s1")) / n0)
    return x.select(F.col("arch").alias("x_name"), F.col("feature").alias("y_name"), F.col("n1").alias("sample_count"), u.alias("u"), z.alias("z"), (mean1 - mean0).alias("mean_diff"), mean1.alias("top_bin_mean"))


def median_differences(long: DataFrame, bins: DataFrame) -> DataFrame:
    """(x_name, y_name, median_diff): median inside the bin less the median of all other samples, exact."""
    good = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = good.groupBy("feature", "value").agg(F.count("*").alias("n"))
    small, _ = broadcast_if_small(bins)
    inside = good.join(small, "sample_id").groupBy("arch", "feature", "value").agg(F.count("*").alias("n"))
    names, _ = broadcast_if_small(inside.select("arch", "feature").distinct())  # archetypes by features
    out = counts.join(names, "feature").join(inside.withColumnRenamed("n", "m"), ["arch", "feature", "value"], "left")
    out = out.select("arch", "feature", "value", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).filter("n > 0")
    both = inside.withColumn("side", F.lit(1)).unionByName(out.withColumn("side", F.lit(0)))
    m = weighted_median(both, ["arch", "feature", "side"], "value", "n")
    m = m.groupBy("arch", "feature").agg(F.sum(F.when(F.col("side") == 1, F.col("median"))).alias("a"), F.sum(F.when(F.col("side") == 0, F.col("median"))).alias("b"))
    return m.select(F.col("arch").alias("x_name"), F.col("feature").alias("y_name"), (F.col("a") - F.col("b")).alias("median_diff"))


def weighted_median(counts: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """(by, median) of values with counts: the mean of the two middle values of an even number."""
    x = ranks.stretched(counts, value)
    starts = ranks.before(x.groupBy(*by, "stretch_").agg(F.sum(n).alias("n_")), by)
    w = Window.partitionBy(*by, "stretch_").orderBy(value)
    x = ranks.with_before(x.withColumn("upto_", F.sum(n).over(w)), starts, by)
    x = x.withColumn("hi_", F.col("before_") + F.col("upto_")).withColumn("lo_", F.col("hi_") - F.col(n))
    a, b = F.floor((F.col("all_") + 1) / 2), F.floor((F.col("all_") + 2) / 2)
    holds = lambda k: (F.col("lo_") < k) & (k <= F.col("hi_"))
    return x.groupBy(*by).agg(((F.sum(F.when(holds(a), F.col(value))) + F.sum(F.when(holds(b), F.col(value)))) / 2).alias("median"))


def find_decreasing_wilcox(long: DataFrame, bins: DataFrame) -> DataFrame:
    """The statistics with p, median difference and metric, as a table of test results."""
    s = rank_statistics(long, bins).join(median_differences(long, bins), ["x_name", "y_name"], "left")
    return s.select("x_name", "y_name", upper_tail("z").alias("p"), "median_diff", "mean_diff", "top_bin_mean", "sample_count", F.lit("wilcoxon_p_val").alias("metric"))


def tradeoff(long: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and bins for a test between two archetypes: only samples in either bin, one that is in both counting twice."""
    names = broadcast_if_small(bins)[0]
    rows = long.join(names, "sample_id").select(F.concat_ws("|", "sample_id", "arch").alias("sample_id"), F.col("sample_id").alias("id_"), "feature", "value")
    own = bins.withColumnRenamed("sample_id", "id_").join(bins.select(F.col("sample_id").alias("id_"), F.col("arch").alias("other")), "id_")
    return rows.drop("id_"), own.select("arch", F.concat_ws("|", "id_", "other").alias("sample_id"))


def adjust_p(df: DataFrame, p: str = "p", method: str = "fdr", out: str = "p_adj", ties: list[str] | None = None) -> DataFrame:
    """`out`: p, or with 'fdr' the Benjamini-Hochberg value over all rows whose p is neither null nor NaN; null elsewhere."""
    if method == "none":
        return df.withColumn(out, F.col(p))
    good = F.col(p).isNotNull() & ~F.isnan(p)
    keep = df.columns
    n = df.filter(good).count()
    x = ranks.numbered(df.filter(good), [F.col(p).asc(), *[F.col(t).asc() for t in ties or []]], out="rn_")
    x = ranks.running_min_from_end(x, "rn_", "part_", F.col(p) * float(n) / F.col("rn_"), out)
    x = x.withColumn(out, F.least(F.lit(1.0), F.col(out))).select(*keep, out)
    return x.unionByName(df.filter(~good).withColumn(out, F.lit(None).cast("double")))


def select_top(tests: DataFrame, cutoff: float = 0.01, metric: str = "wilcoxon_p_val", method: str = "fdr", diff: str = "mean_diff", least_diff: float = 0.3, invert: bool = False, smooth_p: float | None = None) -> DataFrame:
    """Tests of the metric that pass the corrected cutoff and the effect size, with their place within the archetype."""
    x = adjust_p(tests.filter(F.col("metric") == metric), method=method, ties=["x_name", "y_name"])
    if smooth_p is not None and "smooth_term_p_val" in tests.columns:
        x = x.filter(F.col("smooth_term_p_val") < smooth_p)
    d = F.col(diff)
    x = x.filter((F.col("p_adj") < cutoff) & (d > least_diff)) if not invert else x.filter((F.col("p_adj") >= cutoff) & (d < least_diff))
    place = F.row_number().over(Window.partitionBy("x_name").orderBy(d.desc_nulls_last(), "y_name"))
    return x.withColumn("place", place)


def labels(top: DataFrame, n: int, out: str = "label", sep: str = ", ") -> DataFrame:
    """(x_name, out): the first n names of each archetype in one text."""
    w = top.filter(F.col("place") <= n).groupBy("x_name").agg(F.sort_array(F.collect_list(F.struct("place", "y_name"))).alias("l"))
    return w.select("x_name", F.array_join(F.transform("l", lambda x: x["y_name"]), sep).alias(out))


def join_labels(genes: DataFrame, sets: DataFrame) -> DataFrame:
    """Gene and set labels of each archetype; one that has only one kind keeps a null for the other."""
    return genes.join(sets, "x_name", "full")


def top_decreasing(genes: DataFrame, sets: DataFrame | None = None, cutoff_genes: float = 0.01, cutoff_sets: float = 0.01, diff_genes: float = 0.3, diff_sets: float = 0.1) -> dict[str, DataFrame]:
    """Selected genes and sets, and the labels (12 genes, 3 sets) of each archetype."""
    g = select_top(genes, cutoff_genes, least_diff=diff_genes)
    out = {"genes": g, "gene_labels": labels(g, 12, "genes")}
    if sets is None:
        return out | {"labels": out["gene_labels"]}
    s = select_top(sets, cutoff_sets, least_diff=diff_sets)
    return out | {"sets": s, "set_labels": labels(s, 3, "sets"), "labels": join_labels(out["gene_labels"], labels(s, 3, "sets"))}
