"""Work on tables of archetypes: order, names, alignment, variances, permutations."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexlake.functions import keyed, ranks, vectors
from vertexlake.operators import geometry
from vertexlake.session import broadcast_if_small


def ordered(archetypes: DataFrame, by: list[str], kind: str = "cosine") -> DataFrame:
    """(by, arch_id, place): a fixed order within each fit, ties by arch_id; see `geometry.order_of`."""
    p = F.col("position")
    score = F.coalesce(F.get(p, 1), F.lit(0.0)) - F.get(p, 0) if kind == "side" else F.try_divide(vectors.total(p), F.sqrt(2 * vectors.dot(p, p)))
    w = Window.partitionBy(*by).orderBy(F.round(score, 9), "arch_id")  # a few archetypes for each fit
    return archetypes.select(*by, "arch_id", F.row_number().over(w).cast("bigint").alias("place"))


def annotate(archetypes: DataFrame, labels: dict[str, list[int]]) -> DataFrame:
    """`arch_name`: label_index for the listed indices, archetype_index for the others."""
    pairs = [x for name, ids in labels.items() for i in ids for x in (F.lit(i), F.lit(name))]
    name = F.create_map(*pairs)[F.col("arch_id")] if pairs else F.lit(None)
    return archetypes.withColumn("arch_name", F.concat_ws("_", F.coalesce(name, F.lit("archetype")), "arch_id"))


def align_tables(archetypes: DataFrame) -> DataFrame:
    """(fit_id, total, order): each fit's archetypes in the order nearest to the first fit's, by optimal assignment.

    Fits of another number of archetypes have nulls.
    """
    packed = archetypes.groupBy("fit_id").agg(F.sort_array(F.collect_list(F.struct("arch_id", "position"))).alias("own"))
    ref = packed.orderBy("fit_id").limit(1).select(F.col("own").alias("ref"))
    first = ref.collect()
    if not first:
        return packed.select("fit_id", F.lit(None).cast("double").alias("total"), F.lit(None).cast("array<int>").alias("order"))
    a = np.array([list(e.position) for e in first[0].ref], float).T

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                o = np.array([list(e["position"]) for e in r.own], float).T
                total, order = geometry.align(a, o) if a.shape == o.shape else (None, None)
                out.append((r.fit_id, total, None if order is None else [int(j) + 1 for j in order]))
            yield pd.DataFrame(out, columns=["fit_id", "total", "order"])

    return packed.mapInPandas(run, "fit_id string, total double, order array<int>")


def permutations(spark: SparkSession, n: int) -> DataFrame:
    """(perm array<int>): all orders of 1..n, n at most 10."""
    if n > 10:
        raise ValueError("too many orders")
    return spark.createDataFrame([(list(p),) for p in itertools.permutations(range(1, n + 1))], "perm array<int>")


def extreme_variance(samples: DataFrame, share: float, dims: int) -> DataFrame:
    """(pos, v): variance of each dimension over its floor(n * share / dims / 2) lowest and as many highest values."""
    x = samples.select("sample_id", F.posexplode("features").alias("pos", "value"))
    x = ranks.row_numbers(x, ["pos"], "value", ["sample_id"], "rn", total="n")
    m = F.floor(F.col("n") * share / dims / 2)
    return x.filter((F.col("rn") <= m) | (F.col("rn") > F.col("n") - m)).groupBy("pos").agg(F.var_samp("value").alias("v"))


def zscore(long: DataFrame, by: list[str]) -> DataFrame:
    """`value` less its mean over its standard deviation (n - 1) within each group; null where there is no spread."""
    m, _ = broadcast_if_small(long.groupBy(*by).agg(F.avg("value").alias("m_"), F.stddev_samp("value").alias("s_")))
    return long.join(m, by).withColumn("value", F.when(F.col("s_") > 0, (F.col("value") - F.col("m_")) / F.col("s_"))).select("sample_id", *by, "value")


def quality(long: DataFrame, marker: DataFrame) -> DataFrame:
    """(sample_id, total, detected, marker_share): sum of values, share of all features present, share of the sum in a set."""
    n = long.select("feature").distinct().count()
    m, _ = broadcast_if_small(marker.distinct().withColumn("in_", F.lit(1)))
    x = long.join(m, "feature", "left").groupBy("sample_id")
    inside = F.sum(F.when(F.col("in_") == 1, F.col("value")).otherwise(0.0))
    return x.agg(F.sum("value").alias("total"), (F.count("*") / float(max(n, 1))).alias("detected"), F.try_divide(inside, F.sum("value")).alias("marker_share"))


def permute_features(long: DataFrame, seed: int, replicate: int | None = None, replace: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """(sample_id, feature, value): each feature's values dealt anew to the samples, every value once.

    The i-th sample by one key gets the i-th value by another; keys are uniform, so no task holds a feature. With `weights`
    (sample_id, weight) heavy samples' values come early in that order, as in draws without replacement; samples without positive weight come last.
    With `replace` each sample draws a value of its own: the one whose place (by sample) a uniform number names, with `weights` the one whose
    stretch of the summed weights holds it (samples without positive weight are never drawn).
    """
    rep = [] if replicate is None else [F.lit(replicate)]
    if weights is not None:
        long = long.join(weights.select("sample_id", F.col("weight").cast("double").alias("w_")), "sample_id", "left")
    u = keyed.uniform(seed, "permute", *rep, F.col("feature"), F.col("sample_id"))
    if not replace:
        key = u if weights is None else F.coalesce(-keyed.exponential_rank(seed, "permute", F.col("w_"), *rep, F.col("feature"), F.col("sample_id")), u + 1e300)
        x = long.withColumn("a_", keyed.uniform(seed, "place", *rep, F.col("sample_id"))).withColumn("b_", key)
        a = ranks.row_numbers(x, ["feature"], "a_", ["sample_id"], "rn").select("feature", "sample_id", "rn")
        b = ranks.row_numbers(x, ["feature"], "b_", ["sample_id"], "rn").select("feature", "value", "rn")
        return a.join(b, ["feature", "rn"]).select("sample_id", "feature", "value")
    order = long if weights is None else long.filter("w_ > 0")
    n = ranks.numbered(order.select("feature", "sample_id", "value", *(["w_"] if weights is not None else [])), [F.col("feature"), F.col("sample_id")], "at_")
    n = n.drop("part_")
    first = n.groupBy("feature").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    first, _ = broadcast_if_small(first)
    n = n.join(first, "feature").withColumn("at_", F.col("at_") - F.col("first_"))
    if weights is None:
        want = long.select("sample_id", "feature", u.alias("u_")).join(first, "feature").select("sample_id", "feature", F.floor(F.col("u_") * F.col("n_")).alias("at_"))
        return want.join(n.select("feature", "at_", "value"), ["feature", "at_"]).select("sample_id", "feature", "value")
    # Summed weights: the samples' weights are the same in every feature, so a place is looked up among cells of the unit interval.
    upto = F.sum("w_").over(Window.partitionBy("feature").orderBy("at_"))
    z = n.withColumn("z_", upto / F.sum("w_").over(Window.partitionBy("feature"))).withColumn("y_", F.lag("z_", 1, 0.0).over(Window.partitionBy("feature").orderBy("at_")))
    cells = 1_024
    z = z.withColumn("cell_", F.explode(F.sequence(F.floor(F.col("y_") * cells), F.least(F.floor(F.col("z_") * cells), F.lit(cells - 1)))))
    want = long.select("sample_id", "feature", u.alias("u_")).withColumn("cell_", F.floor(F.col("u_") * cells))
    got = want.join(z.select("feature", "cell_", "y_", "z_", "value"), ["feature", "cell_"])
    return got.filter((F.col("u_") >= F.col("y_")) & (F.col("u_") < F.col("z_"))).select("sample_id", "feature", "value")


def permute_rows(features: DataFrame, seed: int, replicate: int = 0) -> DataFrame:
    """(feature, values): each feature's values in a new order, of a table that holds a feature in one row as an array.

    The order depends on the seed, the replicate and the feature's name alone. For features that fit a row (some 10 million values); longer
    ones are permuted by `permute_features`. A null array stays null.
    """

    def run(batches):
        for b in batches:
            lists = b.column("values")
            flat, ends = np.array(lists.values.to_numpy(zero_copy_only=False)), lists.offsets.to_numpy()
            for name, i, j in zip(b.column("feature").to_pylist(), ends[:-1], ends[1:]):
                key = hashlib.md5(f"{seed}|permute|{replicate}|{name}".encode()).digest()[:8]
                np.random.Generator(np.random.PCG64(int.from_bytes(key, "big"))).shuffle(flat[i:j])
            made = pa.ListArray.from_arrays(lists.offsets, pa.array(flat), mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([b.column("feature"), made], ["feature", "values"])

    return features.select("feature", "values").mapInArrow(run, "feature string, values array<double>")


def resample_weighted(samples: DataFrame, n: int, weight: str, seed: int = 435) -> DataFrame:
    """n samples without replacement with chances in proportion to a weight; rows without positive weight are never drawn."""
    x = samples.withColumn("key_", -keyed.exponential_rank(seed, "weighted", F.col(weight), F.col("sample_id"))).filter("key_ is not null")
    return ranks.row_numbers(x, [], "key_", ["sample_id"], "rn_").filter(F.col("rn_") <= n).drop("key_", "rn_")
