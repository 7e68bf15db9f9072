"""Distances of samples to archetypes, and the table that joins them with features and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexlake.functions import vectors
from vertexlake.functions.ranks import value_ranks

#: Archetypes are a model: a few rows, and held in the plan up to this many.
MOST = 2_000


def as_literal(archetypes: DataFrame) -> Column:
    """The archetypes (arch, position) as one array of structs in the plan, so no join is needed to meet them."""
    rows = archetypes.select("arch", "position").orderBy("arch").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} archetypes")
    if not rows:
        return F.array().cast("array<struct<arch:string,position:array<double>>>")
    return F.array(*[F.struct(F.lit(r.arch).alias("arch"), F.array(*map(F.lit, map(float, r.position))).alias("position")) for r in rows])


def arch_dist(samples: DataFrame, archetypes: DataFrame, digits: int | None = None) -> DataFrame:
    """(sample_id, arch, dist): Euclidean distance of every sample to every archetype.

    A vector that is null or of another length has the distance null. Repeated samples give repeated rows.
    """
    x = samples.select("sample_id", "features", F.explode(as_literal(archetypes)).alias("a"))
    d = vectors.distance(F.col("features"), F.col("a.position"))
    return x.select("sample_id", F.col("a.arch").alias("arch"), (d if digits is None else F.round(d, digits)).alias("dist"))


def rank_distances(dist: DataFrame) -> DataFrame:
    """`dist` replaced by its average rank within the archetype over the number of samples: the nearest has the least."""
    r = value_ranks(dist, ["arch"], "dist")
    return dist.join(r, ["arch", "dist"]).select("sample_id", "arch", (F.col("rank") / F.col("n_all")).alias("dist"))


def wide_distances(dist: DataFrame, names: list[str]) -> DataFrame:
    """One row for each sample with a column for each archetype."""
    return dist.groupBy("sample_id").pivot("arch", names).agg(F.first("dist"))


def merge_distances(dist: DataFrame, names: list[str], features: DataFrame | None = None, annotations: DataFrame | None = None, annotation_id: str = "sample_id") -> DataFrame:
    """Wide distances, left-joined with feature columns and sample annotations; a sample without either keeps nulls."""
    out = wide_distances(dist, names)
    if features is not None:
        out = out.join(features, "sample_id", "left")
    if annotations is not None:
        out = out.join(annotations.withColumnRenamed(annotation_id, "sample_id"), "sample_id", "left")
    return out


def weight_distances(weights: DataFrame, names: list[str]) -> DataFrame:
    """(sample_id, arch, dist) with 1 - weight as the distance, from (sample_id, weights)."""
    x = weights.select("sample_id", F.posexplode("weights").alias("pos", "w"))
    return x.select("sample_id", F.array(*map(F.lit, names))[F.col("pos")].alias("arch"), (1 - F.col("w")).alias("dist"))
