"""The row-local operators on streams: a fitted model is in the plan, each arriving row is scored by itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexlake.operators import distance, models


def nearest(stream: DataFrame, archetypes: DataFrame) -> DataFrame:
    """The stream's rows with `arch` and `dist`, the nearest archetype (first name on ties). Broken vectors get nulls."""
    from vertexlake.functions import vectors

    best = F.array_min(F.transform(distance.as_literal(archetypes), lambda a: F.struct(vectors.distance(F.col("features"), a["position"]).alias("dist"), a["arch"].alias("arch"))))
    x = stream.withColumn("best_", best)
    return x.select(*stream.columns, F.when(F.col("best_.dist").isNotNull(), F.col("best_.arch")).alias("arch"), F.col("best_.dist").alias("dist"))


def classify(stream: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """The stream's rows with probabilities, class and entropy."""
    return models.classify(stream.withColumn("probabilities", models.probabilities(F.col("features"), weights, bias)))


def windowed_means(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, arch, n, mean_dist) of scored rows by event time; rows later than the watermark are left out."""
    x = stream.withWatermark(time, late).groupBy(F.window(time, width), "arch")
    return x.agg(F.count("*").alias("n"), F.avg("dist").alias("mean_dist"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now, once, each row exactly once over restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
