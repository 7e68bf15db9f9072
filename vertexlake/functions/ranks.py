"""Ranks and running values of whole columns without gathering a group or the table in one task.

A group's values are cut into stretches by the leading bits of their codes (1024 between a number and its double), so the
stretches are in the order of the values. Counts of the stretches give each one's start, and a window works inside one
stretch only. Ties are counted once for each distinct value where ranks are averaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.functions.doubles import signed_code
from vertexlake.session import broadcast_if_small, cut

#: Bits of a value's code that a stretch leaves out.
BITS = 42


def stretched(df: DataFrame, value: str, bits: int = BITS) -> DataFrame:
    """`df` with the column stretch_; a null or NaN value comes last."""
    return df.withColumn("stretch_", F.coalesce(F.shiftright(signed_code(F.col(value)), bits), F.lit(2**62)))


def before(counted: DataFrame, by: list[str]) -> DataFrame:
    """Of (by, stretch_, n_): before_, the n_ of the stretches below, and all_, that of the group. A null group is one group."""
    w = Window.partitionBy(*by)
    out = counted.withColumn("before_", F.sum("n_").over(w.orderBy("stretch_")) - F.col("n_")).withColumn("all_", F.sum("n_").over(w)).drop("n_")
    return broadcast_if_small(out)[0]


def with_before(x: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """`x` joined with the starts of its stretches."""
    s = starts.withColumnsRenamed({b: f"{b}_g" for b in by}).withColumnRenamed("stretch_", "stretch_g")
    on = [F.col("stretch_") == F.col("stretch_g"), *[F.col(b).eqNullSafe(F.col(f"{b}_g")) for b in by]]
    return x.join(s, on).drop("stretch_g", *[f"{b}_g" for b in by])


def row_numbers(df: DataFrame, by: list[str], value: str, ties: list[str | Column], out: str = "rn", total: str | None = None, bits: int = BITS) -> DataFrame:
    """`out`: the place of each row within its group by ascending value, ties by `ties`; nulls and NaN last. `total`: the group's rows."""
    x = stretched(df, value, bits)
    starts = before(x.groupBy(*by, "stretch_").agg(F.count("*").alias("n_")), by)
    own = F.row_number().over(Window.partitionBy(*by, "stretch_").orderBy(F.col(value).asc_nulls_last(), *ties))
    x = with_before(x.withColumn(out, own), starts, by).withColumn(out, (F.col(out) + F.col("before_")).cast("bigint"))
    x = x.withColumn(total, F.col("all_")) if total else x
    return x.drop("stretch_", "before_", "all_")


def value_ranks(df: DataFrame, by: list[str], value: str, bits: int = BITS) -> DataFrame:
    """(by, value, n, rank, n_all) for each distinct value that is neither null nor NaN: its count and its average rank."""
    good = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    x = stretched(good.groupBy(*by, value).agg(F.count("*").alias("n")), value, bits)
    starts = before(x.groupBy(*by, "stretch_").agg(F.sum("n").alias("n_")), by)
    w = Window.partitionBy(*by, "stretch_").orderBy(value)
    x = with_before(x.withColumn("upto_", F.sum("n").over(w)), starts, by)
    rank = F.col("before_") + F.col("upto_") - F.col("n") + (F.col("n") + 1) / 2
    return x.select(*by, value, "n", rank.alias("rank"), F.col("all_").alias("n_all"))


def numbered(df: DataFrame, order: list[Column], out: str = "rn") -> DataFrame:
    """The table with each row's place in a total order: range-partitioned, numbered inside the partitions."""
    parts = cut(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    n = parts.groupBy("part_").agg(F.count("*").alias("n_"))
    n = n.withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).drop("n_")  # a row for each partition
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return parts.withColumn(out, own).join(F.broadcast(n), "part_").withColumn(out, (F.col(out) + F.col("before_")).cast("bigint")).drop("before_")


def running_min_from_end(df: DataFrame, rn: str, part: str, value: Column, out: str) -> DataFrame:
    """`out`: the least `value` of this row and all later ones, of a table made by `numbered`."""
    x = df.withColumn(out, value)
    least = x.groupBy(part).agg(F.min(out).alias("m_"))
    later = Window.orderBy(part).rowsBetween(1, Window.unboundedFollowing)  # a row for each partition
    least = least.withColumn("after_", F.min("m_").over(later)).drop("m_")
    # from the end on, as a frame that only grows
    own = F.min(out).over(Window.partitionBy(part).orderBy(F.col(rn).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn(out, own).join(F.broadcast(least), part).withColumn(out, F.least(out, "after_")).drop("after_")
