"""Percentiles for each group over very many values, exactly or within a stated relative error.

Exact bisection: for each group and percentile an interval of value codes (order-preserving integers, see
`functions.doubles`) holds the value of the target rank. A pass counts the rows below the midpoints of each interval,
several halvings deep at once, and narrows the interval to the part that holds the rank; rows outside every interval
take no part in later passes. The counts are sums, so rows of separate partitions, loads or days add up, and a hot
group is counted in partial sums before any shuffle.

A percentile q of n values is the value of rank ceil(q * n), at least 1, in ascending order (a value that occurs).

Mergeable form: `cells` counts the rows of each group in fixed cells of the value code. Cells of two loads are put
together by adding counts (`merge_cells`); `percentiles_of_cells` reads percentiles off them with a relative error of
at most 2**-(bits + 1), as it gives a cell's middle.

Cases: rows whose group is null, or whose value is null, NaN, infinite or negative, do not count; -0.0 counts as 0.0;
a group without usable rows has no result; an empty table gives an empty result; ties need no rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.functions.doubles import LARGEST, code_of, value_of
from vertexlake.session import attach, cut

#: Halvings made in one pass: an interval is counted in 2**12 parts.
DEPTH = 12


def usable(df: DataFrame, group: str, value: str, id_: str | None = None) -> DataFrame:
    """Columns `g` and `c` (group and value code) of the rows that count, each (id, group, value) once if an id is given.

    A row whose id is null is no repeat of any other.
    """
    v = F.col(value).cast("double")
    # The value itself is tested, so that the test reaches the scan and no code is made twice.
    counts = F.col(group).isNotNull() & (v >= 0.0) & (v <= LARGEST)
    rows = df.filter(counts).select(F.col(group).alias("g"), code_of(F.col(value)).alias("c"), *([F.col(id_).alias("i")] if id_ else []))
    if id_ is None:
        return rows
    own = F.when(F.col("i").isNull(), F.monotonically_increasing_id())
    return rows.withColumn("own", own).select("i", "own", "g", "c").distinct().select("g", "c")


def bisect(rows: DataFrame, fractions: list[float], bits: int | None = None) -> DataFrame:
    """(g, fraction, n, code, value): the percentile of each group of `usable` rows.

    With `bits` an interval is left once it is narrower than 2**-bits of its values; its middle is given, so that the
    relative error is at most 2**-(bits + 1). Without, values are exact.
    """
    rows = cut(rows)
    target = F.array(*[F.struct(F.lit(float(q)).alias("fraction"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n"))).alias("k")) for q in fractions])
    state = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    state = cut(state.withColumn("t", F.explode(target)).select("g", "n", "lo", "hi", "t.fraction", "t.k"))
    width = F.lit(1) if bits is None else F.greatest(F.lit(1), F.shiftleft(F.lit(1).cast("bigint"), 52 - bits))
    done = []
    while True:
        ready = F.col("hi") - F.col("lo") < width
        done.append(state.filter(ready))
        state = state.filter(~ready)
        if not state.take(1):
            break
        step = (F.shiftright(F.col("hi") - F.col("lo"), DEPTH) + 1).alias("step")
        spans = state.select("g", "lo", "hi", step).distinct()
        inside = (F.col("c") >= F.col("lo")) & (F.col("c") <= F.col("hi"))
        near = attach(rows, spans, ["g"], ["c"]).filter(inside)
        # integer part of (c - lo) / step without a detour through double
        part = F.expr("(c - lo) div step")
        counts = near.groupBy("g", "lo", part.alias("part")).agg(F.count("*").alias("m"), F.min("c").alias("lo2"), F.max("c").alias("hi2"))
        w = Window.partitionBy("g", "lo").orderBy("part")
        counts = counts.withColumn("upto", F.sum("m").over(w))
        state = (
            state.join(counts, ["g", "lo"])
            .filter((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("m")))
            .select("g", "n", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "fraction", (F.col("k") - F.col("upto") + F.col("m")).alias("k"))
        )
        state = cut(state)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    mid = F.col("lo") + F.shiftright(F.col("hi") - F.col("lo"), 1)
    return out.select("g", "fraction", "n", mid.alias("code"), value_of(mid).alias("value"))


def cells(rows: DataFrame, bits: int = 7) -> DataFrame:
    """(g, cell, n): the mergeable form of `usable` rows; 2**bits cells between a number and its double."""
    return rows.groupBy("g", F.shiftright("c", 52 - bits).alias("cell")).agg(F.count("*").alias("n"))


def merge_cells(*loads: DataFrame) -> DataFrame:
    """The cells of all loads together. Rows must not be in two loads."""
    out = loads[0]
    for x in loads[1:]:
        out = out.unionByName(x)
    return out.groupBy("g", "cell").agg(F.sum("n").alias("n"))


def percentiles_of_cells(merged: DataFrame, fractions: list[float], bits: int = 7) -> DataFrame:
    """(g, fraction, n, value) with a relative error of at most 2**-(bits + 1) for values from 2**-1022 on."""
    w = Window.partitionBy("g")
    c = merged.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    q = F.explode(F.array(*[F.lit(float(x)) for x in fractions]))
    k = F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("all")))
    low = F.shiftleft(F.col("cell"), 52 - bits)
    high = F.shiftleft(F.col("cell") + 1, 52 - bits)
    mid = F.when(F.col("cell") == 0, 0.0).otherwise((value_of(low) + value_of(high)) / 2)
    return c.withColumn("fraction", q).filter((k <= F.col("upto")) & (k > F.col("upto") - F.col("n"))).select("g", "fraction", F.col("all").alias("n"), mid.alias("value"))
