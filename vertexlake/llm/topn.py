"""The first N items of each group by ascending score, equal scores by ascending name.

Per-group bisection: an item's place is a sequence of order-preserving integer codes - the score's, then seven bytes
of the name at a time. For every group that holds more than N items an interval of codes is kept; a pass counts the
items below the midpoints of all intervals (16 halvings at once), takes those that surely belong, drops those that
surely do not, and keeps the part that the cutoff falls in. Where an interval shrinks to one code, its items are tied
and the next code decides. Groups end when exactly N (or all) items are taken. No group is sorted or gathered.

Cases: rows with a null group, null name, or a score that is null, NaN or outside `low..high` do not count; a pair of
group and name counts once, with its smallest score; -0.0 equals 0.0; names are compared exactly, in code point order;
groups of fewer than N items are given whole; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.functions.doubles import code_of, value_of
from vertexlake.session import attach, cut

#: Halvings made in one pass.
DEPTH = 16
#: Bytes of the name in one code.
BYTES = 7


def name_code(name: Column, part: int) -> Column:
    """The part-th seven bytes of the UTF-8 name as a bigint; a name that ends sorts before one that goes on."""
    b = F.substring(F.encode(name, "UTF-8"), part * BYTES + 1, BYTES)
    return F.conv(F.rpad(F.hex(b), 2 * BYTES, "0"), 16, 10).cast("bigint") * 8 + F.length(b)


def top_n(df: DataFrame, group: str, name: str, score: str, n: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(g, y, s): group, name and smallest score of the first `n` names of each group. Scores must be at least 0."""
    s = F.col(score)
    ok = F.col(group).isNotNull() & F.col(name).isNotNull() & s.isNotNull() & ~F.isnan(s) & s.between(low, high)
    rows = df.filter(ok).select(F.col(group).alias("g"), F.col(name).alias("y"), code_of(s).alias("s"))
    rows = cut(rows.groupBy("g", "y").agg(F.min("s").alias("s")).withColumn("c", F.col("s")))
    state = rows.groupBy("g").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    state = cut(state.select("g", "m", "lo", "hi", F.lit(n).cast("bigint").alias("need")))
    taken, level = [], 0
    while True:
        # All items of a small group belong.
        whole = F.col("m") <= F.col("need")
        taken.append(attach(rows, state.filter(whole).select("g"), ["g"], ["y"]).select("g", "y", "s"))
        state = state.filter(~whole)
        if not state.take(1):
            break
        # Where every open group is tied, the next code takes over; groups that are not tied keep their score interval.
        tied = F.col("lo") == F.col("hi")
        if not state.filter(~tied).take(1):
            part = name_code(F.col("y"), level)
            level += 1
            rows = cut(attach(rows, state.select("g"), ["g"], ["y"]).withColumn("c", part))
            span = rows.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
            state = cut(state.drop("lo", "hi").join(span, "g"))
            continue
        step = F.shiftright(F.col("hi") - F.col("lo"), DEPTH) + 1
        spans = state.select("g", "lo", step.alias("step"))
        part = F.expr("(c - lo) div step")
        parted = attach(rows, spans, ["g"], ["y"]).withColumn("part", part).drop("lo", "step")
        counts = parted.groupBy("g", "part").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        upto = F.sum("k").over(Window.partitionBy("g").orderBy("part"))
        open_ = (
            counts.withColumn("upto", upto)
            .join(state.select("g", "need"), "g")
            .filter((F.col("need") <= F.col("upto")) & (F.col("need") > F.col("upto") - F.col("k")))
            .select("g", F.col("part").alias("edge"), F.col("k").alias("m"), "lo", "hi", (F.col("need") - F.col("upto") + F.col("k")).alias("need"))
        )
        open_ = cut(open_)
        both = attach(parted, open_.select("g", "edge"), ["g"], ["y"])
        taken.append(both.filter(F.col("part") < F.col("edge")).select("g", "y", "s"))
        rows = cut(both.filter(F.col("part") == F.col("edge")).select("g", "y", "s", "c"))
        state = open_.drop("edge")
    out = reduce(DataFrame.unionByName, taken)
    return out.select("g", "y", value_of(F.col("s")).alias("s"))
