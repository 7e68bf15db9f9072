"""A sample that covers the space of the data: equal boxes, filled in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.functions import keyed, ranks


def box_of(features: Column, lows: list[float], side: float) -> Column:
    """The box of a vector: each coordinate's place in steps of `side` from its least value."""
    return F.zip_with(features, F.array(*map(F.lit, lows)), lambda x, lo: F.floor((x - lo) / side))


#: Sides whose boxes are counted in one pass.
TRIES = 8


def find_side(samples: DataFrame, lows: list[float], highs: list[float], boxes: int, alpha: float = 0.1, max_iter: int = 30) -> float:
    """A side for which the occupied boxes number within (1 +- alpha) of `boxes`; the nearest found otherwise.

    Each pass counts the boxes of TRIES sides between two bounds at once, in sketches of fixed size (2 % off as a rule), and goes on between
    the two sides that have `boxes` between them.
    """
    lo, hi = 0.0, max(1e-12, *(h - x for h, x in zip(highs, lows))) if lows else 1.0
    best, miss = hi, float("inf")
    for _ in range(max(1, max_iter // 3)):
        sides = [lo + (hi - lo) * (i + 1) / (TRIES + 1) for i in range(TRIES)]
        got = samples.agg(*[F.approx_count_distinct(F.xxhash64(box_of(F.col("features"), lows, s)), 0.02) for s in sides]).first()
        for s, n in zip(sides, got):
            if abs(n - boxes) < miss:
                best, miss = s, abs(n - boxes)
        if miss <= alpha * boxes:
            break
        lo, hi = max([lo, *(s for s, n in zip(sides, got) if n > boxes)]), min([hi, *(s for s, n in zip(sides, got) if n <= boxes)])
        if hi <= lo:
            break
    return best


def sketch(samples: DataFrame, n: int, boxes: int | None = None, alpha: float = 0.1, seed: int = 4563) -> DataFrame:
    """n samples, drawn from all boxes in turn: first one of each box, then a second one, and so on; ties by key.

    Boxes of many samples are ranked by key without gathering them. Fewer samples than n are all returned.
    """
    from vertexlake.operators.fit import whole_rows

    good, total, dims = whole_rows(samples)
    if total <= n:
        return good
    ends = good.agg(*[F.min(F.col("features")[i]).alias(f"a{i}") for i in range(dims)], *[F.max(F.col("features")[i]).alias(f"b{i}") for i in range(dims)]).first()
    lows, highs = [ends[f"a{i}"] for i in range(dims)], [ends[f"b{i}"] for i in range(dims)]
    return draw(good, n, find_side(good, lows, highs, boxes or n, alpha), seed, lows).select("sample_id", "features")


def draw(good: DataFrame, n: int, side: float, seed: int = 4563, lows: list[float] | None = None) -> DataFrame:
    """(sample_id, features, turn): the n samples drawn from boxes of a given side; `lows` are the least coordinates, found if not given."""
    if lows is None:
        dims = good.agg(F.max(F.size("features"))).first()[0] or 0
        lows = list(good.agg(F.count("*"), *[F.min(F.col("features")[i]) for i in range(dims)]).first())[1:]
    x = good.withColumn("box", box_of(F.col("features"), lows, side)).withColumn("key_", keyed.uniform(seed, "sketch", F.col("sample_id")))
    # Within a box only the first n can be chosen; the window stops there.
    turn = F.row_number().over(Window.partitionBy("box").orderBy("key_", "sample_id"))
    x = x.withColumn("turn", turn).filter(F.col("turn") <= n)
    x = ranks.numbered(x, [F.col("turn"), F.col("key_"), F.col("sample_id")], out="place")
    return x.filter(F.col("place") <= n).select("sample_id", "features", "turn")
