"""A mixture of several sources in which each has its target share of all tokens.

The mixture is a row of slots, a power of two of them. The van der Corput sequence gives slot i a point (its bits in
reverse order behind the binary point); the point's place among the sources' cumulative shares gives the slot to a source,
so any stretch of the mixture is close to the target. The slots of a source are ranked; together they have exactly its
share of the tokens, each the same number (give or take one). A source's messages, in an order shuffled by hash, are one row of tokens,
begun again after its end at most `max_repeats` times; the r-th slot takes its r-th stretch. A stretch may begin or end
inside a message, as blocks of equal length do, so no stretch is empty before the source is used up. Slots (or parts of
them) beyond that stay empty: by them the report tells which sources fall short. The others have exactly their share of
the planned total, so among each other they keep their proportions.

`mix` is the form that keeps messages whole: the r-th slot takes the r-th block, and a message belongs to the block in which it begins.
There shares are off by what blocks differ in size, and a block that a long message covers is empty.

Prefix sums are taken in two steps (sums of hash ranges or slot ranges, then within a range), so neither a source that
holds a third of all rows nor its slots are gathered in one task.

Cases: a null text has no tokens (its message has a place like any other); messages whose source is null or has no
target take no part; a target without messages is reported with 0 tokens; targets with a null source, a null or
non-positive share are reported with no slots; a source named twice in the targets counts with the sum of its shares
and the largest number of repeats; an empty collection gives a report of zeros; a share too small for a slot of its own among 2**22 falls
short if it is more than no token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.llm.bpe import VOCABULARY, count_tokens
from vertexlake.session import broadcast_if_small, cut

#: Tokens in a slot, at most, and the least and the largest number of slots that small shares may ask for.
BLOCK, LEAST_SLOTS, MOST_SLOTS = 2_048, 1 << 12, 1 << 22
#: Slots that the smallest share has, if MOST_SLOTS allows.
SLOTS_OF_A_SHARE = 16
#: Slots, or messages of a source, that one window works on.
RANGE = 65_536
#: Bits of a slot's number that are reversed: 2**40 slots of 2048 tokens.
BITS = 40
#: Cells of the unit interval on which slots and shares are joined.
CELLS = 4_096


def point(i: Column) -> Column:
    """The van der Corput point of slot i, below 1."""
    return F.conv(F.reverse(F.lpad(F.bin(i), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)


def _targets(targets: DataFrame) -> DataFrame:
    """(source, share, repeats, a, z): one row for each source, with its stretch a..z of the unit interval."""
    t = targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    t = t.withColumn("weight", F.when(F.col("source").isNotNull() & (F.col("share") > 0), F.col("share")).otherwise(0.0))
    upto = F.sum("weight").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))  # a table of settings, a few rows
    total = F.sum("weight").over(Window.partitionBy())
    t = t.withColumn("z", F.try_divide(upto, total)).withColumn("a", F.try_divide(upto - F.col("weight"), total))
    return t.select("source", "share", F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("z", F.lit(0.0)).alias("z"))


def slots(targets: DataFrame, n: int) -> DataFrame:
    """(slot, source, rank): the source of each of `n` slots, and the slot's rank among those of its source, from 0."""
    spark = targets.sparkSession
    s = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    t = targets.filter("z > a").withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") * CELLS), F.least(F.floor(F.col("z") * CELLS), F.lit(CELLS - 1)))))
    s = s.join(t.select("source", "a", "z", "cell"), "cell").filter("u >= a and u < z").select("slot", "source", F.expr(f"slot div {RANGE}").alias("range"))
    before = s.groupBy("source", "range").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("source").orderBy("range")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("source", "range").orderBy("slot")) - 1
    return s.withColumn("own", own).join(before, ["source", "range"]).select("slot", "source", (F.col("own") + F.col("before")).alias("rank"))


def placed(messages: DataFrame, n_messages: int, seed: int) -> DataFrame:
    """`messages` with `at`, the token of the source's shuffled row at which they begin."""
    n_ranges = max(1, -(-n_messages // RANGE))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)
    m = messages.withColumn("h", h).withColumn("range", F.expr(f"h div {(1 << 63) // n_ranges + 1}"))
    before = m.groupBy("source", "range").agg(F.sum("n_tokens").alias("here"))
    before = before.withColumn("before", F.sum("here").over(Window.partitionBy("source").orderBy("range")) - F.col("here")).drop("here")
    w = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("own", F.sum("n_tokens").over(w) - F.col("n_tokens")).join(before, ["source", "range"])
    return m.withColumn("at", F.col("own") + F.col("before")).drop("own", "before", "range", "h")


def number_of_slots(total: int, least_share: float, block: int) -> int:
    """A power of two: slots of at most `block` tokens, more where the smallest share would have few."""
    few = min(MOST_SLOTS, max(LEAST_SLOTS, SLOTS_OF_A_SHARE / least_share if least_share > 0 else 0))
    n = 1
    while n < min(few, total) or n * block < total:
        n *= 2
    return n if total else 0


def _product(a: Column, b: Column) -> Column:
    return a.cast("decimal(19,0)") * b.cast("decimal(18,0)")


def _whole(a: Column, b: Column) -> Column:
    """a / b without its fraction, of whole numbers of any size."""
    return F.call_function("div", a, b.cast("decimal(18,0)")).cast("bigint")


def _start(rank: Column) -> Column:
    """The token of the source's row at which its slot of this rank begins."""
    return _whole(_product(rank, F.col("wanted")), F.col("n_slots"))


def plan_mixture(documents: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages (doc_id, source, n_tokens, at, block, uses), schedule (slot, source, rank, wanted_tokens, n_tokens) and report.

    `at` is the message's first token in its source's row, `block` the rank of the slot in which it begins first, `uses` how
    often it begins in the mixture. The report has a row for each source of the targets: target_share, max_repeats, available_tokens, target_tokens,
    capacity_tokens, n_slots, empty_slots (wholly or in part), used_tokens, reached_share (of all tokens), actual_share (of the tokens used), short.
    `mixture` puts messages and schedule together.
    """
    t = cut(_targets(targets))
    wanted, _ = broadcast_if_small(t.filter(F.col("source").isNotNull()).select("source"))
    m = cut(count_tokens(documents.select("doc_id", "source", "text").join(wanted, "source", "left_semi"), keep=["doc_id", "source"]))
    stock = cut(m.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("messages")))
    total, n_messages = stock.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("messages"), F.lit(0))).first()
    least = t.filter("z > a").agg(F.min(F.col("z") - F.col("a"))).first()[0] or 0.0
    s = cut(slots(t, number_of_slots(total, least, block)))
    given = s.groupBy("source").agg(F.count("*").alias("n_slots"))
    wants = F.when(F.col("z") > F.col("a"), F.coalesce(F.col("share"), F.lit(0.0)) * float(total)).otherwise(0.0)
    plan = t.join(stock, "source", "left").join(given, "source", "left").na.fill(0, ["tokens", "messages", "n_slots"])
    plan = plan.withColumn("target_tokens", wants).withColumn("wanted", F.ceil("target_tokens")).withColumn("capacity", F.col("tokens") * F.col("repeats"))
    plan = cut(plan.withColumn("filled", F.when(F.col("n_slots") > 0, F.least("wanted", "capacity")).otherwise(F.lit(0))))
    small, _ = broadcast_if_small(plan.select("source", "tokens", "wanted", "filled", "n_slots"))

    begin, end = _start(F.col("rank")), _start(F.col("rank") + 1)
    kept = F.greatest(F.least(end, F.col("filled")) - begin, F.lit(0))
    schedule = s.join(small, "source").select("slot", "source", "rank", (end - begin).alias("wanted_tokens"), kept.alias("n_tokens"))

    uses = F.when(F.col("tokens") > 0, F.expr("(filled - at + tokens - 1) div tokens")).otherwise(F.lit(0))
    messages = placed(m, n_messages, seed).join(small, "source").withColumn("uses", F.greatest(uses, F.lit(0)))
    messages = messages.withColumn("block", _slot_of(F.col("at"))).select("doc_id", "source", "n_tokens", "at", "block", "uses")

    made = schedule.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.sum((F.col("n_tokens") < F.col("wanted_tokens")).cast("bigint")).alias("empty_slots"))
    report = plan.join(made, "source", "left").na.fill(0, ["used_tokens", "empty_slots"])
    share = F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy())), F.lit(0.0))
    report = report.select(
        "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.col("tokens").alias("available_tokens"), "target_tokens",
        F.col("capacity").alias("capacity_tokens"), "n_slots", "empty_slots", "used_tokens", (F.col("used_tokens") / float(max(total, 1))).alias("reached_share"), share.alias("actual_share"),
        ((F.col("empty_slots") > 0) | (F.col("n_slots") == 0) & (F.col("target_tokens") > 1)).alias("short"),
    )
    return messages, schedule, report


def _slot_of(token: Column) -> Column:
    """The rank of the slot that holds a token of the source's row (null without slots)."""
    return _whole(_product(token + 1, F.col("n_slots")) - 1, F.nullif(F.col("wanted"), F.lit(0)))


def mixture(messages: DataFrame, schedule: DataFrame, report: DataFrame) -> DataFrame:
    """(slot, source, doc_id, repeat, start, n_tokens): what each slot holds, in pieces of messages, from token `start` of the message on.

    Pieces are computed from the messages' places; only their slots' numbers are joined, on (source, rank).
    """
    keys = report.select("source", F.col("available_tokens").alias("tokens"), F.ceil("target_tokens").alias("wanted"), "n_slots", F.col("used_tokens").alias("filled"))
    keys, _ = broadcast_if_small(keys.filter("n_slots > 0 and filled > 0"))
    x = messages.filter("n_tokens > 0 and uses > 0").select("doc_id", "source", "n_tokens", "at", "uses").join(keys, "source")
    x = x.withColumn("repeat", F.explode(F.sequence(F.lit(0), (F.col("uses") - 1).cast("int")))).withColumn("p0", F.col("repeat") * F.col("tokens") + F.col("at"))
    x = x.withColumn("p1", F.least(F.col("p0") + F.col("n_tokens"), F.col("filled")))
    x = x.withColumn("rank", F.explode(F.sequence(_slot_of(F.col("p0")), _slot_of(F.col("p1") - 1))))
    a, z = F.greatest("p0", _start(F.col("rank"))), F.least("p1", _start(F.col("rank") + 1))
    x = x.select("source", "doc_id", "repeat", "rank", (a - F.col("p0")).alias("start"), (z - a).alias("n_tokens")).filter("n_tokens > 0")
    return x.join(schedule.select("source", "rank", "slot"), ["source", "rank"]).select("slot", "source", "doc_id", "repeat", "start", "n_tokens")


# Messages kept whole: blocks are cut where messages begin, so they are of about equal tokens only.


def blocks(messages: DataFrame, n_messages: int, seed: int, block: int) -> DataFrame:
    """`messages` with h (their place in the shuffled order) and `block`, by the token at which they begin."""
    n_ranges = max(1, -(-n_messages // RANGE))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)
    m = messages.withColumn("h", h).withColumn("range", F.expr(f"h div {(1 << 63) // n_ranges + 1}"))
    before = m.groupBy("source", "range").agg(F.sum("n_tokens").alias("here"))
    before = before.withColumn("before", F.sum("here").over(Window.partitionBy("source").orderBy("range")) - F.col("here")).drop("here")
    w = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("own", F.sum("n_tokens").over(w) - F.col("n_tokens")).join(before, ["source", "range"])
    return m.withColumn("block", F.expr(f"(own + before) div {block}")).drop("own", "before", "range")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages (doc_id, source, n_tokens, block, uses), schedule (slot, source, block, repeat) and report.

    The report has a row for each source of the targets: target_share, max_repeats, available_tokens, target_tokens,
    capacity_tokens, n_slots, empty_slots, used_tokens, actual_share, short.
    """
    t = cut(_targets(targets))
    wanted, _ = broadcast_if_small(t.filter(F.col("source").isNotNull()).select("source"))
    m = cut(count_tokens(documents.select("doc_id", "source", "text").join(wanted, "source", "left_semi"), keep=["doc_id", "source"]))
    stock = cut(m.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("messages")))
    total, n_messages = stock.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("messages"), F.lit(0))).first()
    s = slots(t, -(-total // block))
    given = s.groupBy("source").agg(F.count("*").alias("n_slots"))
    plan = t.join(stock, "source", "left").join(given, "source", "left").na.fill(0, ["tokens", "messages", "n_slots"])
    plan = plan.withColumn("n_blocks", F.expr(f"(tokens + {block} - 1) div {block}")).withColumn("filled", F.least(F.col("n_slots"), F.col("n_blocks") * F.col("repeats")))
    plan = cut(plan)
    small, _ = broadcast_if_small(plan.select("source", "n_blocks", "filled", "repeats"))
    at = F.least(F.col("block"), F.col("n_blocks") - 1)
    uses = F.when(F.col("n_blocks") == 0, F.lit(0)).otherwise(F.expr("filled div n_blocks") + (at < F.pmod("filled", "n_blocks")).cast("bigint"))
    m = blocks(m, n_messages, seed, block).join(small, "source").withColumn("uses", uses)
    m = cut(m.select("doc_id", "source", "n_tokens", F.greatest(at, F.lit(0)).alias("block"), "uses"))
    schedule = s.join(small, "source").filter("rank < filled").select("slot", "source", F.expr("rank % n_blocks").alias("block"), F.expr("rank div n_blocks").alias("repeat"))
    used = m.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"))
    report = plan.join(used, "source", "left").na.fill(0, ["used_tokens"])
    share = F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy())), F.lit(0.0))
    wants = F.coalesce(F.col("share"), F.lit(0.0)) * float(total)
    report = report.select(
        "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), F.col("tokens").alias("available_tokens"),
        wants.alias("target_tokens"), (F.col("tokens") * F.col("repeats")).alias("capacity_tokens"), "n_slots", (F.col("n_slots") - F.col("filled")).alias("empty_slots"),
        "used_tokens", share.alias("actual_share"), (F.col("source").isNotNull() & (F.col("tokens") * F.col("repeats") < wants)).alias("short"),
    )
    return m, schedule, report
