"""Clusters of mutually similar vectors, each with its size and most typical members.

Markov clustering: on the similarity graph a column-stochastic matrix is squared, inflated (entries squared, columns
scaled to sum 1 again) and pruned of small entries, in turn, until it no longer changes; the rows that keep flow are
attractors, the columns that flow to one form a cluster, and the members that receive most flow represent it. The matrix
is a table of columns (column j, its entries (row i, value v)); squaring is a join on the inner index.

Vectors in one small box of the space (its diagonal at most the reach) are mutually similar and form one node of
the graph, and where a block holds very many boxes, those in a ball of half the reach around one of them become one node too,
so crowds of near copies become few nodes and are never paired. Nodes are linked if some vector of one is
within reach of some vector of the other: a pair of nodes whose bounding boxes are near is tested on two members of each
first, and on all members near the other box where that leaves it open.

A cluster is a largest set connected through similar vectors; Markov clustering may divide such a set, so a repair step
then joins clusters that a link connects (`repair=False` leaves it out and gives what the flow alone finds).

Cases: keys must not be null; vectors must be finite and of one length (see `diverse.latest_vectors`); copies of a vector
are members of one cluster; a vector without similar ones is in no cluster; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.llm.components import components
from vertexlake.llm.grid import cells_near, dist2, gap2, widest
from vertexlake.session import attach, cut

#: Axes on which nodes are blocked, and the side of a block in reaches.
AXES, BLOCK = 4, 4.0
#: Nodes of a block from which on balls are formed in it, and the share of them that a ball must take for another round.
HOT, WORTH = 2_000, 0.05
#: Share of its column below which an entry is small. A column so has at most 1 / SMALL entries.
SMALL = 1e-3
#: Rounds after which inflation grows, so that flow that swings comes to rest too.
PATIENCE = 8
#: Parts over which the candidates of a block are spread.
SALTS = 8


def nodes_of(vectors: DataFrame, dims: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """Members (space, key, node, v) and nodes (space, node, n, p, q, lo, hi): node is a number, p and q two of its vectors; of a single vector only p is given."""
    side = reach / math.sqrt(dims) * 0.999
    x = vectors.withColumn("box", F.transform("v", lambda e: F.floor(e / side)))
    ends = [F.array(*[f(F.col("v")[k]) for k in range(dims)]).alias(n) for n, f in (("lo", F.min), ("hi", F.max))]
    nodes = x.groupBy("space", "box").agg(F.count("*").alias("n"), F.min("v").alias("p"), F.max("v").alias("q"), *ends)
    one = F.col("p") == F.col("q")
    nodes = nodes.withColumns({c: F.when(~one, F.col(c)) for c in ("q", "lo", "hi")})
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = x.join(nodes.select("space", "box", "node"), ["space", "box"]).select("space", "key", "node", "v")
    return _balls(members, nodes.drop("box"), dims, reach)


def _box(side: str = "") -> tuple[Column, Column]:
    p = F.col(f"p{side}")
    return F.coalesce(f"lo{side}", p), F.coalesce(f"hi{side}", p)


def _balls(members: DataFrame, nodes: DataFrame, dims: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """In blocks of more than HOT nodes, those that lie within half the reach of the node nearest the block's mean become one with it, round by round."""
    axes = widest(nodes, "p", dims, AXES)
    on = ["space", *[f"b{k}" for k in axes]]
    moved = None
    while True:
        x = nodes.select("*", *[F.floor(F.col("p")[k] / (BLOCK * reach)).alias(f"b{k}") for k in axes])
        mean = F.array(*[F.avg(F.col("p")[k]) for k in range(dims)]).alias("mean")
        hot = cut(x.groupBy(*on).agg(F.count("*").alias("here"), mean).filter(F.col("here") > HOT))
        here = hot.agg(F.sum("here")).first()[0]
        if not here:
            break
        hub = attach(x, hot, on, ["node"]).groupBy(*on).agg(F.min_by(F.struct("node", "p"), F.struct(dist2(F.col("p"), F.col("mean"), dims), F.col("node"))).alias("hub"))
        lo, hi = _box()
        far = F.lit(0.0)
        for k in range(dims):
            f = F.greatest(F.abs(F.col("hub.p")[k] - lo[k]), F.abs(hi[k] - F.col("hub.p")[k]))
            far = far + f * f
        inside = F.sqrt(far) <= reach / 2 * (1 - 1e-12)
        to = cut(attach(x, cut(hub), on, ["node"]).filter(inside & (F.col("node") != F.col("hub.node"))).select("node", F.col("hub.node").alias("to")))
        taken = to.count()
        if taken < WORTH * here:
            break
        x = nodes.join(to, "node", "left").withColumns({"node": F.coalesce("to", "node"), "lo": lo, "hi": hi, "q": F.coalesce("q", "p")})
        ends = [F.array(*[f(F.col(n)[k]) for k in range(dims)]).alias(n) for n, f in (("lo", F.min), ("hi", F.max))]
        nodes = cut(x.groupBy("space", "node").agg(F.sum("n").alias("n"), F.min("p").alias("p"), F.max("q").alias("q"), *ends))
        moved = to if moved is None else moved.join(to.withColumnsRenamed({"node": "to", "to": "next"}), "to", "left").select("node", F.coalesce("next", "to").alias("to")).unionByName(to)
        moved = cut(moved)
    if moved is not None:
        members = attach(members, moved, ["node"], ["key"], how="left").withColumn("node", F.coalesce("to", "node")).select("space", "key", "node", "v")
    return members, nodes


def node_pairs(nodes: DataFrame, dims: int, reach: float) -> DataFrame:
    """(a, b, d2, n_a, n_b, boxes, linked): pairs of nodes whose boxes are within reach; linked is null where members must be asked.

    A node is entered in every block its box comes near; a pair that shares several blocks is looked at in the first of them. A block of many nodes
    is spread over tasks: its nodes of one side by a salt, those of the other side in all of them.
    """
    wide = widest(nodes, "p", dims, dims)
    axes = wide[:AXES]
    side, half = BLOCK * reach, reach / 2 * (1 + 1e-9)
    lo, hi = _box()
    x = nodes.withColumns({f"f{k}": F.floor((lo[k] - half) / side) for k in axes})
    for k, cells in zip(axes, cells_near(lo, hi, axes, half, side)):
        x = x.withColumn(f"b{k}", F.explode(cells))
    on = ["space", *[f"b{k}" for k in axes]]
    cols = ["node", "n", "p", "q", "lo", "hi", *[f"f{k}" for k in axes]]
    full = cut(x.groupBy(*on).agg(F.count("*").alias("here")).filter(F.col("here") > HOT))
    left = x.select(*on, *[F.col(c).alias(f"{c}_a") for c in cols])
    right = x.select(*on, *[F.col(c).alias(f"{c}_b") for c in cols])
    if full.take(1):
        left, right = (attach(y, full, on, [n], how="left").withColumn("crowd", F.col("here").isNotNull()).drop("here") for y, n in ((left, "node_a"), (right, "node_b")))
        left = left.withColumn("salt", F.when(F.col("crowd"), F.pmod(F.xxhash64("node_a"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("crowd")
        right = right.withColumn("salt", F.explode(F.when(F.col("crowd"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("crowd")
        on = [*on, "salt"]
    r2 = reach * reach
    c = F.col
    first = F.lit(True)
    for k in axes:
        first = first & (c(f"b{k}") == F.greatest(c(f"f{k}_a"), c(f"f{k}_b")))
    (alo, ahi), (blo, bhi) = _box("_a"), _box("_b")
    near = F.lit(True)  # axis by axis, those the block does not bound first: most candidates fail there
    for k in [*wide[AXES:], *axes]:
        near = near & (blo[k] - ahi[k] <= reach) & (alo[k] - bhi[k] <= reach)
    pairs = left.join(right, on).filter((c("node_a") < c("node_b")) & near & first & (gap2(alo, ahi, blo, bhi, dims) <= r2 * (1 + 1e-12)))
    both = [[c(f"p{m}"), F.coalesce(f"q{m}", f"p{m}")] for m in ("_a", "_b")]
    d2 = F.least(*[dist2(m, n, dims) for m in both[0] for n in both[1]])
    pairs = pairs.select(c("node_a").alias("a"), c("node_b").alias("b"), c("n_a"), c("n_b"), alo.alias("lo_a"), ahi.alias("hi_a"), blo.alias("lo_b"), bhi.alias("hi_b"), c("q_a").isNull().alias("one_a"), c("q_b").isNull().alias("one_b"), d2.alias("d2"))
    near = F.sqrt("d2") <= reach
    open_ = F.when(~(c("one_a") & c("one_b")), F.struct("lo_a", "hi_a", "lo_b", "hi_b"))
    pairs = pairs.filter(near | open_.isNotNull()).withColumn("linked", F.when(near, True))
    return pairs.withColumn("boxes", F.when(~near, open_)).select("a", "b", "d2", "n_a", "n_b", "boxes", "linked")


def ask_members(open_: DataFrame, members: DataFrame, dims: int, reach: float) -> DataFrame:
    """Of the open pairs those (a, b, d2, n_a, n_b) that hold two vectors within reach; only members near the other's box are asked, copies once."""
    m = members.select("node", "v").distinct()

    def near(own: str, other: str) -> Column:
        return gap2(F.col(f"v_{own}"), F.col(f"v_{own}"), F.col(f"boxes.lo_{other}"), F.col(f"boxes.hi_{other}"), dims) <= reach * reach * (1 + 1e-12)

    x = attach(m.withColumnsRenamed({"node": "a", "v": "v_a"}), open_, ["a"], ["v_a"]).filter(near("a", "b"))
    x = attach(m.withColumnsRenamed({"node": "b", "v": "v_b"}), x, ["b"], ["v_b"]).filter(near("b", "a"))
    d2 = dist2(F.col("v_a"), F.col("v_b"), dims)
    return x.filter(F.sqrt(d2) <= reach).groupBy("a", "b").agg(F.min(d2).alias("d2"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def _columns(entries: DataFrame, power: float) -> DataFrame:
    """(j, col, s) of entries (i, j, v), which add up where repeated, each sum inflated by `power`.

    `col` are the column's entries without the small ones (where all are small the largest stays), `s` their sum, by which readers divide.
    """
    x = entries.groupBy("j", "i").agg(F.pow(F.sum("v"), F.lit(power)).alias("v"))
    x = x.groupBy("j").agg(F.collect_list(F.struct("i", "v")).alias("col"), F.sum("v").alias("whole"), F.max(F.struct("v", (-F.col("i")).alias("i"))).alias("most"))
    kept = F.filter("col", lambda e: (e["v"] >= SMALL * F.col("whole")) | ((e["v"] == F.col("most.v")) & (e["i"] == -F.col("most.i"))))
    return x.select("j", kept.alias("col"), F.aggregate(kept, F.lit(0.0), lambda s, e: s + e["v"]).alias("s"))


def flow(links: DataFrame, reach: float) -> DataFrame:
    """(i, j, v): the matrix of links (a, b, d2, n_a, n_b) when it no longer changes, i.e. every column's flow is in equal parts."""
    w = F.exp(-F.col("d2") / (reach * reach))
    entry = lambda i, j, v: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), v.cast("double").alias("v"))
    each = links.select(F.explode(F.array(entry("a", "b", w * F.col("n_a")), entry("b", "a", w * F.col("n_b")))).alias("e")).select("e.*")
    ends = links.select(F.explode(F.array(entry("a", "a", F.col("n_a")), entry("b", "b", F.col("n_b")))).alias("e")).select("e.*").distinct()
    m = cut(_columns(each.unionByName(ends), 1.0))
    rounds = 0
    while True:
        power = 2.0 + max(0, rounds - PATIENCE) // 2
        left = m.select("j", "s", F.explode("col").alias("e")).select("j", F.col("e.i").alias("k"), (F.col("e.v") / F.col("s")).alias("u"))
        square = left.join(m.select(F.col("j").alias("k"), "col", "s"), "k").select("j", (F.col("u") / F.col("s")).alias("u"), F.explode("col").alias("e"))
        m = cut(_columns(square.select(F.col("e.i").alias("i"), "j", (F.col("u") * F.col("e.v")).alias("v")).repartition("j"), power))
        rounds += 1
        # What a column's largest entry has above the sum of the squares: 0 where all entries are equal.
        chaos = F.aggregate("col", F.lit(0.0), lambda t, e: F.greatest(t, e["v"])) / F.col("s") - F.aggregate("col", F.lit(0.0), lambda t, e: t + e["v"] * e["v"]) / (F.col("s") * F.col("s"))
        if not m.filter(chaos > 1e-3).take(1):
            return m.select("j", "s", F.explode("col").alias("e")).select("e.i", "j", (F.col("e.v") / F.col("s")).alias("v"))


def cluster(vectors: DataFrame, dims: int, reach: float, repair: bool = True) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Members (space, cluster_key, member_key, size) of each cluster of two or more, and a function that gives typical members.

    Typical: (space, cluster_key, size, place, member_key, flow), three of each cluster, those in nodes of most received flow first and among
    them those nearest the middle of their node; flow is the number of members whose flow ends in the node. vectors: (space, key, v).
    """
    members, nodes = nodes_of(cut(vectors), dims, reach)
    pairs = cut(node_pairs(nodes, dims, reach))
    links = pairs.filter("linked").select("a", "b", "d2", "n_a", "n_b")
    open_ = pairs.filter("linked is null").select("a", "b", "n_a", "n_b", "boxes")
    if open_.take(1):
        links = cut(links.unionByName(ask_members(open_, members, dims, reach)))
    m = flow(links, reach)
    home = cut(m.groupBy("j").agg(F.max_by("i", F.struct(F.col("v"), -F.col("i"))).alias("at")).withColumnRenamed("j", "node"))
    bonds = home.select(F.col("node").alias("a"), F.col("at").alias("b"))
    if repair:  # the links that leave a cluster
        x = links.select("a", "b")
        for side in "ab":
            x = x.join(home.select(F.col("node").alias(side), F.col("at").alias(f"at_{side}")), side)
        bonds = bonds.unionByName(x.filter("at_a <> at_b").select(F.col("at_a").alias("a"), F.col("at_b").alias("b")).distinct())
    root = components(bonds)
    full = attach(members, root, ["node"], ["key"], how="left").withColumn("root", F.coalesce("root", "node"))
    size = full.groupBy("root").agg(F.count("*").alias("size"), F.min("key").alias("cluster_key")).filter("size > 1")
    out = attach(full, size, ["root"], ["key"])

    def typical() -> DataFrame:
        got = m.join(nodes.select(F.col("node").alias("j"), "n"), "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("v") * F.col("n")).alias("got"))
        alone = nodes.join(home, "node", "left_anti").select("node", F.col("n").cast("double").alias("got"))
        middle = members.groupBy("node").agg(F.array(*[F.avg(F.col("v")[k]) for k in range(dims)]).alias("middle"))
        x = attach(out, got.unionByName(alone).join(middle, "node"), ["node"], ["key"])
        x = x.withColumn("flow", F.round("got", 6)).withColumn("off", F.round(dist2(F.col("v"), F.col("middle"), dims), 12))
        place = F.row_number().over(Window.partitionBy("space", "cluster_key").orderBy(F.col("flow").desc(), "off", "key"))
        return x.withColumn("place", place).filter("place <= 3").select("space", "cluster_key", "size", "place", F.col("key").alias("member_key"), "flow")

    return out.select("space", "cluster_key", F.col("key").alias("member_key"), "size"), typical
