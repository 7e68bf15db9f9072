"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexlake.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); the root is the smallest node of its component.

    Each round gives a node the smallest label among its neighbours', then that label's own label, so that long
    chains close fast. Links of a node to itself and repeated links are harmless; no links give an empty table.
    """
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))
    both = cut(links.select(F.explode(ends).alias("e")).select("e.node", "e.to").distinct())
    label = both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("root"))
    label = cut(label)
    while True:
        near = both.join(label.select(F.col("node").alias("to"), F.col("root").alias("r")), "to").groupBy("node").agg(F.min("r").alias("r"))
        new = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = cut(new.join(jump, "root").select("node", "old", F.least("root", "up").alias("root")))
        label = new.select("node", "root")
        if not new.filter("old != root").take(1):
            return label
