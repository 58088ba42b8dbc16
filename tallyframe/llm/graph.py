"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tallyframe.sources.staging import staged

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.

    ``links`` has two columns of one orderable type without nulls.  Large and
    small stars take turns: every node is linked with its smallest neighbour,
    until each component is one star.  The number of rounds is logarithmic;
    each is written to the shared folder, and none holds more links than the
    first.  Neighbours of a hot node meet in a join that can split them.
    """
    a, b = links.columns
    edges = staged(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("to")).distinct(), "links",
    )
    state = None
    for _ in range(ROUNDS):
        both = edges.select("node", "to").union(edges.select(F.col("to"), F.col("node")))
        least = both.groupBy("node").agg(F.min("to").alias("least")).select(
            "node", F.least("node", "least").alias("least")
        )
        # Large star: larger neighbours move to the smallest one.
        large = (
            both.where("to > node").join(least, "node")
            .select(F.col("to").alias("node"), F.col("least").alias("to"))
        )
        # Small star: a node and its smaller neighbours move to the smallest of them.
        smallest = large.groupBy("node").agg(F.min("to").alias("least"))
        small = (
            large.join(smallest, "node").where("to != least")
            .select(F.col("to").alias("node"), F.col("least").alias("to"))
            .union(smallest.select("node", "least")).distinct()
        )
        seen = Observation()
        edges = staged(small.observe(
            seen, F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("node", "to").cast("decimal(38,0)")).alias("s"),
        ), "links")
        now = seen.get
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select("node", F.col("to").alias("component")).union(
        edges.select(F.col("to"), F.col("to")).distinct()
    )
