"""Connected components and greedy stars over edge tables, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of its component for each node that has an edge.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round is two shuffles over at most the
    edges, hubs are only aggregated, never collected, and the number of rounds grows with the logarithm of the component
    diameter. Each round is written to the shared folder, so a lost executor costs one round. Self loops and null ends
    are dropped; an empty table gives an empty table.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour points to the smallest node around
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        e = materialize(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def greedy_stars(nodes: DataFrame, edges: DataFrame, order: list[str], *, max_rounds: int = 60) -> DataFrame:
    """(node, parent): what going through the nodes in `order` gives, each free node taking all its free neighbours.

    nodes: node and the columns of the order (unique together). A node that comes before all its open neighbours is a parent,
    its neighbours are not; a round decides all such nodes at once, which yields the same parents as the sequential pass.
    At the end every other node goes to its first parent. A node without edges is its own parent.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    rank = nodes.select("node", F.struct(*order).alias("o"))
    links = materialize(both.join(rank.withColumnRenamed("node", "b").withColumnRenamed("o", "ob"), "b"), "stars")
    live, parents = rank, None
    for _ in range(max_rounds):
        near = links.join(live.select(F.col("node").alias("b")), "b", "left_semi").join(live.select(F.col("node").alias("a")), "a", "left_semi")
        first = near.groupBy("a").agg(F.min("ob").alias("first"))
        heads = materialize(live.join(first.withColumnRenamed("a", "node"), "node", "left").filter("first is null or o < first").select("node", "o"), "heads")
        parents = heads if parents is None else parents.unionByName(heads)
        taken = links.join(heads.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).unionByName(heads.select("node")).distinct()
        live = materialize(live.join(taken, "node", "left_anti"), "live")
        if live.isEmpty():
            break
    else:
        raise RuntimeError(f"stars did not settle in {max_rounds} rounds")
    mine = links.join(parents.select(F.col("node").alias("b")), "b", "left_semi").groupBy("a").agg(F.min_by("b", "ob").alias("parent"))
    kids = mine.withColumnRenamed("a", "node").join(parents.select("node"), "node", "left_anti")
    return kids.select("node", "parent").unionByName(parents.select("node", F.col("node").alias("parent")))
