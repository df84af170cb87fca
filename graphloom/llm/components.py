"""Connected components of an edge table by alternating large-star and small-star contraction.

Only DataFrame operators are used. Every round ends in a checkpoint, so lineage stays short and a
lost executor never forces earlier rounds to run again. Edges and labels never reach the driver;
it sees one count and one checksum a round. A round costs two groupings (pre-aggregated before the
shuffle) and two equi-joins, which adaptive execution splits where a hub holds many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of (a, b) edges with a > b; all new edges point to a smaller node."""
    if large:  # every larger neighbour of a node moves to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # every smaller neighbour of a node, and the node, move to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = (
            edges.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        )
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    ``src`` and ``dst`` are longs. Self loops, repeated and reversed edges are allowed; edges with a
    null end are ignored. An empty table gives an empty table. Raises if ``max_rounds`` do not suffice
    (the contraction needs about log2 of the longest path).
    """
    spark = edges.sparkSession
    cur = cut(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
        .select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .distinct()
    )
    nodes = cut(cur.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    cur, seen = cur.where("a <> b"), None
    for _ in range(max_rounds):
        nxt = cut(_star(_star(cur, True), False))
        mark = tuple(nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        cur = nxt
        if mark == seen:
            break
        seen = mark
        release(spark)
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return nodes.join(cur.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))
