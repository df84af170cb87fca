"""Breadth-first traversal from many seeds at once, closures and impact.

A level is one equi-join of the frontier with the edges, an aggregation that keeps the best way into each
node, and an anti-join with what was seen. Each level is checkpointed, so the plan of a level does not
hold the levels before it. The only thing the driver learns is whether a frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..runtime import cut

#: Relations that an impact walk follows backwards, in the order that decides ties (fixed values).
IMPACT_RELATIONS = ["Calls", "References", "Implements", "BridgesTo"]
SUBTYPE_RELATIONS = ["Inherits", "ConformsTo", "Extends", "Implements"]
BRIDGE_CONFIDENCE, IMPACT_DEPTH, CLOSURE_DEPTH = 0.70, 5, 20


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False, rank: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(seed, id, depth[, via]) for all nodes within ``max_depth`` hops of each seed, the seeds excluded.

    ``seeds`` has usr; depth is the least number of hops. With ``rank`` (a column of ``edges``) the lowest
    rank that reaches a node at its depth is returned as ``via``. ``seen`` (seed, id) is neither returned
    nor walked through.
    """
    start, end = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(start).alias("id"), F.col(end).alias("next"), F.col(rank).alias("via") if rank else F.lit(0).alias("via")).where("id <> next")
    frontier = seeds.select(F.col("usr").alias("seed"), F.col("usr").alias("id")).distinct()
    visited = frontier if seen is None else frontier.unionByName(seen.select("seed", "id"))
    visited, levels = cut(visited), []
    for depth in range(1, max_depth + 1):
        reached = frontier.join(steps, "id").groupBy("seed", "next").agg(F.min("via").alias("via")).select("seed", F.col("next").alias("id"), "via")
        level = cut(reached.join(visited, ["seed", "id"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(depth).cast("long")))
        frontier = level.select("seed", "id")
        visited = visited.unionByName(frontier)
    if not levels:
        levels = [frontier.limit(0).select("seed", "id", F.lit(None).cast(steps.schema["via"].dataType).alias("via"), F.lit(0).cast("long").alias("depth"))]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("seed", "id", "depth", *(["via"] if rank else []))


def subtype_closure(edges: DataFrame, seeds: DataFrame, max_depth: int = CLOSURE_DEPTH) -> DataFrame:
    """All subtypes of the seeds over (src, dst) edges of the subtype relations, walked backwards."""
    return bfs(edges, seeds, max_depth, reverse=True)


def impact(relations: DataFrame, subtypes: DataFrame, seeds: DataFrame, depth: int = IMPACT_DEPTH) -> DataFrame:
    """(seed, id, depth, reached_via): what a change of each seed touches.

    ``relations`` has src, dst, rel_type, confidence; ``subtypes`` src, dst. Subtypes of the seed come
    first, at depth 1, and are not walked through; then the relations are followed backwards, the first
    relation in order naming the way. Bridges count from a confidence of 0.70.
    """
    order = F.coalesce(*[F.when(F.col("rel_type") == r, i) for i, r in enumerate(IMPACT_RELATIONS)])
    walk = relations.where(F.col("rel_type").isin(*IMPACT_RELATIONS) & ((F.col("rel_type") != "BridgesTo") | (F.col("confidence") >= BRIDGE_CONFIDENCE))).withColumn("rank", order)
    below = subtype_closure(subtypes, seeds, min(depth, IMPACT_DEPTH)).select("seed", "id")
    reached = bfs(walk, seeds, min(depth, IMPACT_DEPTH), reverse=True, rank="rank", seen=below)
    name = F.element_at(F.array(*map(F.lit, IMPACT_RELATIONS)), F.col("via") + 1)
    return below.select("seed", "id", F.lit(1).cast("long").alias("depth"), F.lit("subtype_closure").alias("reached_via")).unionByName(reached.select("seed", "id", "depth", name.alias("reached_via")))


def impact_summary(found: DataFrame, symbols: DataFrame, seeds: DataFrame, fresh: bool = True) -> DataFrame:
    """One row a seed: risk, direct dependents, surface, the first clusters at depth 2 and likely tests."""
    s = symbols.select(F.col("usr").alias("id"), "name", "module", "kind")
    rows = found.join(s, "id", "left").withColumn("label", F.coalesce(*[F.nullif(c, F.lit("")) for c in ("module", "name", "kind")], F.lit("unknown")))
    facts = rows.groupBy("seed").agg(
        F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).cast("long").alias("direct_callers"),
        F.max(F.when((F.col("depth") == 1) & (F.col("reached_via") == "BridgesTo"), True).otherwise(False)).alias("has_bridge"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("depth") == 2, F.col("label")))), 1, 5).alias("d2_clusters"),
    )
    seed = seeds.select(F.col("usr").alias("seed")).distinct().join(symbols.select(F.col("usr").alias("seed"), "name", "module", "kind"), "seed", "left")
    both = seed.join(facts, "seed", "left").withColumns({"direct_callers": F.coalesce("direct_callers", F.lit(0).cast("long")), "has_bridge": F.coalesce("has_bridge", F.lit(False)), "d2_clusters": F.coalesce("d2_clusters", F.array().cast("array<string>"))})
    terms = F.concat_ws(" ", "name", "module", F.array_join("d2_clusters", " "))
    return both.select(
        "seed", L.risk_level(F.col("direct_callers"), F.col("has_bridge"), F.lit(fresh)).alias("risk"), "direct_callers",
        L.primary_surface(F.col("module"), F.coalesce("name", "seed"), F.col("kind")).alias("primary_surface"), "d2_clusters", L.likely_tests(terms).alias("likely_tests"),
    )


def hierarchy(symbols: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, role, usr, name, kind): direct parents and protocols of each seed, and its direct children."""
    s = symbols.select("usr", "name", "kind")
    seed = seeds.select(F.col("usr").alias("seed"))
    up = edges.join(seed, edges["src"] == seed["seed"]).select("seed", F.when(F.col("rel_type") == "ConformsTo", "protocol").otherwise("parent").alias("role"), F.col("dst").alias("usr"))
    down = edges.join(seed, edges["dst"] == seed["seed"]).select("seed", F.lit("child").alias("role"), F.col("src").alias("usr"))
    return up.unionByName(down).distinct().join(s, "usr").select("seed", "role", "usr", "name", "kind")
