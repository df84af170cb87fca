"""Modules: dependencies, cycles, layers, counts and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..runtime import cut


def dependencies(symbols: DataFrame, *edge_tables: DataFrame) -> DataFrame:
    """Distinct (src_module, dst_module) pairs of edges between modules; an empty name counts, null does not."""
    a, b = symbols.select(F.col("usr").alias("src"), F.col("module").alias("src_module")), symbols.select(F.col("usr").alias("dst"), F.col("module").alias("dst_module"))
    out = None
    for edges in edge_tables:
        pairs = edges.select("src", "dst").join(a, "src").join(b, "dst").where("src_module <> dst_module").select("src_module", "dst_module").distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def in_cycles(deps: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(module): modules that reach themselves, by squaring the reachability relation until it stands still.

    The module graph is small beside the symbol graph, but no part of it is collected.
    """
    reach, size = cut(deps.select(F.col("src_module").alias("a"), F.col("dst_module").alias("b")).distinct()), -1
    for _ in range(max_rounds):
        n = reach.count()
        if n == size:
            break
        size, step = n, reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        reach = cut(reach.join(step, "b").select("a", F.col("c").alias("b")).unionByName(reach).distinct())
    return reach.where("a = b").select(F.col("a").alias("module"))


def violations(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls between layers that should not: pattern, modules, and both ends."""
    cols = lambda side, p: symbols.select(F.col("usr").alias(side), F.col("name").alias(f"{p}_name"), F.col("module").alias(f"{p}_module"))
    both = calls.select("src", "dst").join(cols("src", "caller"), "src").join(cols("dst", "callee"), "dst").where("caller_module is not null and callee_module is not null")
    return both.withColumn("pattern", L.layer_violation(F.col("caller_module"), F.col("callee_module"))).where("pattern is not null").select(
        "pattern", "caller_module", "callee_module", F.col("src").alias("caller_usr"), "caller_name", F.col("dst").alias("callee_usr"), "callee_name"
    )


def kind_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("module", "kind").agg(F.count("*").alias("n"))


def audit_pivot(symbols: DataFrame, kinds: list[str]) -> DataFrame:
    """A row for each module: the count of each kind, and the total; null modules under ``(unknown)``."""
    counts = [F.sum((F.col("kind") == k).cast("long")).alias(k) for k in kinds]
    return symbols.groupBy(F.coalesce("module", F.lit("(unknown)")).alias("module")).agg(*[F.coalesce(c, F.lit(0)).alias(k) for c, k in zip(counts, kinds)], F.count("*").alias("total"))


def audit_gaps(expected: DataFrame, symbols: DataFrame, least: int = 100) -> DataFrame:
    """(module, n, status) for each expected module: MISSING, UNEXPECTED GAP below ``least``, else ok."""
    counts = symbols.groupBy("module").agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") < least, "UNEXPECTED GAP").otherwise("ok")
    return expected.join(counts, "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, n): symbols, and the edges of each type."""
    return symbols.agg(F.count("*").alias("n")).select(F.lit("Symbol").alias("entity"), "n").unionByName(edges.groupBy(F.col("rel_type").alias("entity")).agg(F.count("*").alias("n")))
