"""Execution flows and communities of the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import labels as L
from ..runtime import cut
from .traverse import bfs

#: Bounds of flow detection (fixed values).
MIN_CALLEES, MAX_CANDIDATES, MAX_FLOWS, MIN_STEPS, MAX_DEPTH, MIN_CONFIDENCE = 3, 200, 75, 3, 10, 0.5


def entry_points(symbols: DataFrame, calls: DataFrame, candidates: int = MAX_CANDIDATES, files: DataFrame | None = None) -> DataFrame:
    """(usr, name, callees, callers, score): likely starts of flows among the symbols of highest fan-out.

    ``files`` (file_path) restricts them to changed files. Ties of fan-out go to the smaller id.
    """
    outs = calls.groupBy(F.col("src").alias("usr")).agg(F.count("*").alias("callees")).where(F.col("callees") >= MIN_CALLEES)
    ins = calls.groupBy(F.col("dst").alias("usr")).agg(F.count("*").alias("callers"))
    s = symbols if files is None else symbols.join(files, "file_path", "left_semi")
    top = outs.join(s.select("usr", "name"), "usr").orderBy(F.desc("callees"), "usr").limit(candidates)
    both = top.join(ins, "usr", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return both.select("usr", "name", "callees", "callers", F.round(L.entry_score(F.col("name"), F.col("callees"), F.col("callers")), 6).alias("score"))


def flow_steps(symbols: DataFrame, calls: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH, flows: int = MAX_FLOWS) -> DataFrame:
    """(process_id, entry, usr, depth, step): what each of the best entries reaches, numbered by depth, then id.

    All entries walk at once, keyed by entry. Entries that reach fewer than three symbols make no flow.
    """
    sure = calls.where(F.col("confidence").isNull() | (F.col("confidence") >= MIN_CONFIDENCE))
    reached = bfs(sure, entries, max_depth)
    sized = reached.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_STEPS)
    chosen = sized.join(entries.select(F.col("usr").alias("seed"), "score"), "seed").orderBy(F.desc("score"), "seed").limit(flows).select("seed")
    step = F.row_number().over(W.partitionBy("seed").orderBy("depth", "id")).cast("long")
    return reached.join(chosen, "seed").select(L.process_id(F.col("seed")).alias("process_id"), F.col("seed").alias("entry"), F.col("id").alias("usr"), "depth", step.alias("step"))


def flow_summary(steps: DataFrame, symbols: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(process_id, entry, label, step_count, process_type): ``entry → last reached``; cross_community if the
    steps touch more than one community of ``members`` (usr, community)."""
    names = symbols.select("usr", "name")
    ends = steps.groupBy("process_id", "entry").agg(F.max_by("usr", "step").alias("last"), F.max("step").alias("n"))
    label = ends.join(names.select(F.col("usr").alias("entry"), F.col("name").alias("a")), "entry", "left").join(names.select(F.col("usr").alias("last"), F.col("name").alias("b")), "last", "left")
    out = label.select("process_id", "entry", F.concat(F.coalesce("a", "entry"), F.lit(" → "), F.coalesce("b", "last")).alias("label"), (F.col("n") + 1).alias("step_count"))
    if members is None:
        return out.withColumn("process_type", F.lit("intra_community"))
    everyone = steps.select("process_id", "usr").unionByName(steps.select("process_id", F.col("entry").alias("usr"))).distinct()
    touched = everyone.join(members, "usr").groupBy("process_id").agg(F.countDistinct("community").alias("k"))
    return out.join(touched, "process_id", "left").withColumn("process_type", F.when(F.col("k") > 1, "cross_community").otherwise("intra_community")).drop("k")


def communities(edges: DataFrame, rounds: int = 8, levels: int = 2) -> DataFrame:
    """(usr, community): groups of dense calls by local moves that raise modularity.

    Every round each node of one parity may move to the neighbouring community of the highest gain (ties
    to the smaller id), so two nodes never swap for ever; then communities become nodes of the next level.
    All rounds are joins and aggregations; nothing is gathered in one task. ``edges`` (src, dst) is taken
    without direction; a community is named by its smallest member.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    links = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    total = links.agg(F.sum("w")).first()[0]  # twice the weight of the graph
    nodes = links.select(F.col("a").alias("usr")).distinct()
    if not total:
        return nodes.select("usr", F.col("usr").alias("community"))
    member = nodes.select("usr", F.col("usr").alias("community"))
    for _ in range(levels):
        weight = cut(links.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("k")))
        own = cut(weight.select("n", "k", F.col("n").alias("c")))
        for r in range(rounds):
            sizes = own.groupBy("c").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
            near = links.where("a <> b").join(own.select(F.col("n").alias("b"), F.col("c").alias("d")), "b").groupBy(F.col("a").alias("n"), "d").agg(F.sum("w").alias("into"))
            stay = own.select("n", F.col("c").alias("d"), F.lit(0.0).alias("into"))
            choice = near.unionByName(stay).groupBy("n", "d").agg(F.sum("into").alias("into")).join(own, "n").join(sizes.select(F.col("c").alias("d"), "tot", "size"), "d")
            rest = F.col("tot") - F.when(F.col("d") == F.col("c"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("into") - F.col("k") * rest / total, 9)
            best = choice.withColumn("gain", gain).groupBy("n").agg(F.max(F.when(F.col("d") == F.col("c"), F.col("gain"))).alias("now"), F.max("gain").alias("gain"), F.min_by("d", F.struct(-F.col("gain"), F.col("d"))).alias("to"))
            turn = F.pmod(F.xxhash64("n"), F.lit(2)) == r % 2
            nxt = own.join(best, "n").select("n", "k", F.when(turn & (F.col("gain") > F.col("now")), F.col("to")).otherwise(F.col("c")).alias("c2"), "c")
            nxt = cut(nxt)
            moved = nxt.where("c <> c2").limit(1).count()
            own = nxt.select("n", "k", F.col("c2").alias("c"))
            if not moved and r:
                break
        names = cut(own.join(own.groupBy("c").agg(F.min("n").alias("m")), "c").select("n", F.col("m").alias("c")))
        member = cut(member.join(names, member["community"] == names["n"]).select("usr", F.col("c").alias("community")))
        links = cut(links.join(names.select(F.col("n").alias("a"), F.col("c").alias("ca")), "a").join(names.select(F.col("n").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    return member


def community_table(members: DataFrame, scope: str = "", least: int = 2) -> DataFrame:
    """(id, size) of the communities of at least two members."""
    return members.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least).select(F.concat(F.lit(f"community:{scope}:"), "community").alias("id"), "size")
