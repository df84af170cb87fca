"""Incremental ingest with Structured Streaming.

Scan files arrive in a folder. Every micro-batch retracts what the changed files held, adds what they
hold now, and publishes one new snapshot; the stream's checkpoint is the ledger of what was seen, so a
batch that fails is run again and a batch that was published is not. ``batch id`` is stored with the
snapshot, which makes the replay of a published batch a no-op.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import labels as L
from ..operators import mutate
from ..runtime import cut
from ..sources import scan
from ..store import Busy, GraphStore

#: Seconds of quiet before a burst of changes is taken up; retries of a locked graph (fixed values).
QUIET_SECONDS, MAX_RETRIES, MAX_DELAY = 10, 10, 120


def symbol_rows(records: DataFrame) -> DataFrame:
    """Symbol nodes from symbol records; of several for one id the first by name and file."""
    one = records.groupBy("usr").agg(F.min(F.struct("name", "symbol_kind", "language", "module", "file")).alias("r"))
    made = one.select(
        F.col("usr").alias("id"), "usr", F.col("usr").alias("precise_id"), "r.name", L.symbol_kind(F.col("r.symbol_kind")).alias("kind"), "r.language", "r.module",
        F.col("r.file").alias("file_path"), F.lit("indexstore").alias("origin"), F.lit(False).alias("is_generated"),
    )
    return schemas.conform(made, schemas.node_schema("Symbol"))


def apply_scan(store: GraphStore, lines: DataFrame, changed: DataFrame | None = None, build_id: str = "", deleted: DataFrame | None = None) -> GraphStore:
    """Publish a snapshot with the records of ``lines`` (value) in place of those of the changed files (path).

    Unless given, the changed files are those of the symbol records. Files that a status line of the scan
    ({"changed": [...], "all": [...]}) names as changed lose what they had too, so do files that ``all`` does
    not name, and the ``deleted`` files (path).
    """
    # parsed once: every table of the snapshot is made from these two
    symbols, relations = cut(symbol_rows(scan.records(lines, "symbol"))), cut(scan.dedup_relations(scan.records(lines, "relation")))
    changed = symbols.select(F.col("file_path").alias("path")).distinct() if changed is None else changed
    kinds = ["Calls", "Contains", "Inherits", "Extends", "Implements"]
    old, new_edges = store.nodes("Symbol"), {}
    status = lines.select(F.from_json("value", "changed array<string>, `all` array<string>").alias("s")).where("s.`all` is not null")
    listed = cut(status.select(F.explode("s.all").alias("path")).distinct())
    if not listed.isEmpty():
        gone = old.where("file_path <> ''").select(F.col("file_path").alias("path")).distinct().join(listed, "path", "left_anti")
        changed = changed.unionByName(status.select(F.explode("s.changed").alias("path"))).unionByName(gone)
    if deleted is not None:
        changed = changed.unionByName(deleted.select("path"))
    changed = cut(changed.distinct())
    kept, _ = mutate.retract(old, store.edges("Calls").select("src", "dst"), changed)
    all_symbols = mutate.upsert(kept, symbols, "id", mutate.MUTABLE + ["usr", "origin", "is_generated"]).drop("change")
    calls, structure = mutate.call_edges(relations, build_id), mutate.structure_edges(relations)
    for k in kinds:
        fresh = calls if k == "Calls" else structure.where(F.col("rel_type") == k).withColumn("source", F.lit("indexstore"))
        _, left = mutate.retract(old, store.edges(k).drop("rel_type"), changed)
        want = schemas.edge_schema(k)
        new_edges[k] = schemas.conform(fresh, want).unionByName(schemas.conform(left, want)).distinct()
    ends = calls.select("src", "dst").unionByName(structure.select("src", "dst"))
    all_symbols = cut(schemas.conform(all_symbols, schemas.node_schema("Symbol")).unionByName(schemas.conform(mutate.placeholders(ends, all_symbols), schemas.node_schema("Symbol"))))
    nodes = {"Symbol": all_symbols, "File": mutate.files_of(all_symbols)}
    if build_id:  # the record that tells a later query how fresh the graph is
        want = schemas.node_schema("BuildSnapshot")
        made = store.spark.createDataFrame([(build_id, datetime.now(timezone.utc).isoformat())], "id string, created_at string")
        known = store.nodes("BuildSnapshot").where(F.col("id") != build_id)
        nodes["BuildSnapshot"] = schemas.conform(made, want).unionByName(schemas.conform(known, want))
    return store.commit(nodes, new_edges)


def with_retries(action: Callable[[], object], retries: int = MAX_RETRIES, sleep: Callable[[float], None] = time.sleep, rand: Callable[[float, float], float] = random.uniform):
    """Run ``action``; while the graph is locked, wait 2**n seconds (120 at most) times 0.5 to 1 and try again."""
    for n in range(retries + 1):
        try:
            return action()
        except Busy:
            if n == retries:
                raise
            sleep(min(2**n, MAX_DELAY) * rand(0.5, 1.0))


def watch(spark: SparkSession, inbox: str, root: str, checkpoint: str, once: bool = False, build_id: str = "", targets: Sequence[str] = ()) -> StreamingQuery:
    """Keep the graph at ``root`` up to date with the scan files that arrive in ``inbox``, made for ``targets``.

    ``once`` takes what is there and stops; else a batch starts at most every quiet period.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        store = GraphStore(spark, root)
        if store.state().get("batch_id", -1) >= batch_id or batch.isEmpty():
            return

        def publish() -> None:
            with store.lock():
                apply_scan(GraphStore(spark, root), batch, build_id=build_id)
                store.save_state(batch_id=batch_id, last_ingest_ts=time.time(), targets=sorted({*store.state().get("targets", []), *targets}))

        with_retries(publish)

    stream = spark.readStream.text(inbox).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=f"{QUIET_SECONDS} seconds")).start()


def is_current(state: dict, newest_unit: float, targets: list[str]) -> bool:
    """Whether nothing changed since the last ingest and its targets covered these (an empty table of none)."""
    return newest_unit <= state.get("last_ingest_ts", float("-inf")) and set(targets) <= set(state.get("targets", []))


def bursts(events: DataFrame, quiet: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n): bursts of events (key, ts) with gaps under ``quiet``; works on streams and tables.

    On a stream a burst is emitted once the watermark has passed its end; events later than that are dropped.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    gap = F.session_window("ts", quiet)
    return timed.groupBy("key", gap.alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
