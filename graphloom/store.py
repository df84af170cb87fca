"""Versioned graph store: one Parquet folder for each table and snapshot.

A snapshot is immutable. Writers stage a new folder and publish it by a numbered one-line pointer, so
readers keep the snapshot that they opened. Edges are partitioned by type: a query for some types reads
those folders only. A lock file makes one writer at a time; a second one gets ``Busy``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

#: Exit code of a command that finds the graph locked (fixed value).
BUSY_EXIT_CODE = 23
#: A lock of this age belongs to a writer that died.
LOCK_SECONDS = 6 * 3600


class Busy(RuntimeError):
    """Another writer holds the graph."""


class Files:
    """Small files beside the tables, in whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        with_stream = self._fs.open(self.at(name))
        try:
            return self._io.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        out = self._fs.create(self.at(name), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def replace(self, name: str, text: str) -> None:
        """Readers see the old or the new text, and a crash leaves one of them.

        Each text is a numbered file of its own, staged and then renamed to a name that did not exist; the
        highest number counts. Files before the last but one go afterwards.
        """
        staged, last = f".{name}.{uuid.uuid4().hex}", max(self._numbers(name), default=0)
        self.write(staged, text)
        if not self._fs.rename(self.at(staged), self.at(f"{name}-{last + 1:012d}")):
            self.delete(staged)
            raise Busy(f"{self.root}: {name} was replaced by another writer")
        for n in self._numbers(name):
            if n < last:
                self.delete(f"{name}-{n:012d}")

    def overwrite(self, name: str, text: str) -> None:
        """Put ``text`` in the file itself: staged beside it, then renamed over it."""
        jvm, staged = self.spark.sparkContext._jvm, f".{name}.{uuid.uuid4().hex}"
        self.write(staged, text)
        fs = jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(fs.Options, "Rename"), 1)
        options[0] = getattr(fs.Options, "Rename").OVERWRITE
        context = fs.FileContext.getFileContext(self.at(staged).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        at = lambda n: self._fs.makeQualified(self.at(n))
        context.rename(at(staged), at(name), options)
        self.delete(f".{name}.crc")  # a sum beside a source file would outlast its next edit

    def _numbers(self, name: str) -> list[int]:
        if not self._fs.exists(self.at("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self.at(""))]
        return [int(n[len(name) + 1 :]) for n in names if n.startswith(f"{name}-") and n[len(name) + 1 :].isdigit()]

    def latest(self, name: str) -> str | None:
        """The text last put in place by ``replace``."""
        last = max(self._numbers(name), default=None)
        return None if last is None else self.read(f"{name}-{last:012d}")


class GraphStore:
    """Nodes and edges of one snapshot (the current one unless ``version`` is given)."""

    def __init__(self, spark: SparkSession, root: str, version: str | None = None):
        self.spark, self.files = spark, Files(spark, root)
        self.version = version or (self.files.latest("CURRENT") or "").strip() or None

    def _read(self, part: str, want) -> DataFrame:
        if self.version is None or not self.files.exists(f"{self.version}/{part}"):
            return schemas.empty(self.spark, want)
        return schemas.conform(self.spark.read.parquet(f"{self.files.root}/{self.version}/{part}"), want)

    def nodes(self, label: str) -> DataFrame:
        return self._read(f"nodes/{label}", schemas.node_schema(label))

    def edges(self, *kinds: str) -> DataFrame:
        """(rel_type, src, dst, properties) of the given types (all types if none is given)."""
        parts = [self._read(f"edges/rel_type={k}", schemas.edge_schema(k)).withColumn("rel_type", F.lit(k)) for k in kinds or schemas.EDGES]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    @contextmanager
    def lock(self):
        """Hold the graph for writing; raises Busy if another writer does.

        The lock names its owner and time. One older than ``LOCK_SECONDS`` was left by a writer that died, and is taken over.
        """
        owner = uuid.uuid4().hex
        held = json.loads(self.files.read("LOCK") or "{}") if self.files.exists("LOCK") else {}
        if held.get("time") and time.time() - held["time"] > LOCK_SECONDS:
            self.files.delete("LOCK")
        try:
            self.files.write("LOCK", json.dumps({"owner": owner, "time": time.time()}), overwrite=False)
        except Exception as e:
            raise Busy(self.files.root) from e
        try:
            yield self
        finally:
            if json.loads(self.files.read("LOCK") or "{}").get("owner") == owner:
                self.files.delete("LOCK")

    def commit(self, nodes: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame] | None = None, keep: bool = True) -> "GraphStore":
        """A new snapshot with the given tables; ``keep`` carries the others over (else: full rebuild).

        Uniqueness of node keys is made here: the first row in column order of each key stays.
        """
        nodes, edges, new = nodes or {}, edges or {}, f"v-{uuid.uuid4().hex[:12]}"
        out = f"{self.files.root}/{new}"
        for label in schemas.NODES:
            df = nodes.get(label, self.nodes(label) if keep and self.files.exists(f"{self.version}/nodes/{label}") else None)
            if df is not None:
                key, df = schemas.key_of(label), schemas.conform(df, schemas.node_schema(label))
                df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("row")).select(key, "row.*").write.parquet(f"{out}/nodes/{label}") if len(df.columns) > 1 else df.distinct().write.parquet(f"{out}/nodes/{label}")
        for kind in schemas.EDGES:
            df = edges.get(kind, self._read(f"edges/rel_type={kind}", schemas.edge_schema(kind)) if keep and self.files.exists(f"{self.version}/edges/rel_type={kind}") else None)
            if df is not None:
                schemas.conform(df, schemas.edge_schema(kind)).write.parquet(f"{out}/edges/rel_type={kind}")
        self.files.replace("CURRENT", new)
        return GraphStore(self.spark, self.files.root)

    def state(self) -> dict:
        return json.loads(self.files.latest("STATE") or "{}")

    def save_state(self, **values) -> None:
        self.files.replace("STATE", json.dumps({**self.state(), **values}, sort_keys=True))


def resolve_path(candidates: Iterable[str | None], default: str) -> str:
    """The first path that is given, in order of precedence (argument, environment, found), else ``default``."""
    return next((c for c in candidates if c), default)
