"""A graph as immutable tables: every change gives a new graph, and a frozen one takes no more."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GraphTables:
    """``nodes`` has id, label, file_path; ``edges`` src, dst, rel_type; further columns are kept."""

    nodes: DataFrame
    edges: DataFrame
    frozen: bool = False

    def _open(self) -> None:
        if self.frozen:
            raise RuntimeError("the graph is frozen")

    def add_nodes(self, rows: DataFrame) -> "GraphTables":
        """Rows of ids that are there already replace the old ones."""
        self._open()
        kept = self.nodes.join(rows.select("id"), "id", "left_anti")
        return replace(self, nodes=kept.unionByName(rows, allowMissingColumns=True))

    def add_edges(self, rows: DataFrame) -> "GraphTables":
        self._open()
        return replace(self, edges=self.edges.unionByName(rows, allowMissingColumns=True).distinct())

    def remove_nodes(self, ids: DataFrame) -> "GraphTables":
        """Without the nodes (id) and all their edges."""
        self._open()
        edges = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
        return replace(self, nodes=self.nodes.join(ids, "id", "left_anti"), edges=edges)

    def remove_files(self, files: DataFrame) -> "GraphTables":
        """Without the nodes of the files (path) and all their edges."""
        return self.remove_nodes(self.nodes.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id"))

    def of_type(self, *rel_types: str) -> DataFrame:
        return self.edges.where(F.col("rel_type").isin(*rel_types))

    def of_label(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label)

    def freeze(self) -> "GraphTables":
        return replace(self, frozen=True)
