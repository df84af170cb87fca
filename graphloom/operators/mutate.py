"""Loading the graph: upserts, placeholders, deduplication and retraction, as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

#: Fields of a symbol that an upsert compares (fixed values).
MUTABLE = ["precise_id", "name", "swift_display_name", "language", "kind", "module", "file_path", "signature", "container_usr", "access_level"]
#: Edge table of a structural role, and of a relation kind of symbol documents (fixed values).
ROLE_TABLES = {"childOf": "Contains", "baseOf": "Inherits", "overrideOf": "Implements", "extendedBy": "Extends", "containedBy": "Contains"}
KIND_TABLES = {"memberOf": "Contains", "conformsTo": "ConformsTo", "inheritsFrom": "Inherits", "overrides": "Implements"}
STRUCTURE_CONFIDENCE = 0.90
PRIORITY = {"definition": 3, "declaration": 2}


def _lookup(column, table: dict[str, str]):
    return F.coalesce(*[F.when(column == k, v) for k, v in table.items()])


def upsert(old: DataFrame, new: DataFrame, key: str = "id", compare: list[str] | None = None) -> DataFrame:
    """All rows after the upsert, with ``change``: inserted, updated (a compared field differs) or kept.

    A field that is null in the new row keeps its old value.
    """
    compare = compare or [c for c in old.columns if c != key and c in new.columns]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    differs = reduce(lambda a, b: a | b, [F.col(f"n.{c}").isNotNull() & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in compare])
    change = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNotNull() & differs, "updated").otherwise("kept")
    cols = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c == key or c in compare else F.col(f"o.{c}").alias(c) for c in old.columns]
    return both.select(*cols, change.alias("change"))


def merge_sources(first: DataFrame, second: DataFrame, key: str = "usr") -> DataFrame:
    """Full outer merge of two symbol sources: the first wins where it has a value that is not empty."""
    a, b = first.alias("a"), second.alias("b")
    cols = [F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")), F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in first.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*cols)


def placeholders(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols for the ends of ``relations`` (src, dst) that are unknown."""
    ends = relations.select(F.col("src").alias("usr")).unionByName(relations.select(F.col("dst").alias("usr"))).where("usr is not null").distinct()
    missing = ends.join(symbols.select("usr"), "usr", "left_anti")
    return missing.select(F.col("usr").alias("id"), "usr", F.col("usr").alias("name"), F.lit("unknown").alias("kind"), F.lit("").alias("module"), F.lit("objc").alias("language"), F.lit("indexstore_placeholder").alias("origin"), F.lit(True).alias("is_generated"))


def call_edges(relations: DataFrame, build_id: str = "") -> DataFrame:
    """Calls from scan relations (role calledBy): from the user to the used; a direct call outweighs the rest."""
    rows = relations.where("role = 'calledBy' and from_usr is not null and to_usr is not null")
    direct = F.max(F.when(F.col("occurrence_role") == "call", 1).otherwise(0))
    return rows.groupBy(F.col("to_usr").alias("src"), F.col("from_usr").alias("dst")).agg(direct.alias("d")).select(
        "src", "dst", F.lit("indexstore").alias("source"), F.lit(1.0).alias("confidence"), F.lit("indexstore").alias("provenance"), F.lit(build_id).alias("build_id"),
        F.when(F.col("d") == 1, L.DIRECT).otherwise(L.INFERRED).alias("reason"),
    )


def structure_edges(relations: DataFrame) -> DataFrame:
    """(rel_type, src, dst, confidence): structural roles run from to_usr to from_usr."""
    table = _lookup(F.col("role"), ROLE_TABLES)
    return relations.select(table.alias("rel_type"), F.col("to_usr").alias("src"), F.col("from_usr").alias("dst"), F.lit(STRUCTURE_CONFIDENCE).alias("confidence")).where("rel_type is not null and src is not null and dst is not null").distinct()


def document_edges(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(rel_type, src, dst) of symbol-document relations (source, target, kind) between known symbols; other
    kinds are skipped. A member is contained by its target."""
    known, table = symbols.select("usr"), _lookup(F.col("kind"), KIND_TABLES)
    rows = relations.withColumn("rel_type", table).where("rel_type is not null")
    rows = rows.join(known.select(F.col("usr").alias("source")), "source", "left_semi").join(known.select(F.col("usr").alias("target")), "target", "left_semi")
    member = F.col("kind") == "memberOf"
    return rows.select("rel_type", F.when(member, F.col("target")).otherwise(F.col("source")).alias("src"), F.when(member, F.col("source")).otherwise(F.col("target")).alias("dst")).distinct()


def reference_edges(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    known = symbols.select("usr")
    rows = relations.where("role = 'references'").select(F.col("from_usr").alias("src"), F.col("to_usr").alias("dst")).distinct()
    return rows.join(known.select(F.col("usr").alias("src")), "src", "left_semi").join(known.select(F.col("usr").alias("dst")), "dst", "left_semi")


def canonical(occurrences: DataFrame) -> DataFrame:
    """The best occurrence of each symbol: definition before declaration before others, then first by place."""
    priority = F.coalesce(*[F.when(F.col("role") == r, p) for r, p in PRIORITY.items()], F.lit(1))
    rest = [c for c in occurrences.columns if c != "usr"]
    order = F.struct((-priority).alias("p"), *[F.col(c) for c in ("file", "line", "col") if c in rest])
    return occurrences.groupBy("usr").agg(F.min_by(F.struct(*rest), order).alias("best")).select("usr", "best.*")


def files_of(symbols: DataFrame) -> DataFrame:
    """(path, module, language): one row for each file, its properties from the symbol of the smallest id."""
    return symbols.where("file_path is not null and file_path <> ''").groupBy(F.col("file_path").alias("path")).agg(F.min_by(F.struct("module", "language"), "usr").alias("p")).select("path", "p.*")


def changed_files(files: DataFrame, units: DataFrame, since) -> DataFrame:
    """Files (path) whose unit (path, unit_ts) is newer than ``since`` or unknown."""
    return files.join(units, "path", "left").where(F.col("unit_ts").isNull() | (F.col("unit_ts") > since)).select("path")


def retract(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) without the symbols of the changed files (path) and the edges that start in them.

    Edges into them from files that did not change stay: those files are not scanned again.
    """
    gone = symbols.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("usr")
    return symbols.join(gone, "usr", "left_anti"), edges.join(gone.select(F.col("usr").alias("src")), "src", "left_anti")


def prune(symbols: DataFrame, active: DataFrame) -> DataFrame:
    return symbols.join(active.select("usr"), "usr", "left_semi")


def unused_notifications(notifications: DataFrame, posts: DataFrame, observes: DataFrame) -> DataFrame:
    """Notifications that no edge names any more."""
    used = posts.select(F.col("dst").alias("name")).unionByName(observes.select(F.col("src").alias("name")))
    return notifications.join(used, "name", "left_anti")
