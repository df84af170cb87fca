"""Typed node, edge and input-record tables of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Node tables: columns by label; the first is the key (fixed values).
NODES: dict[str, str] = {
    "BuildSnapshot": "id string, build_system string, workspace_root string, derived_data_path string, index_store_path string, toolchain_id string, commit_sha string, created_at string, build_config_hash string, sdk string, configuration string",
    "Module": "name string, language string",
    "Target": "id string, name string, platform string, sdk string, triple string, configuration string",
    "File": "path string, module string, language string, is_generated boolean",
    "Symbol": "id string, usr string, precise_id string, name string, swift_display_name string, language string, kind string, module string, file_path string, signature string, container_usr string, access_level string, origin string, is_generated boolean",
    "Chunk": "id string, owner_usr string, chunk_kind string, content string, embedding array<float>",
    "Diagnostic": "id string, phase string, severity string, code string, message string",
    "Community": "id string, size long",
    "Process": "id string, entry_name string, entry_kind string, label string, process_type string, step_count long, entry_usr string, entry_file_path string",
    "Notification": "name string",
}

#: Edge tables: end labels and properties by type (fixed values).
EDGES: dict[str, tuple[str, str, str]] = {
    "ContainsFile": ("Module", "File", ""),
    "ContainsTarget": ("Module", "Target", ""),
    "BuiltTarget": ("BuildSnapshot", "Target", ""),
    "ObservedFile": ("BuildSnapshot", "File", ""),
    "Declares": ("File", "Symbol", ""),
    "ContainsChunk": ("Symbol", "Chunk", ""),
    "Calls": ("Symbol", "Symbol", "source string, confidence double, provenance string, build_id string, reason string"),
    "References": ("Symbol", "Symbol", "source string, confidence double, reason string"),
    "Contains": ("Symbol", "Symbol", "source string, confidence double, reason string"),
    "Extends": ("Symbol", "Symbol", "source string, confidence double, reason string"),
    "Inherits": ("Symbol", "Symbol", "source string, confidence double, reason string"),
    "Implements": ("Symbol", "Symbol", "source string, confidence double, reason string"),
    "Imports": ("File", "File", "kind string"),
    "ConformsTo": ("Symbol", "Symbol", "source string, confidence double, reason string"),
    "Posts": ("Symbol", "Notification", "confidence double, provenance string, build_id string"),
    "Observes": ("Notification", "Symbol", "selector string, observer_usr string, observer_name string, observer_file_path string, confidence double, provenance string, build_id string"),
    "BridgesTo": ("Symbol", "Symbol", "bridge_kind string, provenance string, confidence double, build_id string, reason string, clang_name string, swift_name string, definition_language string"),
    "ProducedDiagnostic": ("BuildSnapshot", "Diagnostic", ""),
    "DependsOn": ("Module", "Module", "source string, build_id string"),
    "ViewTree": ("Symbol", "Symbol", "derived_from string, confidence double, build_id string, reason string"),
    "NavigationFlow": ("Symbol", "Symbol", "derived_from string, confidence double, build_id string, reason string"),
    "MEMBER_OF": ("Symbol", "Community", ""),
    "STEP_IN_PROCESS": ("Symbol", "Process", "step long"),
}

#: Records that scanners emit (fixed values).
OCCURRENCE = "usr string, file string, line long, col long, role string"
RELATION = "from_usr string, to_usr string, role string, occurrence_role string, file string, line long, col long, from_usr_name string, to_usr_name string"
SYMBOL_LINE = "usr string, name string, symbol_kind string, language string, module string, file string"


def schema(ddl: str) -> T.StructType:
    """StructType of a column list; types are those of the tables above."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", ") if c)])


def node_schema(label: str) -> T.StructType:
    return schema(NODES[label])


def edge_schema(kind: str) -> T.StructType:
    """src, dst and the properties of an edge table."""
    return schema(", ".join(c for c in ("src string, dst string", EDGES[kind][2]) if c))


def key_of(label: str) -> str:
    return NODES[label].split()[0]


def conform(df: DataFrame, want: T.StructType) -> DataFrame:
    """The columns of ``want`` in its order and types; one that is missing reads as null (additive migration)."""
    have = set(df.columns)
    return df.select(*[(df[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])


def empty(spark: SparkSession, want: T.StructType) -> DataFrame:
    return spark.createDataFrame([], want)
