"""Scan records: JSON lines of three kinds, read tolerantly.

A line that is no JSON, or lacks a required field, becomes a warning with its first characters; the
other lines of the file are kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Required and optional fields of each kind (fixed values).
REQUIRED = {"occurrence": ["usr", "file", "line", "column", "role"], "relation": ["from_usr", "to_usr", "role"], "symbol": ["usr", "name", "symbol_kind", "language"]}
OPTIONAL = {"occurrence": [], "relation": ["occurrence_role", "file", "line", "column", "from_usr_name", "to_usr_name"], "symbol": ["module", "file"]}
NUMBERS = ["line", "column"]
SNIPPET = 80

_FIELDS = ["kind", "usr", "file", "line", "column", "role", "from_usr", "to_usr", "occurrence_role", "from_usr_name", "to_usr_name", "name", "symbol_kind", "language", "module"]
_SCHEMA = T.StructType([T.StructField(f, T.LongType() if f in NUMBERS else T.StringType()) for f in _FIELDS] + [T.StructField("_bad", T.StringType())])


def _parsed(lines: DataFrame) -> DataFrame:
    rec = F.from_json("value", _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.trim("value") != "").select("value", rec.alias("r"))


def _complete(kind: str) -> Column:
    out = F.col("r._bad").isNull() & (F.col("r.kind") == kind)
    for f in REQUIRED[kind]:
        out = out & F.col(f"r.{f}").isNotNull()
    return F.coalesce(out, F.lit(False))


def records(lines: DataFrame, kind: str) -> DataFrame:
    """The complete records of one kind from lines (value); ``column`` is renamed ``col``. Missing optional
    texts read as empty, numbers as 0."""
    cols = []
    for f in REQUIRED[kind] + OPTIONAL[kind]:
        value = F.col(f"r.{f}")
        if f in OPTIONAL[kind]:
            value = F.coalesce(value, F.lit(0).cast("long") if f in NUMBERS else F.lit(""))
        cols.append(value.alias("col" if f == "column" else f))
    return _parsed(lines).where(_complete(kind)).select(*cols)


def warnings(lines: DataFrame) -> DataFrame:
    """(reason, snippet) of the lines that are no complete record of a known kind."""
    known = _complete("occurrence") | _complete("relation") | _complete("symbol")
    reason = F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "malformed").when(F.col("r.kind").isNull() | ~F.col("r.kind").isin(*REQUIRED), "unknown kind").otherwise("missing field")
    return _parsed(lines).where(~known).select(reason.alias("reason"), F.substring("value", 1, SNIPPET).alias("snippet"))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """occurrence, relation, symbol and warning tables of the scan files at ``path``."""
    lines = spark.read.text(path)
    return {k: records(lines, k) for k in REQUIRED} | {"warning": warnings(lines)}


def dedup_relations(relations: DataFrame) -> DataFrame:
    """One row for each (from, to, role, occurrence role), by least place."""
    key = ["from_usr", "to_usr", "role", "occurrence_role"]
    rest = [c for c in relations.columns if c not in key]
    return relations.groupBy(*key).agg(F.min(F.struct("file", "line", "col", *[c for c in rest if c not in ("file", "line", "col")])).alias("r")).select(*key, "r.*")


def file_status(stderr: str) -> dict:
    """The last line that is a JSON object with ``changed`` or ``all``; empty lists if there is none."""
    for line in reversed(stderr.splitlines()):
        try:
            found = json.loads(line)
        except ValueError:
            continue
        if isinstance(found, dict) and ("changed" in found or "all" in found):
            return {"changed": found.get("changed", []), "all": found.get("all", []), "output_path_mappings": found.get("output_path_mappings", [])}
    return {"changed": [], "all": [], "output_path_mappings": []}
