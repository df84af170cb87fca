"""Symbol documents (nested JSON) and interface text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P

_SCHEMA = """
module struct<name:string>,
symbols array<struct<identifier:struct<precise:string,interfaceLanguage:string>,kind:struct<identifier:string>,
  names:struct<title:string>,declarationFragments:array<struct<spelling:string>>,accessLevel:string,
  location:struct<uri:string>>>,
relationships array<struct<kind:string,source:string,target:string>>
"""


def read_symbol_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, relations) of the documents at ``path``: one nested document a file."""
    docs = spark.read.schema(_SCHEMA).option("multiLine", True).json(path)
    s = docs.select(F.col("module.name").alias("module"), F.explode("symbols").alias("s"))
    signature = F.nullif(F.array_join(F.transform("s.declarationFragments", lambda f: f["spelling"]), ""), F.lit(""))
    symbols = s.select(
        F.col("s.identifier.precise").alias("usr"), F.col("s.identifier.precise").alias("precise_id"), F.col("s.names.title").alias("name"), F.col("s.kind.identifier").alias("kind"), "module",
        F.col("s.identifier.interfaceLanguage").alias("language"), F.regexp_replace("s.location.uri", "^file://", "").alias("file_path"), signature.alias("signature"), F.col("s.accessLevel").alias("access_level"),
    )
    return symbols, docs.select(F.explode("relationships").alias("r")).select("r.source", "r.target", "r.kind")


def conformances(texts: DataFrame, text: str = "value", module: str = "module") -> DataFrame:
    """(type_name, type_kind, protocol_name, module) of interface texts: one row for each protocol of each type."""
    at = lambda n: F.regexp_extract_all(text, F.lit(P.DECLARATION), F.lit(n))
    rows = texts.select(F.col(module).alias("module"), F.explode(F.arrays_zip(at(1).alias("kind"), at(2).alias("name"), at(3).alias("inherits"))).alias("d"))
    return rows.select(F.col("d.name").alias("type_name"), F.col("d.kind").alias("type_kind"), F.explode(P.protocols(F.col("d.inherits"))).alias("protocol_name"), "module")


def read_interfaces(spark: SparkSession, path: str) -> DataFrame:
    """Conformances of the interface files at ``path``; the module is the file's name up to its first dot."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return conformances(spark.read.text(path, wholetext=True).select("value", F.split_part(name, F.lit("."), F.lit(1)).alias("module")))


def dependency_files(text: Column) -> Column:
    """Array of the paths of a make-style dependency list; a backslash keeps the next character."""
    body = F.regexp_replace(F.regexp_replace(text, r"\\\r?\n", " "), r"^[^:]*:\s", "")
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?:\\.|[^\s\\])+"), F.lit(0)), lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
