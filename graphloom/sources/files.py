"""File listings and source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import parsing as P

#: Extensions of source files (fixed values).
SOURCE_EXTENSIONS = ["swift", "m", "mm", "h", "hpp", "hh", "c", "cc", "cpp", "cxx", "metal", "modulemap"]


def listing(spark: SparkSession, roots: list[str], pattern: str = "*") -> DataFrame:
    """(path, modified, size) of the files under the roots; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")).dropDuplicates(["path"])


def source_files(files: DataFrame, root: str | None = None) -> DataFrame:
    """Listed files with a source extension, under ``root`` if it is given."""
    test = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(SOURCE_EXTENSIONS)
    if root:
        root = root.rstrip("/")
        test = test & ((F.col("path") == root) | F.col("path").startswith(root + "/"))
    return files.where(test)


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max("modified").alias("newest"))


def up_to_date(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, fresh): whether the index (path, indexed_at) is as new as the file; false if the file is gone."""
    return indexed.join(files.select("path", "modified"), "path", "left").select("path", F.coalesce(F.col("modified") <= F.col("indexed_at"), F.lit(False)).alias("fresh"))


def lines_of(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, line, text) with lines from 1. Files are read whole and exploded, so numbers need no sort."""
    whole = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def blocks(lines: DataFrame, token: str, window: int = 5) -> DataFrame:
    """(path, line, text): each line that holds ``token``, joined with the lines after it, ``window`` in all."""
    w = W.partitionBy("path").orderBy("line").rowsBetween(0, window - 1)
    return lines.withColumn("block", F.array_join(F.collect_list("text").over(w), "\n")).where(F.col("text").contains(token)).select("path", "line", F.col("block").alias("text"))


def method_blocks(lines: DataFrame) -> DataFrame:
    """(path, line, selector, text) of bracket-language methods: from the signature to the closing brace.

    The brace depth is a running sum in each file; a method ends at the first line that brings it back to
    where the method began.
    """
    w = W.partitionBy("path").orderBy("line")
    braces = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    depth = lines.withColumn("change", braces("{") - braces("}")).withColumn("after", F.sum("change").over(w))
    depth = depth.withColumn("before", F.col("after") - F.col("change")).withColumn("start", (F.col("before") == 0) & F.col("text").rlike(r"^\s*[+-]\s*\([^)]*\)"))
    numbered = depth.withColumn("method", F.sum(F.col("start").cast("int")).over(w)).where("method > 0")
    ended = F.min(F.when((F.col("after") <= 0) & (F.instr("text", "}") > 0), F.col("line"))).over(W.partitionBy("path", "method"))
    inside = numbered.withColumn("end", ended).where("line <= end")
    body = inside.groupBy("path", "method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min("line").alias("line"), F.min_by("text", "line").alias("head"))
    return body.select("path", "line", P.method_selector(F.col("head")).alias("selector"), "text")
