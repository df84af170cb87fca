"""Renames: the sites of a symbol and of its references, and the edited text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sites(symbols: DataFrame, references: DataFrame, usr: str, new_name: str) -> DataFrame:
    """(file_path, old_name, new_name, n): the files to edit: the symbol's own and those that refer to it."""
    if not re.fullmatch(r"[A-Za-z_]\w*", new_name):
        raise ValueError(f"not a name: {new_name!r}")
    target = symbols.where(F.col("usr") == usr).select(F.col("usr").alias("dst"), F.col("name").alias("old_name"), F.col("file_path").alias("own"))
    users = references.join(target, "dst").join(symbols.select(F.col("usr").alias("src"), "file_path"), "src").select("file_path", "old_name")
    rows = target.select(F.col("own").alias("file_path"), "old_name").unionByName(users).where("file_path is not null and file_path <> ''")
    return rows.groupBy("file_path", "old_name").agg(F.count("*").alias("n")).select("file_path", "old_name", F.lit(new_name).alias("new_name"), "n")


def renamed(text: Column, old: str, new: str) -> Column:
    """``text`` with every whole word ``old`` replaced."""
    return F.regexp_replace(text, rf"\b{re.escape(old)}\b", new)


def diff(lines: DataFrame, plan: DataFrame, old: str, new: str) -> DataFrame:
    """(path, line, before, after) of the lines (path, line, text) that change in the planned files."""
    inside = lines.join(plan.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi")
    return inside.withColumn("after", renamed(F.col("text"), old, new)).where("after <> text").select("path", "line", F.col("text").alias("before"), "after")


def apply(spark, plan: DataFrame) -> int:
    """Write the renamed text of every planned file; returns how many files changed.

    A plan names the files of one symbol, one after the other; a file is staged and renamed over the old one.
    """
    from ..store import Files

    changed = 0
    for r in plan.toLocalIterator():
        folder, _, name = r["file_path"].rpartition("/")
        files = Files(spark, folder or ".")
        before = files.read(name)
        after = None if before is None else re.sub(rf"\b{re.escape(r['old_name'])}\b", r["new_name"], before)
        if after is not None and after != before:
            files.overwrite(name, after)
            changed += 1
    return changed
