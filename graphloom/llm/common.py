"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir, cut, release  # noqa: F401  for the operators

#: Prefix of every helper column, so that columns of the caller's tables never clash with ours.
PRE = "__gl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder, read by Spark (the folder may lie in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own in the shared checkpoint folder; it is deleted at the end, in whatever store it is."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        remove(spark, folder)


def worker_path(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did.

    Elsewhere the package has to be installed or sent with ``--py-files``, as for any library.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def pick(df: DataFrame, wanted: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Project (column, type, new name) triples; a column that is missing reads as null."""
    worker_path(df.sparkSession)
    have = set(df.columns)
    return df.select(*[(df[c] if c in have else F.lit(None)).cast(t).alias(n) for c, t, n in wanted])


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on all ``names``."""
    out = left[names[0]].eqNullSafe(right[names[0]])
    for n in names[1:]:
        out = out & left[n].eqNullSafe(right[n])
    return out


#: White space that parts words, as a Java class: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column, pattern: str = WORD) -> Column:
    """Array of the words of a text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def window_hashes(words: Column, k: int) -> Column:
    """64-bit hash of each window of ``k`` consecutive words; empty for fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def union_of_spans(starts: Column, k: int) -> Column:
    """Length of the union of [s, s + k) over the rising ``starts``."""
    return let(
        starts,
        lambda a: F.aggregate(F.transform(a, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(a, j + 1) - p, F.lit(k))).cast("int")), F.lit(0), lambda x, y: x + y),
    )


#: A group is hot if it holds more than one in HOT_SHARE of all rows; there are fewer such groups than HOT_SHARE.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, salt: list[str]) -> DataFrame:
    """Inner join of ``rows`` to one row for each group on a long ``key``, even where a group is hot.

    ``count`` is the group's number of rows. The hot groups, which are fewer than HOT_SHARE whatever the
    input, are broadcast; their rows then travel by a hash of ``salt`` instead of the key, so none of the
    shuffle's partitions gets them all. The rows of ``rows`` are read once.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    values = [c for c in groups.columns if c not in (key, count)]
    side = lambda df, p: df.select(F.col(key).alias(f"{PRE}{p}"), *[F.col(c).alias(f"{PRE}{p}_{c}") for c in values])
    hot, cool = side(groups.where(F.col(count) * HOT_SHARE > total), "h"), side(groups.where(F.col(count) * HOT_SHARE <= total), "c")
    spread = rows.join(F.broadcast(hot), rows[key] == hot[f"{PRE}h"], "left")
    spread = spread.withColumn(f"{PRE}k", F.when(F.col(f"{PRE}h").isNotNull(), F.xxhash64(F.lit(PRE), *salt)).otherwise(F.col(key)))
    both = spread.join(cool, F.col(f"{PRE}k") == F.col(f"{PRE}c"), "left")
    is_hot = F.col(f"{PRE}h").isNotNull()
    both = both.where(is_hot | F.col(f"{PRE}c").isNotNull())
    return both.select(*rows.columns, *[F.when(is_hot, F.col(f"{PRE}h_{c}")).otherwise(F.col(f"{PRE}c_{c}")).alias(c) for c in values])
