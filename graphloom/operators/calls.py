"""Callers, callees and references: one-hop expansions with the evidence rules.

``symbols`` has usr, name, kind, module, language, file_path; ``edges`` has src, dst, reason. Evidence is
judged over all rows of one target: inferred rows go unless asked for, and where any row is direct only
direct rows stay. A null reason reads as inferred in results but is no inferred row for the filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import labels as L


def evidence(edges: DataFrame, target: str, include_inferred: bool = False) -> DataFrame:
    """Rows of ``edges`` that the evidence rules keep for each value of ``target``.

    The direct targets are found by a pre-aggregated grouping, so a target of many rows needs no single task.
    """
    kept = edges if include_inferred else edges.where(~(F.col("reason").eqNullSafe(L.INFERRED)))
    direct = kept.where(F.col("reason") == L.DIRECT)
    rest = kept.where(~F.col("reason").eqNullSafe(L.DIRECT)).join(direct.select(target).distinct(), target, "left_anti")
    return direct.unionByName(rest.select(direct.columns))


def _rows(edges: DataFrame, symbols: DataFrame, target: str, other: str) -> DataFrame:
    one = edges.groupBy(target, other).agg(F.max(F.when(F.col("reason") == L.DIRECT, 1).otherwise(0)).alias("direct"))
    reason = F.when(F.col("direct") == 1, L.DIRECT).otherwise(L.INFERRED)
    out = one.join(symbols, one[other] == symbols["usr"]).select(F.col(target).alias("target"), "usr", "name", "kind", "module", "language", "file_path", reason.alias("reason"))
    return out.withColumns({"confidence": L.confidence_of(F.col("reason")), "provenance": F.lit("symbolgraph")})


def callers(symbols: DataFrame, edges: DataFrame, targets: DataFrame | None = None, include_inferred: bool = False) -> DataFrame:
    """One row for each (target, caller); ``targets`` (usr) restricts the targets."""
    into = edges if targets is None else edges.join(targets.select(F.col("usr").alias("dst")), "dst", "left_semi")
    style = F.when(L.execution_boundary(F.col("name"), F.col("kind"), F.lit("")).isNotNull(), "async_or_callback_boundary").otherwise("synchronous_call")
    return _rows(evidence(into, "dst", include_inferred), symbols, "dst", "src").withColumn("call_style", style)


def callees(symbols: DataFrame, edges: DataFrame, sources: DataFrame | None = None, include_inferred: bool = False) -> DataFrame:
    """One row for each (target, callee), with the message role of Objective-C callees."""
    out = edges if sources is None else edges.join(sources.select(F.col("usr").alias("src")), "src", "left_semi")
    role = F.when(F.col("language") == "objc", L.message_role(F.col("name")))
    rows = _rows(evidence(out, "src", include_inferred), symbols, "src", "dst").withColumn("semantic_role", role)
    style = F.when(L.execution_boundary(F.col("name"), F.col("kind"), F.col("semantic_role")).isNotNull(), "async_or_callback_boundary").otherwise("synchronous_call")
    return rows.withColumn("call_style", style)


def references(symbols: DataFrame, edges: DataFrame, targets: DataFrame, include_inferred: bool = False) -> DataFrame:
    """Callers and callees of the targets in one table, told apart by ``direction``."""
    cols = ["target", "usr", "name", "kind", "module", "reason", "confidence"]
    return callers(symbols, edges, targets, include_inferred).select(F.lit("caller").alias("direction"), *cols).unionByName(
        callees(symbols, edges, targets, include_inferred).select(F.lit("callee").alias("direction"), *cols)
    )


def methods_of(symbols: DataFrame, contains: DataFrame, kinds: tuple[str, ...] = ("method",)) -> DataFrame:
    """(owner, usr, name): members of the given kinds (all kinds if none is given)."""
    inner = symbols if not kinds else symbols.where(F.col("kind").isin(*kinds))
    return contains.join(inner, contains["dst"] == inner["usr"]).select(F.col("src").alias("owner"), "usr", "name")


def callers_via_method(symbols: DataFrame, edges: DataFrame, methods: DataFrame, include_inferred: bool = False) -> DataFrame:
    """(owner, usr, via_method): callers of a type through its methods; the first method by name that a caller reaches."""
    found = callers(symbols, edges, methods, include_inferred).select("target", "usr")
    m = methods.select("owner", F.col("usr").alias("target"), F.col("name").alias("method"))
    return found.join(m, "target").groupBy("owner", "usr").agg(F.min(F.struct("method", "target")).alias("m")).select("owner", "usr", F.col("m.method").alias("via_method"))


def callees_by_method(symbols: DataFrame, edges: DataFrame, methods: DataFrame, first: int = 50, include_inferred: bool = False) -> DataFrame:
    """(owner, usr, calling_methods): callees of a type's first methods by name, with the sorted method names."""
    rank = F.row_number().over(W.partitionBy("owner").orderBy("name", "usr"))
    chosen = methods.withColumn("rank", rank).where(F.col("rank") <= first)
    m = chosen.select("owner", F.col("usr").alias("target"), F.col("name").alias("method"))
    found = callees(symbols, edges, chosen, include_inferred).select("target", "usr")
    return found.join(m, "target").groupBy("owner", "usr").agg(F.array_sort(F.collect_set("method")).alias("calling_methods"))


def owner_of(symbols: DataFrame, contains: DataFrame, extends: DataFrame | None = None) -> DataFrame:
    """(usr, owner_usr, owner_name, owner_kind): the containing type; of several the smallest id. An extension
    stands for the type it extends."""
    boxes = symbols.where(F.col("kind").isin(*L.TYPE_KINDS, "extension")).select(F.col("usr").alias("owner_usr"), F.col("name").alias("owner_name"), F.col("kind").alias("owner_kind"))
    inside = contains.join(boxes, contains["src"] == boxes["owner_usr"])
    own = inside.groupBy(F.col("dst").alias("usr")).agg(F.min(F.struct("owner_usr", "owner_name", "owner_kind")).alias("o")).select("usr", "o.*")
    if extends is None:
        return own
    to = extends.groupBy(F.col("src").alias("ext")).agg(F.min("dst").alias("real"))
    real = to.join(symbols, to["real"] == symbols["usr"]).select("ext", "real", F.col("name").alias("real_name"), F.col("kind").alias("real_kind"))
    both = own.join(real, (own["owner_kind"] == "extension") & (own["owner_usr"] == real["ext"]), "left")
    return both.select("usr", F.coalesce("real", "owner_usr").alias("owner_usr"), F.coalesce("real_name", "owner_name").alias("owner_name"), F.coalesce("real_kind", "owner_kind").alias("owner_kind"))


def drop_noise(rows: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(rows without noise symbols, one row with the number removed)."""
    noise = L.is_noise(F.col(name))
    return rows.where(~noise), rows.agg(F.coalesce(F.sum(noise.cast("long")), F.lit(0)).alias("removed"))


def grouped(rows: DataFrame, by: list[str], order: list[str], cap: int = 30) -> DataFrame:
    """``rows`` with the first ``cap`` of each group in order, the group's total and whether it was cut."""
    w = W.partitionBy(*by).orderBy(*order)
    total = rows.groupBy(*by).agg(F.count("*").alias("total"))
    first = rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= cap)
    return first.join(total, by).withColumn("truncated", F.col("total") > cap)


def capped(members: DataFrame, limit: int) -> DataFrame:
    """(owner, usr, name): members of owners in order of owner and name until ``limit`` are taken over all owners.

    Owners' counts are summed first, so the only global window is over one row an owner.
    """
    counts = members.groupBy("owner").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("owner").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < limit)
    place = F.row_number().over(W.partitionBy("owner").orderBy("name", "usr"))
    return members.join(before.select("owner", "before"), "owner").withColumn("place", place).where(F.col("before") + F.col("place") <= limit).select("owner", "usr", "name")
