"""Finding symbols: by key, by pattern, ranked, with automatic choice, and from stack frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import labels as L
from ..functions import parsing as P

#: Automatic choice and caps (fixed values).
AUTO_SCORE, AUTO_LEAD, CANDIDATES, SEARCH_LIMIT = 0.95, 0.10, 20, 20


def lookup(symbols: DataFrame, usr: str) -> DataFrame:
    return symbols.where(F.col("usr") == usr).orderBy("usr", "name").limit(1)


def matching(symbols: DataFrame, raw: str, module: str = "", kind: str = "", language: str = "", file: str = "") -> DataFrame:
    """Symbols whose whole name fits the pattern; the other arguments restrict only where they are given."""
    test = L.full_match(F.col("name"), raw)
    for column, value in (("module", module), ("kind", kind), ("language", language)):
        if value:
            test = test & (F.col(column) == value)
    return symbols.where(test & F.col("file_path").contains(file) if file else test)


def search(symbols: DataFrame, raw: str, limit: int = SEARCH_LIMIT, **restrict) -> DataFrame:
    return matching(symbols, raw, **restrict).orderBy("name", "usr").limit(limit)


def rank_keys(raw: str, module: str = "", language: str = "") -> list[Column]:
    """Sort keys of candidates: exact before case-insensitive before others, hints, prefix, then names."""
    name, first = F.col("name"), lambda test: F.when(test, 0).otherwise(1)
    exact = name == raw
    return [
        first(exact & F.lit("::" in raw)),
        first(exact),
        F.when(exact, 0).when(F.lower(name) == raw.lower(), 1).otherwise(2),
        first((F.col("module") == module) & F.lit(bool(module))),
        first((F.col("language") == language) & F.lit(bool(language))),
        first(name.startswith(raw)),
        F.coalesce("module", F.lit("")), F.coalesce("kind", F.lit("")), name, F.coalesce("usr", F.lit("")),
    ]


def ranked(symbols: DataFrame, raw: str, limit: int = SEARCH_LIMIT, module: str = "", language: str = "") -> DataFrame:
    """The first ``limit`` matches by name, in rank order, with their place from 1."""
    found = search(symbols, raw, limit)  # a bounded report: one window partition of at most ``limit`` rows
    return found.withColumn("place", F.row_number().over(W.orderBy(*rank_keys(raw, module, language))).cast("long"))


def resolve(candidates: DataFrame, file_hint: str = "", kind_hint: str = "", module_hint: str = "") -> DataFrame:
    """Scored candidates (the first 20 by name) with ``status``: found, if one stands out, else ambiguous."""
    few = candidates.orderBy("name", "usr").limit(CANDIDATES)
    scored = few.withColumn("score", L.candidate_score(F.col("kind"), F.col("file_path"), F.col("module"), file_hint, kind_hint, module_hint))
    order, everyone = W.orderBy(F.desc("score"), "name", "usr"), W.partitionBy()
    marked = scored.withColumns({"place": F.row_number().over(order).cast("long"), "n": F.count("*").over(everyone), "top": F.max("score").over(everyone), "second": F.max(F.lit(None).cast("double")).over(everyone)})
    marked = marked.withColumn("second", F.max(F.when(F.col("place") == 2, F.col("score"))).over(everyone))
    stands_out = (F.col("n") == 1) | ((F.col("top") >= AUTO_SCORE) & (F.col("top") - F.col("second") > AUTO_LEAD))
    return marked.withColumn("status", F.when(stands_out, "found").otherwise("ambiguous")).where((F.col("status") == "ambiguous") | (F.col("place") == 1)).select(*candidates.columns, "score", "place", "status")


def members_of_matching(symbols: DataFrame, contains: DataFrame, raw: str, limit: int = 50, kinds: tuple[str, ...] = ("class", "struct", "enum", "protocol")) -> DataFrame:
    """(owner, owner_name, usr, name): members of the types whose name fits, at most ``limit`` over all
    owners, owners by name first, members by name."""
    owners = matching(symbols.where(F.col("kind").isin(*kinds)), raw).select(F.col("usr").alias("owner"), F.col("name").alias("owner_name"))
    inner = symbols.select(F.col("usr").alias("dst"), "name")
    return contains.join(owners, contains["src"] == owners["owner"]).join(inner, "dst").select("owner", "owner_name", F.col("dst").alias("usr"), "name").orderBy("owner_name", "owner", "name", "usr").limit(limit)


def parse_frames(frames: DataFrame, column: str = "raw") -> DataFrame:
    """``frames`` with the parsed parts; all null where a text is no frame."""
    return frames.withColumn("f", P.frame(F.col(column))).select(*frames.columns, "f.*")


def resolve_frames(frames: DataFrame, symbols: DataFrame, column: str = "raw") -> DataFrame:
    """(raw, outcome, strategy, usr, score): the best symbol for each frame.

    Methods of that name score by container (100), expected owner id (90), owner in the id (20) and
    exact name (5); ties go to the smaller id.
    """
    parsed = frames.withColumn("f", P.frame(F.col(column)))
    s = symbols.select("usr", "name", "kind", F.coalesce("container_usr", F.lit("")).alias("box"))
    names = parsed.select("*", F.explode_outer(F.array_distinct(F.array("f.symbol", F.regexp_replace("f.symbol", r"\(.*$", "")))).alias("wanted"))
    owners = parsed.join(s, F.col("f.owner") == s["name"]).groupBy(column).agg(F.slice(F.array_sort(F.collect_set("usr")), 1, 5).alias("owners"))
    tried = names.join(owners, column, "left").join(s, F.col("wanted") == s["name"], "left")
    expected = P.expected_owners(F.col("f"))
    fits = F.exists(expected, lambda e: (F.col("box") == e) | F.col("usr").startswith(F.concat(e, F.lit("@"))) | F.col("usr").startswith(F.concat(e, F.lit("("))) | F.col("usr").startswith(F.concat(e, F.lit("."))))
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = (
        points(F.array_contains("owners", F.col("box")), 100) + points(fits, 90) + points(F.col("box").contains(F.col("f.owner")) | F.col("usr").contains(F.col("f.owner")), 20) + points(F.col("name") == F.col("f.symbol"), 5)
    )
    best = tried.withColumn("score", F.when(F.col("usr").isNotNull(), score)).groupBy(column).agg(F.min_by(F.struct("usr", "score", "f", "owners"), F.struct(-F.coalesce("score", F.lit(-1)), "usr")).alias("b"))
    outcome = F.when(F.col("b.f").isNull(), "parse_failed").when(F.col("b.usr").isNotNull(), F.when(F.col("b.score") >= 90, "match").otherwise("near_match")).when(F.col("b.owners").isNotNull(), "near_match").otherwise("no_match")
    strategy = F.when(F.col("b.usr").isNotNull() & F.col("b.owners").isNotNull(), "owner_symbol_fallback").when(F.col("b.usr").isNotNull(), "direct_symbol").when(F.col("b.owners").isNotNull(), "owner_only").otherwise("unresolved")
    return best.select(column, outcome.alias("outcome"), strategy.alias("strategy"), "b.usr", "b.score")
