"""Derived edges: cross-language bridges, view trees, navigation, overrides and chunks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import parsing as P
from ..runtime import cut


#: Columns that two symbols must have equal, by rule; any rule makes a bridge.
BRIDGE_KEYS = [["full"], ["k_box", "k_member", "k_arity", "k_kind"], ["name", "kind"]]


def _bridge_sides(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usr, dir, full, k_box, k_member, k_arity, k_kind, name, kind) of the Swift and of the Objective-C symbols."""
    extra = [F.lit(None).cast("string").alias(c) for c in ("swift_display_name", "signature") if c not in symbols.columns]
    base = symbols.select("*", *extra)
    swift = base.where("language = 'swift'").select("usr", "name", "kind", P.directory(F.col("file_path")).alias("dir"), P.swift_names(F.col("usr"), F.col("name"), F.col("swift_display_name"), F.col("signature"), F.col("kind")).alias("x"))
    objc = base.where("language = 'objc'").select("usr", "name", "kind", P.directory(F.col("file_path")).alias("dir"), P.objc_names(F.col("usr")).alias("x"))
    key = lambda box, member, arity: [F.lower(F.coalesce(box, F.lit(""))).alias("k_box"), F.lower(member).alias("k_member"), F.greatest(arity, F.lit(0)).alias("k_arity"), P.kind_group(F.col("kind")).alias("k_kind")]
    s = swift.select("usr", "dir", F.col("x.swift_name").alias("full"), *key(F.col("x.container"), F.col("x.member"), F.col("x.arity")), "name", "kind")
    o = objc.select("usr", "dir", F.col("x.swift_name").alias("full"), *key(F.col("x.container"), F.coalesce("x.member", "name"), F.coalesce("x.arity", F.lit(0))), "name", "kind")
    return s, o


def _by_rule(s: DataFrame, o: DataFrame) -> list[DataFrame]:
    """The joins of two sides, whose columns become s_ and o_, by each rule."""
    s, o = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for df, p in ((s, "s"), (o, "o")))
    return [s.join(o, reduce(lambda x, y: x & y, [F.col(f"s_{k}") == F.col(f"o_{k}") for k in rule])) for rule in BRIDGE_KEYS]


def bridge_pairs(symbols: DataFrame) -> DataFrame:
    """(swift_usr, objc_usr, bridge_kind, confidence): Swift and Objective-C symbols that are one thing.

    Equal projected names 0.95; equal (container, member, arity, kind group) 0.85 in one directory, else
    0.82; equal name and kind 0.85 in one directory (as a correlated id), and 0.70 by name alone. The
    highest confidence of a pair stays. Three equi-joins, no cross product.
    """
    same_dir = F.col("s_dir") == F.col("o_dir")
    made = lambda df, kind, conf: df.select(F.col("s_usr").alias("swift_usr"), F.col("o_usr").alias("objc_usr"), F.lit(kind).alias("bridge_kind"), conf.alias("confidence"))
    by_name, by_key, by_both = _by_rule(*_bridge_sides(symbols))
    union = made(by_name, "usr_correlate", F.lit(0.95)).unionByName(made(by_key, "usr_correlate", F.when(same_dir, 0.85).otherwise(0.82)))
    union = union.unionByName(made(by_both, "usr_correlate", F.when(same_dir, 0.85))).unionByName(made(by_both, "name_match", F.lit(0.70))).where("confidence is not null")
    best = F.max_by(F.struct("bridge_kind", "confidence"), F.struct("confidence", F.col("bridge_kind")))
    return union.groupBy("swift_usr", "objc_usr").agg(best.alias("b")).select("swift_usr", "objc_usr", "b.bridge_kind", "b.confidence")


def _partners(asked: DataFrame, others: DataFrame) -> DataFrame:
    """(usr, n): how many rows of ``others`` fit a row of ``asked`` by any rule, by inclusion and exclusion of rules."""
    keys = [k for rule in BRIDGE_KEYS for k in rule]
    sets = [[k for rule in some for k in rule] for n in range(1, len(BRIDGE_KEYS) + 1) for some in combinations(BRIDGE_KEYS, n)]
    signs = [(-1) ** (n + 1) for n in range(1, len(BRIDGE_KEYS) + 1) for _ in combinations(BRIDGE_KEYS, n)]
    masked = lambda i, some: F.struct(F.lit(i).alias("set"), *[F.when(F.lit(k in some), F.col(k)).alias(k) for k in keys])
    known = lambda some: reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in some])
    spread = F.explode(F.array_compact(F.array(*[F.when(known(some), masked(i, some)) for i, some in enumerate(sets)]))).alias("at")
    held = others.groupBy(*keys).agg(F.count("*").alias("n")).select("n", spread).groupBy("at").agg(F.sum("n").alias("n"))
    wanted = asked.select(*keys).distinct().select(F.struct(*keys).alias("row"), spread)
    signed = F.get(F.array(*[F.lit(s) for s in signs]), F.col("at.set")) * F.col("n")
    found = wanted.join(held, "at").groupBy("row").agg(F.sum(signed).alias("n"))
    return asked.select("usr", F.struct(*keys).alias("row")).join(found, "row").select("usr", "n")


def bridge_counts(symbols: DataFrame) -> DataFrame:
    """(usr, bridges): with how many symbols ``bridge_pairs`` pairs each, for those that have any.

    No pair is made: the symbols that have each rule's columns equal are counted as a group, so a name that
    thousands share costs no more than its symbols. Only ids that stand on several different rows, which a
    snapshot has none of, go by pairs. Repeated rows count once; a null id is no symbol.
    """
    keys = [k for rule in BRIDGE_KEYS for k in rule]
    s, o = (df.select("usr", F.struct(F.lit(swift).alias("swift"), *keys).alias("x")) for df, swift in zip(_bridge_sides(symbols), (True, False)))
    by_usr = cut(s.unionByName(o).where("usr is not null").groupBy("usr").agg(F.collect_set("x").alias("x")))  # eight readers
    once, often = (by_usr.where(c).select("usr", F.inline("x")) for c in ("size(x) = 1", "size(x) > 1"))
    s1, o1, s2, o2 = (df.where(F.col("swift") == swift).drop("swift") for df in (once, often) for swift in (True, False))
    rest = _by_rule(s2, o1.unionByName(o2)) + _by_rule(s1, o2)
    pairs = reduce(DataFrame.unionByName, [df.select("s_usr", "o_usr") for df in rest])
    ways = pairs.toDF("usr", "other").unionByName(pairs.toDF("other", "usr")).distinct()
    counts = _partners(s1, o1).unionByName(_partners(o1, s1)).unionByName(ways.groupBy("usr").agg(F.count("*").alias("n")))
    return counts.groupBy("usr").agg(F.sum("n").cast("long").alias("bridges"))


def bridge_edges(pairs: DataFrame) -> DataFrame:
    """BridgesTo edges, both directions."""
    cols = ["bridge_kind", "confidence"]
    return pairs.select(F.col("swift_usr").alias("src"), F.col("objc_usr").alias("dst"), *cols).unionByName(pairs.select(F.col("objc_usr").alias("src"), F.col("swift_usr").alias("dst"), *cols))


def bridges_of(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(usr, other, other_name, bridge_kind, confidence): bridges seen from either end."""
    both = edges.select(F.col("src").alias("usr"), F.col("dst").alias("other"), "bridge_kind", "confidence").unionByName(edges.select(F.col("dst").alias("usr"), F.col("src").alias("other"), "bridge_kind", "confidence")).distinct()
    return both.join(symbols.select(F.col("usr").alias("other"), F.col("name").alias("other_name")), "other").select("usr", "other", "other_name", "bridge_kind", "confidence")


def view_tree(views: DataFrame, bodies: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst): a view whose body calls another view. ``views`` has usr; ``bodies`` usr, owner (a view)."""
    v = views.select(F.col("usr").alias("dst"))
    return calls.join(bodies.select(F.col("usr").alias("src"), F.col("owner")), "src").join(v, "dst", "left_semi").where("owner <> dst").select(F.col("owner").alias("src"), "dst").distinct()


def body_owners(bodies: DataFrame, views: DataFrame) -> DataFrame:
    """(usr, owner): the view whose id is the longest prefix of a body's id, or the other way round.

    One side's id is spread to its prefixes and joined to the other's whole id, so both are equi-joins.
    """
    prefixes = lambda df, c: df.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), F.lit(1), i))).alias("k"))
    b, v = bodies.select("usr").where("usr <> ''"), views.select(F.col("usr").alias("owner")).where("owner <> ''")
    inside = prefixes(b, "usr").join(v, F.col("k") == F.col("owner")).select("usr", "owner")
    around = prefixes(v, "owner").join(b, F.col("k") == F.col("usr")).select("usr", "owner")
    return inside.unionByName(around).groupBy("usr").agg(F.max_by("owner", F.struct(F.length("owner"), F.col("owner"))).alias("owner"))


def navigation(owners: DataFrame, views: DataFrame, within_module: bool = False) -> DataFrame:
    """(src, dst): from each view that navigates to every other view (of its module, if asked for).

    The full relation is a product by definition; ``within_module`` makes it an equi-join. The ids of a product
    are made distinct before it, so its rows, as many as views squared, are never shuffled; the views are broadcast.
    """
    v, o = views.select(F.col("usr").alias("dst"), "module"), owners.select(F.col("usr").alias("src"), "module")
    if within_module:
        return o.join(v, "module").where("src <> dst").select("src", "dst").distinct()
    parts = int(owners.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else few ids end up in one task
    return o.select("src").repartition(parts, "src").distinct().join(F.broadcast(v.select("dst").distinct()), F.col("src") != F.col("dst"))


def overrides(symbols: DataFrame, contains: DataFrame, inherits: DataFrame) -> DataFrame:
    """(src, dst): a member and the member of the same name of a supertype of its type."""
    m = contains.join(symbols.select(F.col("usr").alias("dst"), "name"), "dst").select(F.col("src").alias("box"), F.col("dst").alias("usr"), "name")
    below, above = m.select(F.col("box").alias("src_box"), F.col("usr").alias("src"), "name"), m.select(F.col("box").alias("dst_box"), F.col("usr").alias("dst"), "name")
    up = inherits.select(F.col("src").alias("src_box"), F.col("dst").alias("dst_box"))
    return below.join(up, "src_box").join(above, ["dst_box", "name"]).select("src", "dst").distinct()


def chunks(symbols: DataFrame, scope: str = "") -> DataFrame:
    """One text unit for each symbol: id, owner_usr, chunk_kind, content. The id holds no running number, so
    it needs no global order and is the same in every run."""
    kind = L.chunk_kind(F.col("kind"))
    signature = F.col("signature") if "signature" in symbols.columns else F.lit(None).cast("string")
    return symbols.select(F.concat_ws(":", F.lit(scope), "usr", F.lit("chunk"), kind).alias("id"), F.col("usr").alias("owner_usr"), kind.alias("chunk_kind"), L.chunk_text(F.col("kind"), F.col("name"), signature).alias("content"))
