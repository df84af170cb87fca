"""Shards as runs of a Hilbert curve over quantised metadata.

Metadata dimensions are cut at their quantiles into 2**bits steps; the cell's place on the Hilbert curve
orders the rows, so rows near on the curve are near in every dimension and the shards' files can be
pruned by several dimensions at once. Rows of equal texts share their group's metadata and stand side by
side. The sorted rows are cut into runs whose counts differ by one at most (law ``rows``).

The global rank needs no single task: rows are dealt by range, the range partitions are checkpointed, and
a row's rank is the rows of the partitions before it plus its place in its own. A group of equal texts
that is larger than a partition is split by a hash of its ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import PRE, cut, join_groups

SHARDS, BITS = 24, 5
#: Distinct values of a text dimension from which its cuts are made, the most frequent of all rows.
TOP_VALUES = 4096


def hilbert_index(coords: Column, dims: int, bits: int) -> Column:
    """Place on the Hilbert curve of an array of ``dims`` coordinates of ``bits`` bits each.

    Skilling's transform, every step a fold over one array, so that the expression stays small.
    """
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)])

    def undo(x: Column, s: Column) -> Column:
        low, first, own = s["q"] - 1, F.get(x, F.lit(0)), F.get(x, s["i"])
        hit = own.bitwiseAND(s["q"]) != 0
        t = F.when(hit, 0).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
        return F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(F.when(hit, low).otherwise(t))).when(j == s["i"], v.bitwiseXOR(t)).otherwise(v))

    x = F.aggregate(steps, coords, undo) if bits > 1 else coords
    gray = F.aggregate(
        F.sequence(F.lit(1), F.lit(dims - 1)), x, lambda x, i: F.transform(x, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v))
    ) if dims > 1 else x
    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    flip = lambda x: F.aggregate(levels, F.lit(0), lambda t, q: F.when(F.get(x, F.lit(dims - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])

    def interleave(x: Column) -> Column:
        masks = F.array(*[F.lit(1 << b) for b in range(bits)])
        bit = lambda p: F.get(x, p["i"]).bitwiseAND(F.get(masks, p["b"])) != 0
        return F.aggregate(places, F.lit(0).cast("long"), lambda n, p: n * 2 + F.when(bit(p), 1).otherwise(0).cast("long"))

    done = F.element_at(F.transform(F.array(gray), lambda x: F.transform(x, lambda v: v.bitwiseXOR(flip(x)))), 1)
    return F.element_at(F.transform(F.array(done), interleave), 1)


def curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """(cell, hilbert) for all 2**(dims * bits) cells; the cell packs the coordinates, first dimension highest."""
    if dims * bits > 18:
        raise ValueError("a curve has at most 2**18 cells")
    part = [F.floor(F.col("id") / (1 << bits * (dims - 1 - i))).cast("long") % (1 << bits) for i in range(dims)]
    return spark.range(1 << dims * bits).select(F.col("id").alias("cell"), hilbert_index(F.array(*[c.cast("int") for c in part]), dims, bits).alias("hilbert"))


def _number(c: Column) -> Column:
    """An order-preserving number; null comes first."""
    return F.coalesce(c.cast("double"), F.lit(float("-inf")))


def _text_cuts(groups: DataFrame, name: str, bits: int) -> list[str]:
    """At most 2**bits - 1 texts that cut the rows evenly, from the TOP_VALUES most frequent values of all rows."""
    top = groups.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(TOP_VALUES).collect()
    values = sorted((r[name].encode("utf-8", "surrogatepass"), r[name], r["n"]) for r in top)  # the order of Spark's strings
    if len(values) < 1 << bits:
        return [v for _, v, _ in values]
    total, seen, cuts = sum(n for _, _, n in values), 0, []
    for _, v, n in values:
        seen += n
        if seen * (1 << bits) >= (len(cuts) + 1) * total and len(cuts) < (1 << bits) - 1:
            cuts.append(v)
    return cuts


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert for every row of ``docs``.

    size is the text's UTF-8 bytes (null: none) plus 8 and is itself a dimension of the curve beside
    ``dims``; a dimension that is missing or null counts as the smallest value. Ties on the curve are
    ordered by text, then id. Repeated rows and null ids are rows like any other; extra columns are not
    read; an empty table gives no rows. grown_shard is null under the law ``rows``.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    texts = [kinds.get(d) == "string" for d in dims]
    keys = [(docs[d] if t else _number(docs[d])) if d in kinds else F.lit(-1.0) for d, t in zip(dims, texts)]
    names = [f"{PRE}{i}" for i in range(len(dims))]
    size = (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 8).cast("long")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_key"), *[k.alias(n) for k, n in zip(keys, names)],
    )
    groups = rows.groupBy("text_key").agg(F.min("size").alias("size"), F.count("*").alias("n"), *[F.min(n).alias(n) for n in names])
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = ["size", *[n for n, t in zip(names, texts) if not t]]
    first = groups.agg(*[F.percentile_approx(n, share, 10000).alias(n) for n in numbers]).first()
    cuts = {n: sorted(set(first[n] or [])) for n in numbers} | {n: _text_cuts(groups, n, bits) for n, t in zip(names, texts) if t}
    above = lambda n, v: F.coalesce(F.col(n) > F.lit(v), F.lit(False)) if n in numbers else F.coalesce(F.col(n) >= F.lit(v), F.lit(False))
    steps = [sum((above(n, v).cast("int") for v in cuts[n]), F.lit(0)) for n in ("size", *names)]
    total = len(steps)
    cell = sum((s.cast("long") * (1 << bits * (total - 1 - i)) for i, s in enumerate(steps)), F.lit(0).cast("long"))
    placed = groups.withColumn("cell", cell).join(F.broadcast(curve(spark, total, bits)), "cell").select("text_key", "n", "hilbert")
    order = ["hilbert", "text_key", "size", "spread", "doc_id"]
    slim = rows.select("doc_id", "size", "text_crc32", "text_key", F.xxhash64("doc_id").alias("spread"))
    laid = join_groups(slim, cut(placed), "text_key", "n", ["doc_id"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(laid.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "hilbert"))
    # ids of a checkpoint's rows: the partition above bit 33, the place in it below
    rows = laid.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total_rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    shard = F.expr(f"rank * {shards} div {max(total_rows, 1)}")
    first = F.expr(f"(shard * {total_rows}L + {shards - 1}) div {shards}")
    ranked = rows.join(F.broadcast(before), "part").select("doc_id", "size", "text_crc32", "hilbert", rank.alias("rank")).withColumn("shard", shard)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
