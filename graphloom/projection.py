"""A property graph over the star-schema tables: parts call parts, suppliers own them, customers, nations
and regions form a type hierarchy, users post and observe events, documents are chunks of text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _symbol(usr: Column, name: Column, kind, module, language, path, container=None) -> list[Column]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return [usr.alias("usr"), name.alias("name"), lit(kind).alias("kind"), lit(module).alias("module"), lit(language).alias("language"), lit(path).alias("file_path"), lit(container).alias("container_usr")]


def usr(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


@dataclass(frozen=True)
class Projection:
    """Graph tables of one input folder, built lazily."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def symbols(self) -> DataFrame:
        language = F.when(F.col("p_size") % 3 == 0, "swift").when(F.col("p_size") % 3 == 1, "objc").otherwise("c")
        path = F.concat(F.lit("/ws/"), F.col("p_brand"), F.lit("/"), F.col("p_name"))
        parts = self.table("part").select(*_symbol(usr("p", "p_partkey"), F.col("p_name"), F.lower("p_type"), F.col("p_brand"), language, path))
        boxes = self.table("supplier").select(*_symbol(usr("s", "s_suppkey"), F.col("s_name"), "class", "supply", "swift", "/ws/supply"))
        kinds = self.table("customer").select(*_symbol(usr("c", "c_custkey"), F.col("c_name"), "struct", F.col("c_mktsegment"), "swift", "/ws/customer"))
        return parts.unionByName(boxes).unionByName(kinds).unionByName(self.types)

    @cached_property
    def types(self) -> DataFrame:
        nations = self.table("nation").select(*_symbol(usr("n", "n_nationkey"), F.col("n_name"), "class", "geo", "objc", None))
        regions = self.table("region").select(*_symbol(usr("r", "r_regionkey"), F.col("r_name"), "protocol", "geo", "objc", None))
        return nations.unionByName(regions)

    @cached_property
    def calls(self) -> DataFrame:
        """(src, dst, reason, confidence): consecutive large lines of one order."""
        big = self.table("lineitem").where("l_quantity >= 40").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_discount")
        a, b = big.alias("a"), big.alias("b")
        pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1) & (F.col("a.l_partkey") != F.col("b.l_partkey")))
        flag = F.col("a.l_returnflag")
        grouped = pairs.groupBy(usr("p", "a.l_partkey").alias("src"), usr("p", "b.l_partkey").alias("dst")).agg(
            F.max(F.when(flag == "N", 1).otherwise(0)).alias("n"), F.max(F.when(flag == "R", 1).otherwise(0)).alias("r"), F.max("a.l_discount").alias("d")
        )
        return grouped.select("src", "dst", F.when(F.col("n") == 1, "source_direct").when(F.col("r") == 1, "indexstore_relation_only").alias("reason"), F.round(1 - F.col("d"), 6).alias("confidence"))

    @cached_property
    def contains(self) -> DataFrame:
        owner = self.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
        return owner.select(usr("s", "s").alias("src"), usr("p", "l_partkey").alias("dst"))

    @cached_property
    def hierarchy(self) -> DataFrame:
        """(src, dst, rel_type): a subtype and what it derives from."""
        up = self.table("customer").select(usr("c", "c_custkey").alias("src"), usr("n", "c_nationkey").alias("dst"), F.lit("Inherits").alias("rel_type"))
        return up.unionByName(self.table("nation").select(usr("n", "n_nationkey").alias("src"), usr("r", "n_regionkey").alias("dst"), F.lit("ConformsTo").alias("rel_type")))

    @cached_property
    def posts(self) -> DataFrame:
        return self.table("events").select(usr("u", "user_id").alias("src"), F.col("event_type").alias("dst")).distinct()

    @cached_property
    def observes(self) -> DataFrame:
        """Users whose events of a type went over 150 observe the type."""
        return self.table("events").where("value > 150").select(F.col("event_type").alias("src"), usr("u", "user_id").alias("dst")).distinct()

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.table("orders").select(usr("b", "o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_orderpriority").alias("toolchain_id"), F.col("o_orderstatus").alias("build_config_hash"))

    @cached_property
    def chunks(self) -> DataFrame:
        return self.table("documents").select(usr("d", "doc_id").alias("id"), usr("d", "doc_id").alias("owner_usr"), F.col("text").alias("content"))


#: The same graph in DuckDB SQL, for a WITH clause.
SQL = """
symbols AS (
  SELECT 'p:' || p_partkey AS usr, p_name AS name, lower(p_type) AS kind, p_brand AS module,
         CASE p_size % 3 WHEN 0 THEN 'swift' WHEN 1 THEN 'objc' ELSE 'c' END AS language,
         '/ws/' || p_brand || '/' || p_name AS file_path FROM part
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'class', 'supply', 'swift', '/ws/supply' FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, c_name, 'struct', c_mktsegment, 'swift', '/ws/customer' FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'class', 'geo', 'objc', NULL FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, r_name, 'protocol', 'geo', 'objc', NULL FROM region),
calls AS (
  SELECT 'p:' || a.l_partkey AS src, 'p:' || b.l_partkey AS dst,
         CASE WHEN max((a.l_returnflag = 'N')::int) = 1 THEN 'source_direct'
              WHEN max((a.l_returnflag = 'R')::int) = 1 THEN 'indexstore_relation_only' END AS reason,
         round(1 - max(a.l_discount), 6) AS confidence
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
       AND a.l_partkey <> b.l_partkey
  WHERE a.l_quantity >= 40 AND b.l_quantity >= 40 GROUP BY 1, 2),
contains AS (
  SELECT 's:' || min(l_suppkey) AS src, 'p:' || l_partkey AS dst FROM lineitem GROUP BY l_partkey),
hierarchy AS (
  SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'Inherits' AS rel_type FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'ConformsTo' FROM nation),
posts AS (SELECT DISTINCT 'u:' || user_id AS src, event_type AS dst FROM events),
observes AS (SELECT DISTINCT event_type AS src, 'u:' || user_id AS dst FROM events WHERE value > 150),
snapshots AS (
  SELECT 'b:' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created_at,
         o_orderpriority AS toolchain_id, o_orderstatus AS build_config_hash FROM orders)
"""
