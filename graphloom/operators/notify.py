"""Notifications and callbacks: who posts, who observes, and what a source line wires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P


def by_notification(posts: DataFrame, observes: DataFrame) -> DataFrame:
    """(name, posters, observers): distinct sorted ids; a side without any is an empty array."""
    p = posts.groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("posters"))
    o = observes.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("observers"))
    none = F.array().cast("array<string>")
    return p.join(o, "name", "full").select("name", F.coalesce("posters", none).alias("posters"), F.coalesce("observers", none).alias("observers"))


def by_observer(observes: DataFrame) -> DataFrame:
    """(usr, registrations): the sorted notifications of each observer."""
    return observes.groupBy(F.col("dst").alias("usr")).agg(F.array_sort(F.collect_set("src")).alias("registrations"))


def observer_only(posts: DataFrame, observes: DataFrame) -> DataFrame:
    """(name, observers): notifications that nobody posts."""
    return observes.join(posts.select(F.col("dst").alias("src")), "src", "left_anti").groupBy(F.col("src").alias("name")).agg(F.countDistinct("dst").alias("observers"))


def callback_hints(posts: DataFrame, observes: DataFrame) -> DataFrame:
    """(usr, notification, posters): for each callback, who may trigger it and through what."""
    p = posts.select(F.col("dst").alias("notification"), F.col("src").alias("poster"))
    o = observes.select(F.col("src").alias("notification"), F.col("dst").alias("usr"))
    n = p.groupBy("notification").agg(F.countDistinct("poster").alias("posters"))
    return o.join(n, "notification", "left").select("usr", "notification", F.coalesce("posters", F.lit(0)).alias("posters")).distinct()


def wiring(blocks: DataFrame) -> DataFrame:
    """(path, line, role, selector, name, control_event) of source blocks (path, line, text) that wire callbacks."""
    text = F.col("text")
    found = blocks.select("path", "line", P.observer_line(text).alias("o"), P.post_line(text).alias("p"), P.target_action_line(text).alias("t"))
    none = F.lit(None).cast("string")
    observers = found.where("o is not null and o.name <> 'unknown'").select("path", "line", F.lit("observes").alias("role"), "o.selector", "o.name", none.alias("control_event"))
    posters = found.where("p is not null and p <> 'unknown'").select("path", "line", F.lit("posts").alias("role"), none.alias("selector"), F.col("p").alias("name"), none.alias("control_event"))
    actions = found.where("t.selector is not null").select("path", "line", F.lit("target_action").alias("role"), "t.selector", none.alias("name"), "t.control_event")
    return observers.unionByName(posters).unionByName(actions)


def resolve_callbacks(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """``found`` with callback_usr: the symbol of that selector in that file; the smallest id of several."""
    own = symbols.groupBy(F.col("file_path").alias("path"), F.col("name").alias("selector")).agg(F.min("usr").alias("callback_usr"))
    return found.join(own, ["path", "selector"], "left")


def target_actions(bindings: DataFrame, selector: str = "", callback: str = "", file: str = "", group_by: str = "callback_usr") -> DataFrame:
    """(key, bindings): bindings that fit, grouped by callback_usr or by path (the registrar)."""
    test = F.col("role") == "target_action"
    if selector:
        test = test & (F.col("selector") == selector)
    if callback:
        test = test & (F.col("callback_usr") == callback)
    if file:
        test = test & F.col("path").contains(file)
    return bindings.where(test).groupBy(F.col(group_by).alias("key")).agg(F.array_sort(F.collect_set(F.struct("path", "line", "selector", "control_event", "callback_usr"))).alias("bindings"))
