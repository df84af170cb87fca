"""Requests, response envelopes and the commands over a graph.

Every command is a function of an ``Engine`` and a request that builds DataFrames; rows are collected once,
for the final report, which every command bounds by its nature or by a limit of the request.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import calls as C
from ..operators import derive, flows, modules, notify, rank, rename, search
from ..operators import traverse as T

OUTCOMES, COVERAGES, FRESHNESS = ("match", "ambiguous", "near_match", "no_match", "parse_failed"), ("indexed", "partial", "unknown"), ("fresh", "stale", "partially_stale", "unknown")


@dataclass
class Request:
    """Fields of all commands; each reads those it needs."""

    usr: str = ""
    name: str = ""
    kind: str = ""
    module: str = ""
    language: str = ""
    file_path: str = ""
    build_id: str = ""
    depth: int = 1
    max_depth: int = T.IMPACT_DEPTH
    relation_types: tuple[str, ...] = ("Calls",)
    include_inferred: bool = False
    include_noise: bool = False
    include_details: bool = True
    limit: int = search.SEARCH_LIMIT
    query: str = ""
    top_k: int = 10
    notification_name: str = ""
    group_by: str = ""
    selector: str = ""
    callback_usr: str = ""
    new_name: str = ""
    dry_run: bool = True

    @classmethod
    def of(cls, args: dict) -> "Request":
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in args.items() if k in known})


@dataclass
class Response:
    data: object
    freshness: str = "unknown"
    evidence: list = field(default_factory=list)
    open_gaps: list[str] = field(default_factory=list)
    hints: list = field(default_factory=list)
    filtered_noise: int = 0

    def to_json(self) -> str:
        return json.dumps(self.__dict__, default=str, ensure_ascii=False, sort_keys=True)


@dataclass
class SearchStatus:
    outcome: str
    coverage: str = "indexed"
    freshness: str = "unknown"

    def __post_init__(self):
        for value, known in ((self.outcome, OUTCOMES), (self.coverage, COVERAGES), (self.freshness, FRESHNESS)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Engine:
    """Commands over node and edge tables: a GraphStore, or anything with ``nodes`` and ``edges``."""

    def __init__(self, store):
        self.store, self.spark = store, store.spark

    @cached_property
    def symbols(self) -> DataFrame:
        return self.store.nodes("Symbol")

    def edges(self, *kinds: str) -> DataFrame:
        return self.store.edges(*kinds)

    def _one(self, usr: str) -> DataFrame:
        return self.spark.createDataFrame([(usr,)], "usr string")

    def freshness(self, build_id: str = "") -> str:
        snaps = self.store.nodes("BuildSnapshot")
        found = (snaps.where(F.col("id") == build_id) if build_id else snaps).limit(1).count()
        return "fresh" if found else "stale"

    def latest_build(self) -> str | None:
        row = self.store.nodes("BuildSnapshot").agg(F.max_by("id", F.struct("created_at", "id")).alias("id")).first()
        return row["id"]

    def _targets(self, req: Request, first: int | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(usr) to expand, and the methods if the symbol is a type."""
        seed = self._one(req.usr)
        is_type = self.symbols.where((F.col("usr") == req.usr) & F.col("kind").isin(*L.TYPE_KINDS)).limit(1).count()
        if not is_type:
            return seed, None
        methods = C.methods_of(self.symbols, self.edges("Contains")).where(F.col("owner") == req.usr)
        return (methods if first is None else methods.orderBy("name", "usr").limit(first)), methods

    def _quiet(self, df: DataFrame, req: Request) -> tuple[DataFrame, int]:
        if req.include_noise:
            return df, 0
        kept, removed = C.drop_noise(df)
        return kept, removed.first()["removed"]

    def callers(self, req: Request) -> Response:
        edges = self.edges(*req.relation_types)
        if req.depth > 1:
            found = T.bfs(C.evidence(edges, "dst", req.include_inferred), self._one(req.usr), req.depth, reverse=True)
            df = found.join(self.symbols, found["id"] == self.symbols["usr"]).select("usr", "name", "kind", "module", "depth")
        else:
            targets, methods = self._targets(req)
            df = C.callers(self.symbols, edges, targets, req.include_inferred).drop("target").dropDuplicates(["usr"])
            if methods is not None:
                df = df.join(C.callers_via_method(self.symbols, edges, methods, req.include_inferred).select("usr", "via_method"), "usr", "left")
        df, removed = self._quiet(df, req)
        data = rows(df.orderBy("name", "usr"))
        hints = [] if data else rows(self.store.edges("Observes").where(F.col("dst") == req.usr).select(F.col("src").alias("notification")).distinct())
        return Response({"callers": data}, self.freshness(req.build_id), hints=hints, filtered_noise=removed)

    def callees(self, req: Request) -> Response:
        edges = self.edges(*req.relation_types)
        if req.depth > 1:
            found = T.bfs(C.evidence(edges, "src", req.include_inferred), self._one(req.usr), req.depth)
            df = found.join(self.symbols, found["id"] == self.symbols["usr"]).select("usr", "name", "kind", "module", "depth")
        else:
            targets, methods = self._targets(req, first=50)
            df = C.callees(self.symbols, edges, targets, req.include_inferred).drop("target").dropDuplicates(["usr"])
            if methods is not None:
                df = df.join(C.callees_by_method(self.symbols, edges, methods, include_inferred=req.include_inferred).select("usr", "calling_methods"), "usr", "left")
        df, removed = self._quiet(df, req)
        return Response({"callees": rows(df.orderBy("name", "usr"))}, self.freshness(req.build_id), filtered_noise=removed)

    def references(self, req: Request) -> Response:
        return Response({"references": rows(C.references(self.symbols, self.edges("Calls"), self._one(req.usr), req.include_inferred).orderBy("direction", "usr"))}, self.freshness(req.build_id))

    def impact(self, req: Request) -> Response:
        found = T.impact(self.edges(*T.IMPACT_RELATIONS), self.edges(*T.SUBTYPE_RELATIONS), self._one(req.usr), req.max_depth)
        status = self.freshness(req.build_id)
        named = found.join(self.symbols.select(F.col("usr").alias("id"), "name", "kind", "module"), "id", "left")
        depths: dict[str, list] = {}
        for r in rows(named.orderBy("depth", "id")):
            depths.setdefault(f"d{r['depth']}", []).append({k: v for k, v in r.items() if k not in ("seed", "depth")})
        summary = rows(T.impact_summary(found, self.symbols, self._one(req.usr), status == "fresh"))[0]
        return Response({"depths": depths, "summary": summary, "risk": summary["risk"]}, status)

    def symbol(self, req: Request) -> Response:
        own = rows(search.lookup(self.symbols, req.usr))
        owner = rows(C.owner_of(self.symbols, self.edges("Contains"), self.edges("Extends")).where(F.col("usr") == req.usr))
        return Response({"symbol": own[0] if own else None, "owner": owner[0] if owner else None}, self.freshness(req.build_id))

    def hierarchy(self, req: Request) -> Response:
        found: dict[str, list] = {"parent": [], "protocol": [], "child": []}
        for r in rows(T.hierarchy(self.symbols, self.edges("Inherits", "ConformsTo"), self._one(req.usr)).orderBy("role", "usr")):
            found[r.pop("role")].append(r)
        return Response(found, self.freshness(req.build_id))

    def search(self, req: Request) -> Response:
        kind = "frame" if "::" in req.name and "(" in req.name and ")" in req.name else "qualified_symbol" if "::" in req.name else "symbol"
        if kind == "frame":
            return self.frame(req)
        found = search.search(self.symbols, req.name, req.limit, module=req.module, kind=req.kind, language=req.language, file=req.file_path)
        hits = rows(found.orderBy(*search.rank_keys(req.name, req.module, req.language)))
        outcome = "match" if len(hits) == 1 else "ambiguous" if hits else "no_match"
        status = SearchStatus(outcome, freshness=self.freshness(req.build_id))
        actions = [{"tool": "refresh", "args": {}}] if status.freshness in ("stale", "unknown") else []
        return Response({"outcome": outcome, "matches": hits[:5], "candidates": hits[:3] if outcome == "ambiguous" else []}, status.freshness, hints=actions[:3])

    def class_search(self, req: Request) -> Response:
        return Response({"methods": rows(search.members_of_matching(self.symbols, self.edges("Contains"), req.name, req.limit))}, self.freshness(req.build_id))

    def frame(self, req: Request) -> Response:
        raw = self.spark.createDataFrame([(req.name,)], "raw string")
        best = rows(search.resolve_frames(raw, self.symbols))[0]
        near = self.callers(Request(usr=best["usr"])).data["callers"][:10] if best["usr"] else []
        return Response({**best, "callers": near}, self.freshness(req.build_id))

    def context(self, req: Request) -> Response:
        if req.usr:
            hits = rows(search.lookup(self.symbols, req.usr))
            status = "found" if hits else "not_found"
        else:
            found = self.symbols.where(L.full_match(F.col("name"), req.name)).orderBy("name", "usr").limit(25)
            hits = rows(search.resolve(found, req.file_path, req.kind, req.module).orderBy("place"))
            status = hits[0]["status"] if hits else "not_found"
        if status != "found":
            return Response({"status": status, "candidates": hits}, self.freshness(req.build_id))
        usr, gaps, parts = hits[0]["usr"], [], {}
        for part in (self.callers, self.callees, self.hierarchy):
            try:
                parts[part.__name__] = part(Request(usr=usr)).data
            except Exception as e:  # one part that fails leaves the others
                gaps.append(f"{part.__name__}: {e}")
        steps = self.edges("STEP_IN_PROCESS").where(F.col("src") == usr).select(F.col("dst").alias("process"), "step").orderBy("step", "process").limit(10)
        return Response({"status": "found", "symbol": hits[0], **parts, "processes": rows(steps)}, self.freshness(req.build_id), open_gaps=gaps)

    def notification_graph(self, req: Request) -> Response:
        posts, observes = self.edges("Posts"), self.edges("Observes")
        if req.build_id:
            posts, observes = posts.where(F.col("build_id") == req.build_id), observes.where(F.col("build_id") == req.build_id)
        if req.notification_name:
            posts, observes = posts.where(F.col("dst") == req.notification_name), observes.where(F.col("src") == req.notification_name)
        df = notify.by_observer(observes).orderBy("usr") if req.group_by == "observer" else notify.by_notification(posts, observes).orderBy("name")
        return Response({"notifications": rows(df)}, self.freshness(req.build_id))

    def target_action_graph(self, req: Request, bindings: DataFrame) -> Response:
        key = "path" if req.group_by == "registrar" else "callback_usr"
        return Response({"bindings": rows(notify.target_actions(bindings, req.selector, req.callback_usr, req.file_path, key).orderBy("key"))}, self.freshness(req.build_id))

    def rename(self, req: Request) -> Response:
        return Response({"plan": rows(rename.sites(self.symbols, self.edges("Calls", "References"), req.usr, req.new_name).orderBy("file_path")), "dry_run": req.dry_run}, self.freshness(req.build_id))

    def process(self, req: Request) -> Response:
        if req.name:
            steps = self.edges("STEP_IN_PROCESS").where(F.col("dst") == req.name).select(F.col("src").alias("usr"), "step").orderBy("step")
            return Response({"steps": rows(steps)}, self.freshness(req.build_id))
        return Response({"processes": rows(self.store.nodes("Process").orderBy(F.desc("step_count"), "id"))}, self.freshness(req.build_id))

    def stats(self, req: Request) -> Response:
        return Response(rows(modules.stats(self.symbols, self.edges("Calls", "Contains", "Inherits", "Implements", "Extends")).orderBy("entity")), self.freshness(req.build_id))

    def audit(self, req: Request) -> Response:
        return Response({"modules": rows(modules.kind_counts(self.symbols).orderBy("module", F.desc("n")))}, self.freshness(req.build_id))

    def bridges(self, req: Request) -> Response:
        return Response({"bridges": rows(derive.bridges_of(self.edges("BridgesTo"), self.symbols).where(F.col("usr") == req.usr).orderBy("other"))}, self.freshness(req.build_id))

    def module_graph(self, req: Request) -> Response:
        deps = modules.dependencies(self.symbols, self.edges("Calls"), self.edges("References"))
        if req.module:
            deps = deps.where(F.col("src_module").contains(req.module) | F.col("dst_module").contains(req.module))
        return Response({"dependencies": rows(deps.orderBy("src_module", "dst_module"))}, self.freshness(req.build_id))

    def layer_violations(self, req: Request) -> Response:
        found = modules.violations(self.symbols, self.edges("Calls"))
        counts = {r["pattern"]: r["n"] for r in rows(found.groupBy("pattern").agg(F.count("*").alias("n")))}
        listed = rows(found.orderBy("pattern", "caller_usr", "callee_usr")) if req.include_details else []
        return Response({"violations": listed, "total": sum(counts.values()), "by_pattern": counts}, self.freshness(req.build_id))

    def _pairs(self, kind: str, req: Request) -> Response:
        s = self.symbols.select("usr", "name", F.coalesce("module", F.lit("")).alias("module"))
        both = self.edges(kind).join(s.toDF("src", "src_name", "src_module"), "src").join(s.toDF("dst", "dst_name", "dst_module"), "dst")
        if req.module:
            both = both.where(F.col("src_module").contains(req.module) | F.col("dst_module").contains(req.module))
        return Response({"edges": rows(both.select("src", "src_name", "dst", "dst_name", F.coalesce("confidence", F.lit(1.0)).alias("confidence")).orderBy("src", "dst"))}, self.freshness(req.build_id))

    def view_tree(self, req: Request) -> Response:
        return self._pairs("ViewTree", req)

    def navigation_flow(self, req: Request) -> Response:
        return self._pairs("NavigationFlow", req)

    def semantic_search(self, req: Request, vector: list[float] | None = None) -> Response:
        chunks = self.store.nodes("Chunk")
        text = rank.substring_hits(chunks, req.query)
        near = chunks.limit(0).select("id", "content", F.lit(0.0).alias("score")) if vector is None else chunks.join(rank.cosine_top(chunks, vector, req.top_k), "id").select("id", "content", "score")
        hits = rank.semantic_union(near, text, req.top_k).join(chunks.select("id", "owner_usr"), "id").join(self.symbols.select(F.col("usr").alias("owner_usr"), "name"), "owner_usr", "left")
        return Response({"hits": rows(hits.select("id", "owner_usr", F.coalesce("name", "owner_usr").alias("name"), "content", "score").orderBy(F.desc("score"), "id"))}, self.freshness(req.build_id))

    def hybrid_search(self, req: Request, vector: list[float]) -> Response:
        chunks = self.store.nodes("Chunk")
        near = rank.ranks(rank.cosine_top(chunks, vector, req.top_k), F.desc("score"), "id")
        text = rank.ranks(rank.substring_hits(chunks, req.query).orderBy("id").limit(req.top_k), "id")
        return Response({"hits": rows(rank.fuse(near, text).orderBy(F.desc("score"), "id").limit(req.top_k))}, self.freshness(req.build_id))


COMMANDS = {
    "search": Engine.search, "lookup_frame": Engine.frame, "find_callers": Engine.callers, "find_callees": Engine.callees, "find_references": Engine.references, "impact": Engine.impact,
    "symbol": Engine.symbol, "hierarchy": Engine.hierarchy, "context": Engine.context, "notification-graph": Engine.notification_graph, "rename": Engine.rename, "process": Engine.process,
    "stats": Engine.stats, "audit": Engine.audit, "class_search": Engine.class_search, "bridges": Engine.bridges, "module_graph": Engine.module_graph, "layer_violations": Engine.layer_violations,
    "view_tree": Engine.view_tree, "navigation_flow": Engine.navigation_flow, "semantic_search": Engine.semantic_search,
}


def pipe(engine: Engine, lines: Iterable[str]) -> Iterable[str]:
    """One JSON result for each JSON line ``{"cmd": ..., "args": {...}}``; a bad line gives an error and no more."""
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        try:
            ask = json.loads(line)
            yield COMMANDS[ask["cmd"]](engine, Request.of(ask.get("args", {}))).to_json()
        except Exception as e:
            yield json.dumps({"line": n, "error": f"{type(e).__name__}: {e}"[:300]})


def derive_all(store, scope: str = "") -> dict[str, DataFrame]:
    """Edge and node tables derived from a store's symbols and calls, ready for ``commit``."""
    symbols, calls = store.nodes("Symbol"), store.edges("Calls")
    members = flows.communities(calls)
    entries = flows.entry_points(symbols, calls)
    steps = flows.flow_steps(symbols, calls, entries)
    deps = modules.dependencies(symbols, calls, store.edges("References"))
    return {
        "BridgesTo": derive.bridge_edges(derive.bridge_pairs(symbols)),
        "DependsOn": deps.select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"), F.lit("derive/architecture").alias("source")),
        "MEMBER_OF": members.select(F.col("usr").alias("src"), F.concat(F.lit(f"community:{scope}:"), "community").alias("dst")),
        "STEP_IN_PROCESS": steps.select(F.col("usr").alias("src"), F.col("process_id").alias("dst"), "step"),
    }


def open_engine(spark: SparkSession, root: str) -> Engine:
    from ..store import GraphStore

    return Engine(GraphStore(spark, root))
