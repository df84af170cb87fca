"""Operators on small seeded graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import labels as L
from graphloom.functions import parsing as P
from graphloom.functions import similarity as S
from graphloom.operators import calls as C
from graphloom.operators import derive, flows, modules, mutate, notify, rank, rename, search
from graphloom.operators import traverse as T

SYMBOLS = "usr string, name string, kind string, module string, language string, file_path string, container_usr string"
EDGES = "src string, dst string, reason string, confidence double"


def syms(spark, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (7 - len(r)) for r in rows], SYMBOLS)


def edges(spark, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) for r in rows], EDGES)


def one(spark, *usrs):
    return spark.createDataFrame([(u,) for u in usrs], "usr string")


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'bigint'}" for k, v in cols.items())) if cols else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def abc(spark):
    return syms(spark, ("A", "A", "function", "M", "swift", "/src/X"), ("B", "B", "function", "M", "swift", "/src/X"), ("C", "C", "function", "M", "objc", "/src/Y"))


def test_callers_read_null_reason_as_inferred(spark, abc):
    got = C.callers(abc, edges(spark, ("B", "A"), ("C", "A"), ("A", "B")), one(spark, "A")).collect()
    assert {(r.usr, r.reason, r.confidence) for r in got} == {("B", "indexstore_relation_only", "inferred"), ("C", "indexstore_relation_only", "inferred")}


def test_direct_evidence_hides_the_rest_of_its_target(spark, abc):
    e = edges(spark, ("B", "A"), ("C", "A"), ("A", "B"), ("B", "A", "source_direct"))
    assert [r.usr for r in C.callers(abc, e, one(spark, "A")).collect()] == ["B"]
    only = edges(spark, ("B", "A", "indexstore_relation_only"))
    assert C.callers(abc, only, one(spark, "A")).count() == 0
    assert C.callers(abc, only, one(spark, "A"), include_inferred=True).count() == 1


def test_bfs_and_closure_match_a_plain_model(spark):
    rnd = random.Random(3)
    pairs = {(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(60)}
    e = edges(spark, *pairs)
    out = {}
    for seed in ("n1", "n7"):
        seen, front = {seed}, {seed}
        for d in range(1, 5):
            front = {b for a, b in pairs if a in front} - seen
            out |= {(seed, x): d for x in front}
            seen |= front
    assert {(r.seed, r.id): r.depth for r in T.bfs(e, one(spark, "n1", "n7"), 4).collect()} == out


def test_closure_depth(spark):
    e = edges(spark, ("A", "P"), ("B", "A"), ("C", "P"))
    ids = lambda depth, *seed: {r.id for r in T.subtype_closure(e, one(spark, *seed), depth).collect()}
    assert ids(20, "P") == {"A", "B", "C"} and ids(1, "P") == {"A", "C"} and ids(20, "B") == set()


def test_impact_order_bridges_and_subtypes(spark):
    rel = spark.createDataFrame([("d", "t", "Calls", None), ("d", "t", "References", None), ("i", "d", "Calls", None), ("o", "t", "BridgesTo", 0.85), ("x", "t", "BridgesTo", 0.5)], "src string, dst string, rel_type string, confidence double")
    got = {(r.id, r.depth, r.reached_via) for r in T.impact(rel, edges(spark, ("sub", "t")), one(spark, "t")).collect()}
    assert got == {("d", 1, "Calls"), ("i", 2, "Calls"), ("o", 1, "BridgesTo"), ("sub", 1, "subtype_closure")}
    s = syms(spark, ("t", "target", "function", "M"), ("d", "d", "function", "M"), ("i", "i", "function", "M"))
    row = T.impact_summary(T.impact(rel, edges(spark, ("sub", "t")), one(spark, "t")), s, one(spark, "t")).first()
    assert (row.risk, row.direct_callers, row.primary_surface, row.d2_clusters) == ("low", 3, "M target function", ["M"])
    assert T.impact_summary(T.impact(rel, edges(spark), one(spark, "none")), s, one(spark, "none"), fresh=False).first().risk == "critical"


def test_owner_of_extension(spark):
    s = syms(spark, ("e", "Ext", "extension"), ("k", "Klass", "class"), ("m", "run", "method"))
    assert C.owner_of(s, edges(spark, ("e", "m")), edges(spark, ("e", "k"))).first().owner_name == "Klass"


def test_layers_and_cycles(spark):
    s = syms(spark, ("a", "a", "f", "UIKit"), ("b", "b", "f", "DataLayer"), ("c", "c", "f", "AuthService"), ("d", "d", "f", "CommonUtil"))
    calls = edges(spark, ("a", "b"), ("b", "c"), ("d", "c"))
    assert sorted(r.pattern for r in modules.violations(s, calls).collect()) == ["Data→Service", "UI→Data"]
    deps = modules.dependencies(s, calls)
    assert deps.count() == 3 and modules.in_cycles(deps).count() == 0
    assert {r.module for r in modules.in_cycles(modules.dependencies(s, edges(spark, ("a", "b"), ("b", "a"), ("b", "c")))).collect()} == {"UIKit", "DataLayer"}


def test_bridges(spark):
    s = syms(spark, ("s:swiftFunc", "swiftFunc", "function", "M", "swift", "/src/a.swift"), ("c:objcMethod", "swiftFunc", "function", "M", "objc", "/src/b.m"))
    pairs = derive.bridge_pairs(s)
    assert [(r.swift_usr, r.objc_usr, r.confidence) for r in pairs.collect()] == [("s:swiftFunc", "c:objcMethod", 0.85)]
    assert derive.bridge_edges(pairs).count() == 2
    named = s.withColumn("swift_display_name", F.when(F.col("language") == "swift", "Box.fill(_:_:)")).withColumn("signature", F.lit(""))
    objc = syms(spark, ("c:objc(cs)Box(im)fill:with:", "fill:with:", "method", "M", "objc", "/o/b.m")).withColumn("swift_display_name", F.lit("")).withColumn("signature", F.lit(""))
    best = derive.bridge_pairs(named.where("language = 'swift'").unionByName(objc)).first()
    assert (best.bridge_kind, best.confidence) == ("usr_correlate", 0.95)


def test_bridge_counts_are_those_of_the_pairs(spark):
    import random

    rng, rows = random.Random(5), []
    for i in range(300):
        name, kind = rng.choice(["fill:with:", "fill", "draw", "Fill", None]), rng.choice(["method", "function", "class", None])
        language = rng.choice(["swift", "objc", "c"])
        usr = rng.choice([f"s:{i}", f"c:objc(cs)Box(im)fill:with:{i % 7}", f"p:{i}"])  # some ids stand on several rows
        shown = rng.choice(["Box.fill(_:_:)", "Box.draw()", "", None])
        rows.append((usr, name, kind, "M", language, rng.choice(["/src/a.swift", "/o/b.m", None]), shown, ""))
    rows.append(rows[0])
    s = spark.createDataFrame(rows, "usr string, name string, kind string, module string, language string, file_path string, swift_display_name string, signature string")
    pairs = derive.bridge_pairs(s).select("swift_usr", "objc_usr").collect()
    want = {}
    for a, b in pairs:
        want.setdefault(a, set()).add(b)
        want.setdefault(b, set()).add(a)
    counts = derive.bridge_counts(s)
    assert {r.usr: r.bridges for r in counts.collect()} == {u: len(v) for u, v in want.items()} and len(want) > 50
    assert derive.bridge_counts(s.limit(0)).count() == 0


def test_bridge_query_makes_no_pairs(spark):
    """10,000 symbols a side of one name: 100 million pairs."""
    side = lambda p, language: spark.range(10_000).select(F.concat(F.lit(p), "id").alias("usr"), F.lit("run").alias("name"), F.lit("method").alias("kind"), F.lit("M").alias("module"), F.lit(language).alias("language"), F.lit("/a/b").alias("file_path"))
    got = derive.bridge_counts(side("s:", "swift").unionByName(side("c:", "objc"))).groupBy("bridges").count().collect()
    assert [tuple(r) for r in got] == [(10_000, 20_000)]


def test_navigation_is_a_product_without_a_shuffle_of_its_rows(spark):
    views = spark.createDataFrame([("a", "M"), ("b", "M"), ("b", "N"), (None, "M"), ("c", "N")], "usr string, module string")
    flow = derive.navigation(views, views)
    assert sorted(map(tuple, flow.collect())) == [(x, y) for x in "abc" for y in "abc" if x != y]
    plan = flow._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("NestedLoopJoin")]
    assert sorted(map(tuple, derive.navigation(views, views, within_module=True).collect())) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]


def test_views_overrides_chunks(spark):
    v, bodies = one(spark, "s:C", "s:H"), spark.createDataFrame([("s:Cbody",)], "usr string")
    owners = derive.body_owners(bodies, v)
    assert [(r.usr, r.owner) for r in owners.collect()] == [("s:Cbody", "s:C")]
    assert [(r.src, r.dst) for r in derive.view_tree(v, owners, edges(spark, ("s:Cbody", "s:H"), ("s:Cbody", "other"))).collect()] == [("s:C", "s:H")]
    s = syms(spark, ("m1", "run", "method"), ("m2", "run", "method"), ("m3", "walk", "method"))
    got = derive.overrides(s, edges(spark, ("Sub", "m1"), ("Base", "m2"), ("Base", "m3")), edges(spark, ("Sub", "Base")))
    assert [(r.src, r.dst) for r in got.collect()] == [("m1", "m2")]
    assert derive.chunks(s.where("usr = 'm1'")).first().content == "method run"


def test_flows(spark):
    s = syms(spark, *[(x, n, "method") for x, n in (("h", "handlePush:"), ("w", "doWork"), ("g", "getter:body"), ("ca", "ca"), ("cb", "cb"), ("cc", "cc"))])
    calls = edges(spark, *[(x, c) for x in "hwg" for c in ("ca", "cb", "cc")])
    score = {r.usr: r.score for r in flows.entry_points(s, calls).collect()}
    assert score["h"] > score["w"] > score["g"]
    steps = flows.flow_steps(s, calls, flows.entry_points(s, calls))
    assert [(r.usr, r.step) for r in steps.where("entry = 'h'").orderBy("step").collect()] == [("ca", 1), ("cb", 2), ("cc", 3)]
    assert flows.flow_summary(steps, s).where("entry = 'h'").first().label == "handlePush: → cc"


def test_communities(spark):
    got = flows.communities(edges(spark, ("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "f"), ("a", "c"))).toPandas()
    sizes = got.groupby("community").size()
    assert len(got) == 6 and len(sizes) >= 2 and sizes.max() / 6 < 0.67
    assert flows.community_table(spark.createDataFrame(got), "s").count() == (sizes > 1).sum()


def test_notifications(spark):
    posts, obs = edges(spark, ("A", "My"), ("B", "My"), ("B", "Other")), edges(spark, ("My", "D"), ("My", "D"), ("Lone", "E"))
    got = {r.name: (r.posters, r.observers) for r in notify.by_notification(posts, obs).collect()}
    assert got == {"My": (["A", "B"], ["D"]), "Other": (["B"], []), "Lone": ([], ["E"])}
    assert [(r.usr, r.registrations) for r in notify.by_observer(obs).orderBy("usr").collect()] == [("D", ["My"]), ("E", ["Lone"])]
    assert [r.name for r in notify.observer_only(posts, obs).collect()] == ["Lone"]


def test_search(spark):
    s = syms(spark, ("u1", "Process_Msg", "function"), ("u2", "process_msg", "function"), ("u3", "process_msgLater", "function"))
    assert [r.usr for r in search.ranked(s, "process_msg").orderBy("place").collect()] == ["u2", "u3"]
    assert [r.usr for r in s.orderBy(*search.rank_keys("process_msg")).collect()] == ["u2", "u1", "u3"]
    assert search.matching(s, "^process_msg$").count() == 1 and search.matching(s, "rocess").count() == 3
    with pytest.raises(Exception):
        search.matching(s, "(")


@pytest.mark.parametrize(
    "kind, path, module, hints, want",
    [
        ("method", "/a/File.m", "M", ("file.m", "method", "m"), 1.0), ("method", "/a/File.m", "", ("file", "", ""), 0.94), ("class", "", "", ("", "", ""), 0.60),
        ("function", "", "M", ("", "", "m"), 0.66), ("constructor", "", "", ("", "constructor", ""), 0.70), (None, None, None, ("x", "", ""), 0.50),
    ],
)
def test_candidate_score(spark, kind, path, module, hints, want):
    assert value(spark, L.candidate_score(F.col("k"), F.col("p"), F.col("m"), *hints), k=kind, p=path, m=module) == want


def test_autoselect(spark):
    s = syms(spark, ("1", "run", "class", "A", "swift", "/a/x.swift"), ("2", "run", "method", "B", "swift", "/b/y.swift"))
    assert [(r.usr, r.status) for r in search.resolve(s, file_hint="/a/", module_hint="A").collect()] == [("1", "found")]
    assert {r.status for r in search.resolve(s).collect()} == {"ambiguous"}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("0 lib ns::owner::sym(int a) (f.cpp:12)", ("ns::owner::sym", "owner", "sym", "int a", None, "f.cpp", "12")),
        ("-[Owner run:with:] + 32", ("-[Owner run:with:]", "Owner", "run:with:", "", "objc", None, None)),
        ("Mod.Owner.go() + 12", ("Mod.Owner.go()", "Owner", "go()", "", "swift", None, None)),
        ("a::b()\nc::d()", None), ("nothing here", None), (None, None), ("", None),
    ],
)
def test_frames(spark, raw, want):
    got = value(spark, P.frame(F.col("x")), x=raw)
    assert (None if got is None else tuple(got)) == want


def test_resolve_frames(spark):
    s = syms(spark, ("c:objc(cs)Owner", "Owner", "class"), ("c:objc(cs)Owner(im)run:", "run:", "method", "M", "objc", "/f", "c:objc(cs)Owner"), ("other", "run:", "method"))
    got = search.resolve_frames(spark.createDataFrame([("-[Owner run:]",), ("-[Gone walk:]",), ("?",)], "raw string"), s).collect()
    assert {(r.raw, r.outcome, r.usr) for r in got} == {("-[Owner run:]", "match", "c:objc(cs)Owner(im)run:"), ("-[Gone walk:]", "no_match", None), ("?", "parse_failed", None)}


@pytest.mark.parametrize("name, want", [("operator<<", True), ("operator new", True), ("operator", True), ("operatorName", False), ("NSLog", True), ("run", False), (None, False), ("", False)])
def test_noise(spark, name, want):
    assert value(spark, L.is_noise(F.col("x")), x=name) is want


def test_labels(spark):
    assert value(spark, L.message_role(F.col("x")), x="setFooDelegate:") == "delegate_setter"
    assert value(spark, L.message_role(F.col("x")), x=None) == "unknown"
    assert value(spark, L.is_framework_callback(F.col("x")), x="viewDidLoad") is True
    assert value(spark, L.is_framework_callback(F.col("x")), x="configureApplication:") is False
    assert value(spark, L.execution_boundary(F.col("n"), F.col("k"), F.col("r")), n="~Foo", k="", r="")["role"] == "lifecycle_uninit_path"
    assert value(spark, L.execution_boundary(F.col("n"), F.col("k"), F.col("r")), n="plain", k=None, r=None) is None
    assert value(spark, L.source_scope(F.col("x"), "/ws"), x="/wsx/a") == "outside_workspace_root"
    assert value(spark, L.source_scope(F.col("x"), "/ws/"), x="/ws/a") == "inside_workspace_root"
    assert value(spark, L.module_layer(F.col("x")), x="build") == "ui"
    assert value(spark, L.symbol_kind(F.col("x")), x="instanceMethod") == "method"
    assert value(spark, L.risk_level(F.col("n"), F.col("b"), F.lit(True)), n=4, b=True) == "high"
    assert value(spark, L.query_kind(F.col("x")), x="a::b") == "qualified_symbol"
    assert value(spark, L.entry_score(F.col("x"), F.lit(4), F.lit(1)), x="handleFoo") == 5.0
    assert value(spark, L.likely_tests(F.col("x")), x="Audio restart") == ["direct caller smoke test", "audio device add/remove and default-device change", "start/stop/restart flow"]


def test_source_lines(spark):
    line = "[[NSNotificationCenter defaultCenter] addObserver:self selector:@selector(go:) name:Foo object:nil];"
    assert tuple(value(spark, P.observer_line(F.col("x")), x=line)) == ("go:", "Foo")
    assert tuple(value(spark, P.observer_line(F.col("x")), x="[c addObserverForName:Bar object:nil]")) == (None, "Bar")
    assert value(spark, P.observer_line(F.col("x")), x="nothing") is None
    assert value(spark, P.post_line(F.col("x")), x="[c postNotificationName:Baz]; ") == "Baz"
    assert tuple(value(spark, P.target_action_line(F.col("x")), x="[b addTarget:self action:@selector(tap) forControlEvents:UIControlEventTouchUpInside]")) == ("tap", "UIControlEventTouchUpInside")
    assert value(spark, P.method_selector(F.col("x")), x="- (void)move:(int)a to:(int)b {") == "move:to:"
    assert value(spark, P.method_selector(F.col("x")), x="+ (id)shared") == "shared"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None)], "id long, embedding array<float>")
    assert [(r.id, r.score) for r in rank.cosine_top(v, [3.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.0)]
    assert value(spark, S.norm(F.array(F.lit(3.0), F.lit(4.0)))) == 5.0
    lists = [spark.createDataFrame(x, "id string, rank long") for x in ([("a", 0), ("b", 1)], [("b", 0), ("c", 1)])]
    got = {r.id: r.score for r in rank.fuse(*lists).collect()}
    assert max(got, key=got.get) == "b" and set(got) == {"a", "b", "c"}
    near = spark.createDataFrame([("1", "x", 0.9)], "id string, content string, score double")
    text = spark.createDataFrame([("2", "x"), ("3", "y")], "id string, content string")
    assert [(r.id, r.score) for r in rank.semantic_union(near, text).collect()] == [("1", 0.9), ("3", 0.5)]


def test_mutations(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "id string, name string, module string")
    new = spark.createDataFrame([("2", "b2", None), ("3", "c", "z")], "id string, name string, module string")
    got = {r.id: (r.name, r.module, r.change) for r in mutate.upsert(old, new).collect()}
    assert got == {"1": ("a", "x", "kept"), "2": ("b2", "y", "updated"), "3": ("c", "z", "inserted")}
    again = mutate.upsert(mutate.upsert(old, new).drop("change"), new)
    assert {r.change for r in again.collect()} == {"kept"}
    s = syms(spark, ("a", "a", "f", "M", "c", "/1"), ("b", "b", "f", "M", "c", "/2"))
    assert {r.usr for r in mutate.placeholders(edges(spark, ("a", "z")), s).collect()} == {"z"}
    left, kept = mutate.retract(s, edges(spark, ("a", "b"), ("b", "a")), spark.createDataFrame([("/1",)], "path string"))
    assert {r.usr for r in left.collect()} == {"b"} and [(r.src, r.dst) for r in kept.collect()] == [("b", "a")]
    rel = spark.createDataFrame([("callee", "caller", "calledBy", ""), ("callee", "caller", "calledBy", "call"), ("m", "C", "childOf", "")], "from_usr string, to_usr string, role string, occurrence_role string")
    assert [(r.src, r.dst, r.reason) for r in mutate.call_edges(rel).collect()] == [("caller", "callee", "source_direct")]
    assert [(r.rel_type, r.src, r.dst) for r in mutate.structure_edges(rel).collect()] == [("Contains", "C", "m")]
    occ = spark.createDataFrame([("u", "f1", 1, 1, "reference"), ("u", "f2", 9, 1, "definition")], "usr string, file string, line long, col long, role string")
    assert mutate.canonical(occ).first().file == "f2"
    merged = mutate.merge_sources(syms(spark, ("1", "", "f", "M")), syms(spark, ("1", "n", "g", ""), ("2", "k", "f")))
    assert {(r.usr, r.name, r.kind) for r in merged.collect()} == {("1", "n", "f"), ("2", "k", "f")}


def test_rename(spark):
    s = syms(spark, ("t", "old", "f", "M", "c", "/t.m"), ("u", "user", "f", "M", "c", "/u.m"))
    plan = rename.sites(s, edges(spark, ("u", "t")), "t", "fresh")
    assert {(r.file_path, r.n) for r in plan.collect()} == {("/t.m", 1), ("/u.m", 1)}
    lines = spark.createDataFrame([("/u.m", 3, "old(); olden old"), ("/z.m", 1, "old")], "path string, line int, text string")
    assert [(r.path, r.after) for r in rename.diff(lines, plan, "old", "fresh").collect()] == [("/u.m", "fresh(); olden fresh")]
    with pytest.raises(ValueError):
        rename.sites(s, edges(spark), "t", "not a name")
