"""Readers, the store and incremental ingest on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.operators import search
from graphloom.plans.api import Engine, Request, SearchStatus, pipe
from graphloom.sources import documents, files, scan
from graphloom.store import Busy, GraphStore, resolve_path
from graphloom.streaming import ingest


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def sym(usr, name, file, kind="function"):
    return {"kind": "symbol", "usr": usr, "name": name, "symbol_kind": kind, "language": "swift", "module": "M", "file": file}


def call(caller, callee, direct=True):
    return {"kind": "relation", "from_usr": callee, "to_usr": caller, "role": "calledBy", "occurrence_role": "call" if direct else ""}


def test_scan_is_tolerant(spark):
    got = lines(spark, sym("u", "n", "f"), "{broken", {"kind": "relation", "from_usr": "a"}, {"kind": "relation", "from_usr": "a", "to_usr": "b", "role": "calledBy"}, {"kind": "zebra"}, {"kind": "occurrence", "usr": "u", "file": "f", "line": 1, "column": 2, "role": "definition"}, "")
    assert scan.records(got, "symbol").count() == 1
    rel = scan.records(got, "relation").first()
    assert (rel.to_usr, rel.occurrence_role, rel.line) == ("b", "", 0)
    assert scan.records(got, "occurrence").first().col == 2
    assert sorted(r.reason for r in scan.warnings(got).collect()) == ["malformed", "missing field", "unknown kind"]
    assert scan.warnings(lines(spark, "x" * 200)).first().snippet == "x" * 80


def test_file_status_takes_the_last_parsable_line():
    assert scan.file_status('noise\n{"changed": ["a"], "all": []}\n{"changed": ["b"], "all": ["b"]}\ntail')["changed"] == ["b"]
    assert scan.file_status("nothing") == {"changed": [], "all": [], "output_path_mappings": []}


def test_symbol_documents(spark, tmp_path):
    (tmp_path / "x.symbols.json").write_text(json.dumps({"module": {"name": "M"}, "symbols": [{"identifier": {"precise": "s:1", "interfaceLanguage": "swift"}, "kind": {"identifier": "swift.func"}, "names": {"title": "go()"}, "declarationFragments": [{"spelling": "func "}, {"spelling": "go"}], "accessLevel": "public", "location": {"uri": "file:///a.swift"}}], "relationships": [{"kind": "memberOf", "source": "s:1", "target": "s:2"}]}, indent=1))
    symbols, relations = documents.read_symbol_documents(spark, str(tmp_path))
    row = symbols.first()
    assert (row.usr, row.signature, row.file_path, row.module) == ("s:1", "func go", "/a.swift", "M")
    assert tuple(relations.first()) == ("s:1", "s:2", "memberOf")


def test_conformances(spark):
    text = "public enum E : UInt, Sendable {\n}\nclass K : superclass, P<Int> {\n}\npublic protocol Q {\n}\nextension S : Swift.Codable where T == Int {\n}"
    got = documents.conformances(spark.createDataFrame([(text, "M")], "value string, module string")).collect()
    assert [(r.type_name, r.type_kind, r.protocol_name) for r in got] == [("E", "enum", "Sendable"), ("K", "class", "superclass"), ("K", "class", "P"), ("S", "extension", "Codable")]


def test_dependency_files(spark):
    got = spark.createDataFrame([("x.o : /a/b.swift /c\\ d.swift \\\n  /e.h",)], "t string").select(documents.dependency_files(F.col("t")).alias("f")).first().f
    assert [f for f in got if f != ":"][-3:] == ["/a/b.swift", "/c d.swift", "/e.h"]


def test_source_text(spark, tmp_path):
    (tmp_path / "a.m").write_text("@implementation A\n- (void)go:(id)x {\n  if (x) {\n    [c addObserver:self\n selector:@selector(hit:) name:Foo object:nil];\n  }\n}\n- (void)hit:(id)n\n{\n}\n@end\n")
    found = files.lines_of(spark, str(tmp_path))
    assert found.where("line = 2").first().text.startswith("- (void)go")
    block = files.blocks(found, "addObserver").first()
    assert "selector:@selector(hit:) name:Foo" in block.text and block.line == 4
    got = {r.selector: (r.line, r.text.count("\n")) for r in files.method_blocks(found).collect()}
    assert got == {"go:": (2, 5), "hit:": (8, 2)}
    listed = files.source_files(files.listing(spark, [str(tmp_path)]), str(tmp_path))
    assert listed.count() == 1 and files.newest(listed).first().newest is not None


def test_store_versions_and_lock(spark, tmp_path):
    root = str(tmp_path / "graph")
    first = GraphStore(spark, root)
    assert first.nodes("Symbol").count() == 0
    s = schemas.conform(spark.createDataFrame([("a", "a", "n1"), ("a", "a", "n2")], "id string, usr string, name string"), schemas.node_schema("Symbol"))
    v1 = first.commit({"Symbol": s}, {"Calls": spark.createDataFrame([("a", "b")], "src string, dst string")})
    assert v1.nodes("Symbol").count() == 1 and v1.edges("Calls").first().rel_type == "Calls"
    v2 = v1.commit({"Module": spark.createDataFrame([("M", "swift")], "name string, language string")})
    assert v2.nodes("Symbol").count() == 1 and v2.edges().count() == 1
    assert v1.nodes("Module").count() == 0  # the snapshot that was opened stays as it was
    assert v2.commit({}, {}, keep=False).nodes("Symbol").count() == 0
    with v2.lock(), pytest.raises(Busy):
        with GraphStore(spark, root).lock():
            pass
    with v2.lock():
        v2.save_state(last_ingest_ts=5.0, targets=["T"])
    assert ingest.is_current(v2.state(), 4.0, ["T"]) and not ingest.is_current(v2.state(), 6.0, ["T"]) and not ingest.is_current(v2.state(), 4.0, ["T", "U"])
    assert resolve_path([None, "", "/x"], "/d") == "/x" and resolve_path([None], "/d") == "/d"


def test_retries():
    waits, tries = [], []

    def action():
        tries.append(1)
        if len(tries) < 4:
            raise Busy("x")
        return "done"

    assert ingest.with_retries(action, sleep=waits.append, rand=lambda a, b: 1.0) == "done" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(Busy):
        ingest.with_retries(lambda: (_ for _ in ()).throw(Busy("x")), retries=2, sleep=waits.append)


def test_stream_updates_changed_files_only(spark, tmp_path):
    inbox, root, mark = tmp_path / "in", str(tmp_path / "graph"), str(tmp_path / "mark")
    inbox.mkdir()
    put = lambda name, *rows: (inbox / name).write_text("\n".join(json.dumps(r) for r in rows))
    put("1.jsonl", sym("a", "a", "/1"), sym("b", "b", "/2"), call("a", "b"), call("b", "a"), call("a", "x"))
    ingest.watch(spark, str(inbox), root, mark, once=True).awaitTermination()
    store = GraphStore(spark, root)
    pairs = lambda s: {(r.src, r.dst) for r in s.edges("Calls").collect()}
    assert pairs(store) == {("a", "b"), ("b", "a"), ("a", "x")}
    assert {r.id: r.kind for r in store.nodes("Symbol").collect()} == {"a": "function", "b": "function", "x": "unknown"}
    put("2.jsonl", sym("a", "a2", "/1"), call("a", "a"))
    ingest.watch(spark, str(inbox), root, mark, once=True).awaitTermination()
    later = GraphStore(spark, root)
    assert pairs(later) == {("b", "a"), ("a", "a")} and {r.name for r in later.nodes("Symbol").where("id = 'a'").collect()} == {"a2"}
    version = later.version
    ingest.watch(spark, str(inbox), root, mark, once=True).awaitTermination()
    assert GraphStore(spark, root).version == version  # nothing new, no new snapshot


def test_bursts_on_a_table(spark):
    e = spark.sql("select k as key, to_timestamp_ntz(t) as ts from values ('a', '2024-01-01 00:00:00'), ('a', '2024-01-01 00:00:05'), ('a', '2024-01-01 00:01:00'), ('b', '2024-01-01 00:00:00') v(k, t)")
    assert sorted((r.key, r.n) for r in ingest.bursts(e).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_engine_and_pipe(spark, tmp_path):
    store = ingest.apply_scan(GraphStore(spark, str(tmp_path / "g")), lines(spark, sym("t", "target", "/t"), sym("d", "direct", "/d"), sym("i", "indirect", "/i"), call("d", "t"), call("i", "d"), sym("K", "Klass", "/k", "class"), sym("m", "meth", "/k", "instanceMethod"), {"kind": "relation", "from_usr": "m", "to_usr": "K", "role": "childOf"}, call("m", "t")))
    eng = Engine(store)
    assert {c["usr"] for c in eng.callers(Request(usr="t")).data["callers"]} == {"d", "m"}
    assert {c["usr"]: c["depth"] for c in eng.callers(Request(usr="t", depth=3)).data["callers"]} == {"d": 1, "m": 1, "i": 2}
    assert eng.callees(Request(usr="K")).data["callees"][0]["calling_methods"] == ["meth"]
    impact = eng.impact(Request(usr="t"))
    assert impact.freshness == "stale" and impact.data["risk"] == "critical" and [r["id"] for r in impact.data["depths"]["d2"]] == ["i"]
    assert eng.search(Request(name="direct")).data["outcome"] == "ambiguous"  # indirect holds it too
    assert eng.context(Request(name="^target$")).data["status"] == "found"
    assert eng.symbol(Request(usr="m")).data["owner"]["owner_name"] == "Klass"
    out = [json.loads(x) for x in pipe(eng, ['{"cmd": "find_references", "args": {"usr": "t"}}', "broken", '{"cmd": "nope"}', ""])]
    assert len(out) == 3 and len(out[0]["data"]["references"]) == 2 and "error" in out[1] and "error" in out[2]
    with pytest.raises(ValueError):
        SearchStatus("maybe")


def test_deleted_and_emptied_files_leave_the_graph(spark, tmp_path):
    store = ingest.apply_scan(GraphStore(spark, str(tmp_path / "g")), lines(spark, sym("a", "a", "/1"), sym("b", "b", "/2"), sym("c", "c", "/3"), call("a", "b"), call("b", "c"), call("c", "a")))
    later = ingest.apply_scan(store, lines(spark, sym("a", "a", "/1"), call("a", "b"), {"changed": ["/1", "/3"], "all": ["/1", "/3"]}))
    assert {(r.src, r.dst) for r in later.edges("Calls").collect()} == {("a", "b")}
    assert {r.id: r.kind for r in later.nodes("Symbol").collect()} == {"a": "function", "b": "unknown"}
    assert {r.path for r in later.nodes("File").collect()} == {"/1"}
    last = ingest.apply_scan(later, lines(spark), deleted=spark.createDataFrame([("/1",)], "path string"))
    assert last.edges("Calls").count() == 0


def test_a_dead_writer_blocks_for_a_while_only(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.files.write("LOCK", json.dumps({"owner": "x", "time": 1.0}))
    with store.lock():
        with pytest.raises(Busy), GraphStore(spark, str(tmp_path / "g")).lock():
            pass
    assert not store.files.exists("LOCK")


def test_frames_join_by_equality(spark):
    symbols = spark.createDataFrame([("u1", "run", "method", "box"), ("u0", "run", "method", "box")], "usr string, name string, kind string, container_usr string")
    found = search.resolve_frames(spark.createDataFrame([("0  App  0x1  -[Box run] + 4",)], "raw string"), symbols)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().usr in (None, "u0")  # a tie goes to the smaller id


def test_a_build_is_recorded(spark, tmp_path):
    store = ingest.apply_scan(GraphStore(spark, str(tmp_path / "g")), lines(spark, sym("t", "t", "/t"), sym("d", "d", "/d"), call("d", "t")), build_id="b1")
    store = ingest.apply_scan(store, lines(spark, sym("d", "d", "/d"), call("d", "t")), build_id="b2")
    eng = Engine(store)
    assert eng.freshness("b1") == eng.freshness("b2") == "fresh" and eng.freshness("b3") == "stale" and eng.latest_build() == "b2"
    assert eng.impact(Request(usr="t")).data["risk"] != "critical"
