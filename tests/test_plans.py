"""Phases, graph tables, embeddings and rename writes."""

import pytest

from graphloom.functions.embed import embed_chunks, hash_model
from graphloom.operators import rename
from graphloom.operators.tables import GraphTables
from graphloom.plans.phases import Phase, Phases, order, text_table


def names(*edges):
    return [p.name for p in order([Phase(n, lambda c: None, tuple(needs)) for n, needs in edges])]


def test_order():
    assert names() == []
    assert names(("c", "b"), ("b", "a"), ("a", "")) == ["a", "b", "c"]
    assert names(("d", "bc"), ("c", "a"), ("b", "a"), ("a", "")) == ["a", "b", "c", "d"]
    for bad in ([("a", "b"), ("b", "a")], [("a", "z")]):
        with pytest.raises(ValueError):
            names(*bad)


def test_phases_skip_what_failed_and_what_is_off():
    seen = []
    p = Phases().add(Phase("a", lambda c: seen.append("a"))).add(Phase("b", lambda c: 1 / 0, ("a",))).add(Phase("c", lambda c: seen.append("c"), ("b",))).add(Phase("d", lambda c: seen.append("d"), enabled_when=lambda c: c.get("on", False)))
    assert {r.name: r.status for r in p.run({})} == {"a": "done", "b": "failed", "c": "skipped", "d": "disabled"} and seen == ["a"]
    with pytest.raises(ValueError):
        p.add(Phase("a", lambda c: None))
    assert text_table([{"a": 1, "b": None}], ["a", "b"]).splitlines()[0] == "a  b"


def test_graph_tables(spark):
    nodes = spark.createDataFrame([("a", "Symbol", "/1"), ("b", "Symbol", "/2"), ("m", "Module", None)], "id string, label string, file_path string")
    edges = spark.createDataFrame([("a", "b", "Calls"), ("b", "a", "Calls"), ("a", "m", "In")], "src string, dst string, rel_type string")
    g = GraphTables(nodes, edges)
    assert g.of_label("Symbol").count() == 2 and g.of_type("Calls").count() == 2
    left = g.remove_files(spark.createDataFrame([("/2",)], "path string"))
    assert left.nodes.count() == 2 and [(r.src, r.dst) for r in left.edges.collect()] == [("a", "m")] and g.edges.count() == 3
    again = left.add_nodes(spark.createDataFrame([("a", "Symbol", "/9")], "id string, label string, file_path string"))
    assert again.nodes.where("id = 'a'").first().file_path == "/9"
    with pytest.raises(RuntimeError):
        g.freeze().add_edges(edges)


def test_embeddings(spark):
    got = embed_chunks(spark.createDataFrame([(1, "alpha beta"), (2, None)], "id long, content string"), dimensions=16).orderBy("id").collect()
    assert [round(x, 5) for x in got[0].embedding] == [round(float(x), 5) for x in hash_model(16)(["alpha beta"])[0]] and set(got[1].embedding) == {0.0}


def test_rename_writes_files(spark, tmp_path):
    (tmp_path / "a.m").write_text("old(); olden old")
    plan = spark.createDataFrame([(str(tmp_path / "a.m"), "old", "fresh", 1), (str(tmp_path / "gone.m"), "old", "fresh", 1)], "file_path string, old_name string, new_name string, n long")
    assert rename.apply(spark, plan) == 1 and (tmp_path / "a.m").read_text() == "fresh(); olden fresh"
    assert rename.apply(spark, plan) == 0
