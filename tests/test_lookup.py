"""Lookups, edit plans, notes, imported indexes and exploration on small cases."""

import pytest

from strandline.operators import explore, knowledge, lookup, summary
from strandline.sources import scip

NODE = "id string, name string, kind string, language string, file string, start_line int, end_line int, signature string, parent_id string"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("a.go#Store", "Store", "class", "go", "src/a.go", 1, 9, "type Store", ""), ("a.go#Store#get", "get", "method", "go", "src/a.go", 3, 5, "func get()", "a.go#Store"), ("b.go#get", "get", "function", "go", "src/b.go", 1, 3, "func get()", ""),
        ("t#getTest", "getTest", "function", "go", "src/get_test.go", 1, 3, "func getTest()", ""), ("old#get", "getOld", "function", "go", "src/b.old.go", 1, 3, "func getOld()", ""),
    ]
    return spark.createDataFrame(rows, NODE)


def test_tiers_and_order(nodes):
    ids = lambda q: [r.id for r in lookup.find_symbols(nodes, q).collect()]
    assert ids("b.go#get") == ["b.go#get"] and ids("Store.get") == ["a.go#Store#get"] and ids("get") == ["a.go#Store#get", "b.go#get"]
    assert ids("src/b.go:get") == ["b.go#get"] and ids("nothing") == [] and ids("GETT") == ["t#getTest"]
    assert [r.id for r in lookup.list_symbols(nodes, "get").collect()] == ["a.go#Store#get", "b.go#get", "t#getTest", "old#get"]
    assert {r.id: r.score for r in lookup.list_symbols(nodes, "get").collect()} == {"a.go#Store#get": 1100, "b.go#get": 1100, "t#getTest": 500, "old#get": 300}
    assert lookup.list_symbols(nodes, kind="class").count() == 1


def test_rename_plan(spark, nodes):
    lines = spark.createDataFrame([("src/b.go", 1, "func get() {"), ("src/c.go", 7, "x := forget(get())"), ("src/c.go", 8, "forget()")], "file string, line int, text string")
    edges = spark.createDataFrame([("c", "b.go#get", "calls", "heuristic", "", "src/c.go", 7)], "src string, dst string, type string, confidence string, reason string, file string, line int")
    got = [tuple(r) for r in lookup.rename_plan(nodes, edges, lines, "b.go#get", "fetch").collect()]
    assert got == [("src/b.go", 1, 6, "get", "fetch", "exact"), ("src/c.go", 7, 13, "get", "fetch", "heuristic")]
    for bad in ("1x", "get"):
        with pytest.raises(ValueError):
            lookup.rename_plan(nodes, edges, lines, "b.go#get", bad)
    assert [tuple(r) for r in lookup.body_plan(nodes, "b.go#get", "x", after=True).collect()] == [("src/b.go", 4, 3, "x")]


def test_recall(spark):
    gold = spark.createDataFrame([("f", "a", True), ("f", "b", True), ("f", "z", False)], "name string, caller string, wanted boolean")
    found = spark.createDataFrame([("f", "a"), ("f", "z")], "name string, caller string")
    row = lookup.recall(gold, found).first()
    assert (row.expected, row.found, row.violations, row.recall) == (2, 1, 1, 0.5)


def test_notes_and_sections(tmp_path):
    k = knowledge.Knowledge.load(tmp_path / "k.json")
    first = k.add_note("s", " hello ")
    k.add_note("t", "x")
    k.put_section("Why", "a")
    k.put_section("why ", "b")
    again = knowledge.Knowledge.load(tmp_path / "k.json")
    assert [n.text for n in again.list_notes("s")] == ["hello"] and again.section("WHY").content == "b" and len(again.sections) == 1
    assert again.remove_note(first.id) and not again.remove_note(99) and again.remove_section("why") and not again.remove_section("why")
    with pytest.raises(ValueError):
        again.add_note("s", "  ")


def message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_scip(spark, tmp_path):
    place = lambda line: bytes([line, 0, 4])
    one = message((1, b"src/a.go"), (4, b"Go"), (2, message((1, place(0)), (2, b"go . p F()."), (3, 1))), (2, message((1, place(1)), (2, b"go . p G()."), (3, 0))), (3, message((1, b"go . p F()."), (4, message((1, b"go . p G()."), (2, 1))))))
    two = message((1, b"src/b.go"), (4, b"Go"), (2, message((1, place(4)), (2, b"go . p G()."), (3, 1))), (2, message((1, place(0)), (2, b"go . p F()."), (3, 2))))
    out = message((1, b"../x.go"), (2, message((1, place(0)), (2, b"q"), (3, 1))))
    (tmp_path / "i.scip").write_bytes(message((2, one), (2, two), (2, out)))
    rows = scip.read_scip(spark, str(tmp_path / "i.scip")).cache()
    nodes = scip.scip_nodes(rows)
    assert {(r.name, r.file, r.start_line) for r in nodes.collect()} == {("F", "src/a.go", 1), ("G", "src/b.go", 5)}
    edges = {(r.src, r.dst, r.type) for r in scip.scip_edges(rows, nodes).collect()}
    assert edges == {("scip:go . p F().", "scip:go . p G().", "references-symbol"), ("file:src/b.go", "scip:go . p F().", "scip-imports")}


def test_mentions_and_file_graph(spark, nodes):
    assert explore.mentions(["src/Store.go"], "the duplicate") == {"src/store.go": 12.0, "store": 12.0, "duplicate": 2.0, "double": 2.0, "repeat": 2.0, "repeated": 2.0, "once": 2.0, "idempotent": 2.0}
    weights = {r.node: r.personal for r in explore.personal_weights(nodes, {"store": 12.0}).collect()}
    assert sum(weights.values()) == pytest.approx(1.0) and weights["src/a.go"] == 1.0
    edges = spark.createDataFrame([("b.go#get", "a.go#Store", "calls"), ("b.go#get", "a.go#Store", "places")], "src string, dst string, type string")
    row = summary.file_graph(nodes, edges, {"store": 12.0}).first()
    assert (row.weight, row.edges) == (13.0, 1)


def test_explore(spark, nodes):
    lines = spark.createDataFrame([("src/a.go", 4, "return the widget store"), ("src/b.go", 2, "nothing here"), ("src/a.go", 1, "type x")], "file string, line int, text string")
    edges = spark.createDataFrame([("b.go#get", "a.go#Store#get", "calls", "exact", "", "src/b.go", 2)], "src string, dst string, type string, confidence string, reason string, file string, line int")
    got = [tuple(r) for r in explore.explore("where is the widget", lines, nodes, edges).collect()]
    assert got == [("src/a.go", 3, 5, "anchor", 6), ("src/b.go", 1, 3, "neighbour", 3)]
