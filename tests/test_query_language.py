"""The query language on small graphs."""

import pytest

from strandline.operators.traverse import reachable
from strandline.plans.binder import query_graph, query_total
from strandline.plans.syntax import Hop, Node, QuerySyntaxError, parse

NODE = "id string, name string, kind string, language string, file string, start_line int, end_line int, signature string, confidence string, exported boolean, complexity int, loop_depth int, transitive_loop_depth int, linear_scan_in_loop int, alloc_in_loop int, recursion_in_loop boolean"


def graph(spark, names, links, kind="function", complexity=None, files=None):
    rows = [(n, n, kind, "go", (files or {}).get(n, "a.go"), 1, 2, f"func {n}()", "exact", n.isupper(), (complexity or {}).get(n, 1), 0, 0, 0, 0, False) for n in names]
    return spark.createDataFrame(rows, NODE), spark.createDataFrame([(a, b, "calls") for a, b in links], "src string, dst string, type string")


def values(df):
    return [tuple(r) for r in df.collect()]


CHAIN = list(zip("abcd", "bcde", strict=True))


@pytest.mark.parametrize(("stars", "names"), [("*1..3", "bcd"), ("*", "bcde"), ("*2", "c"), ("*..2", "bc"), ("*2..", "cde"), ("*1..999", "bcde"), ("*3..2", ""), ("", "b")])
def test_hops(spark, stars, names):
    nodes, edges = graph(spark, "abcde", CHAIN)
    got = query_graph(f"MATCH (x)-[:calls{stars}]->(y) WHERE x.name='a' RETURN y.name ORDER BY y.name", nodes, edges)
    assert [r[0] for r in got.collect()] == list(names)


def test_cycle_never_returns_the_start(spark):
    nodes, edges = graph(spark, "ab", [("a", "b"), ("b", "a")])
    assert values(query_graph("match (x)-[:CALLS*1..3]->(y) where x.name = 'a' return y.name", nodes, edges)) == [("b",)]


def test_fixed_hops_keep_every_edge(spark):
    nodes, edges = graph(spark, "abcz", [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("a", "unresolved:x")])
    assert len(values(query_graph("MATCH (x)-[:calls]->(y) WHERE x.name = 'a' RETURN x.name, y.name", nodes, edges))) == 2
    assert values(query_graph("MATCH (x)-[:calls]->(y)-[:calls]->(z) WHERE x.name = 'b' RETURN x.name, y.name, z.name", nodes, edges)) == [("b", "c", "c")]
    assert values(query_graph("MATCH (a)-[:calls]->(a) WHERE a.name = 'b' RETURN a.name, COUNT(*)", nodes, edges)) == [("b", 2)]


def test_aggregates(spark):
    nodes, edges = graph(spark, "abc", [], complexity={"a": 1, "b": 2, "c": 3}, files={"a": "x", "b": "x", "c": "y"})
    got = query_graph("MATCH (f) RETURN f.file, COUNT(*), SUM(f.complexity), AVG(f.complexity), MIN(f.name), COLLECT(f.name) ORDER BY COUNT(*) DESC", nodes, edges)
    assert got.columns == ["f.file", "COUNT(*)", "SUM(f.complexity)", "AVG(f.complexity)", "MIN(f.name)", "COLLECT(f.name)"]
    assert values(got) == [("x", 2, 3, 1.5, "a", ["a", "b"]), ("y", 1, 3, 3.0, "c", ["c"])]
    empty = "MATCH (f:class) RETURN COUNT(*), MIN(f.complexity), AVG(f.complexity), COLLECT(f.name), SUM(f.complexity)"
    assert values(query_graph(empty, nodes, edges)) == [(0, None, None, [], 0)]


def test_tests_that_cannot_hold(spark):
    nodes, edges = graph(spark, "aB", [])
    ask = lambda where: len(values(query_graph(f"MATCH (f) WHERE {where} RETURN f.id", nodes, edges)))
    assert ask("f.nothing = 'x'") == ask("g.name = 'a'") == ask("f.name > 'A'") == ask("f.complexity = 'x'") == ask("f.exported > 'true'") == 0
    assert ask("f.name = 'A'") == 1 and ask("f.name IN ' A |b'") == 2 and ask("f.exported = 'no'") == 1 and ask("f.startLine <= 1 AND f.loop_depth = 0") == 2
    assert values(query_graph("MATCH (f) RETURN f.nothing LIMIT 1", nodes, edges)) == [(None,)]


def test_caps_and_totals(spark):
    nodes, edges = graph(spark, [f"n{i}" for i in range(30)], [])
    assert query_total("MATCH (f) RETURN f.id LIMIT 3", nodes, edges, 10) == (30, True)
    assert len(values(query_graph("MATCH (f) RETURN f.id", nodes, edges, 10))) == 10
    assert len(values(query_graph("MATCH (f) RETURN f.id LIMIT 3", nodes, edges, 10))) == 3


def test_no_row_is_lost_without_a_limit(spark):
    nodes, edges = graph(spark, [f"n{i}" for i in range(5_001)], [(f"n{i}", f"n{i}") for i in range(5_001)])
    assert query_graph("MATCH (f) RETURN f.id", nodes, edges).count() == 5_001
    assert query_graph("MATCH (f)-[:calls]->(f) RETURN f.id, COUNT(*)", nodes, edges).count() == 5_001
    assert query_graph("MATCH (f) RETURN f.id LIMIT 5001", nodes, edges).count() == 5_001
    assert query_total("MATCH (f) RETURN f.id", nodes, edges) == (5_001, False)


@pytest.mark.parametrize(
    "text",
    ["", "MATCH", "MATCH (f)", "MATCH (f) RETURN f", "MATCH () RETURN f.id", "MATCH (f)-[:a-b]->(g) RETURN f.id", "MATCH (f) RETURN f.id LIMIT x", "MATCH (f) RETURN f.id more", "MATCH (f) WHERE f.name = 'x RETURN f.id", "MATCH (f) WHERE f.name ~ 'x' RETURN f.id", "MATCH (f)-[:x*1...3]->(g) RETURN f.id"],
)
def test_what_is_no_query(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_quoted_names_and_trees():
    s = parse("MATCH (a:`http-route`)-[:`depends-on`*2..]->(b) RETURN a.id")
    assert s.start == Node("a", "http-route") and s.hops == (Hop("depends-on", 2, 10, Node("b", None), True),)


def test_reach_stops_at_named_nodes(spark):
    _, edges = graph(spark, "abcde", CHAIN)
    start = spark.createDataFrame([("a",)], "node string")
    wall = spark.createDataFrame([("c",)], "node string")
    assert {(r.node, r.depth) for r in reachable(edges, start, 9, wall).collect()} == {("b", 1), ("c", 2)}


def test_order_of_rows_does_not_matter(spark):
    nodes, edges = graph(spark, "abcde", [*CHAIN, ("a", "c"), ("e", "a")])
    ask = "MATCH (x)-[:calls*1..2]->(y) RETURN x.name, COUNT(*), COLLECT(y.name) ORDER BY COUNT(*) DESC"
    assert values(query_graph(ask, nodes, edges)) == values(query_graph(ask, nodes.repartition(3, "name"), edges.repartition(2, "dst")))


def test_starts_walk_together(spark, monkeypatch):
    """300 starts, more than one row holds, are a few rows for each node while they walk, and the same pairs at the end."""
    from strandline.operators import traverse

    written, put = [], traverse.Scratch.put

    def watched(self, name, df):
        out = put(self, name, df)
        written.append(out.count() if name.startswith("d") else 0)
        return out

    monkeypatch.setattr(traverse.Scratch, "put", watched)
    edges = [(f"s{i}", f"m{j}") for i in range(300) for j in range(3)] + [("m0", "s7"), ("m1", "end"), ("end", "s299"), ("s5", "s5")]
    frame = spark.createDataFrame(edges, "src string, dst string")
    starts = spark.createDataFrame([(f"s{i}",) for i in range(300)] * 2, "node string")
    got = {(r.start, r.node): r.depth for r in reachable(frame, starts, 3).collect()}
    want = {}
    for s in {f"s{i}" for i in range(300)}:
        seen, front = {s}, {s}
        for depth in (1, 2, 3):
            front = {d for a, d in edges if a in front} - seen
            seen |= front
            want |= {(s, d): depth for d in front}
    assert got == want and max(written) <= 2 * 305
    ends = spark.createDataFrame([("end",)], "node string")
    assert {tuple(r) for r in reachable(frame, starts, 3, keep=ends).collect()} == {(s, "end", d) for (s, n), d in want.items() if n == "end"}


def test_a_walk_lets_go_of_its_shuffle_files(spark, monkeypatch):
    """Each round that goes on has freed what the rounds before wrote, and the pairs are those of any walk."""
    from strandline.runtime import Scratch

    freed = []
    monkeypatch.setattr(Scratch, "free", lambda self: freed.append(1))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    found = reachable(edges, spark.createDataFrame([("a",)], "node string"), 3)
    assert {(r.node, r.depth) for r in found.collect()} == {("b", 1), ("c", 2), ("d", 3)} and len(freed) == 4
