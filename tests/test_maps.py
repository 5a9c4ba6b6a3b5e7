"""Maps, context, reviews, meaning and search with symbols on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as fn
from strandline.operators import atlas, rdf, review, search, semantic

NODE = "id string, name string, kind string, language string, file string, start_line int, end_line int, signature string, parent_id string, exported boolean, complexity int, loop_depth int, transitive_loop_depth int, linear_scan_in_loop int"
EDGE = "src string, dst string, type string, confidence string, reason string, file string, line int"


def node(i, name, kind, file, a, b, sig="", parent="", complexity=1, deep=0, scans=0):
    return (i, name, kind, "go", file, a, b, sig or name, parent, True, complexity, deep, deep, scans)


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        node("a#run", "run", "function", "src/a.go", 1, 4, "func run(x int)"), node("a#S", "Store", "class", "src/a.go", 6, 12, "type Store"), node("a#S#get", "getItem", "method", "src/a.go", 7, 9, "func getItem()", "a#S", 20, 3, 1),
        node("b#main", "main", "function", "lib/b.go", 1, 5), node("b#help", "help", "function", "lib/b.go", 7, 8), node("t#test", "testGet", "function", "src/a_test.go", 1, 3), node("file:x", "x", "file", "lib/b.go", 1, 9),
    ]
    edges = [
        ("b#main", "a#S#get", "calls", "exact", "", "lib/b.go", 2), ("b#help", "b#main", "calls", "heuristic", "", "lib/b.go", 7), ("t#test", "a#run", "calls", "scoped", "", "src/a_test.go", 2), ("a#run", "a#run", "calls", "exact", "", "src/a.go", 2),
        ("file:x", "a#S#get", "calls", "exact", "", "lib/b.go", 9), ("a#run", "unresolved:zap", "calls", "unresolved", "missing_import", "src/a.go", 3),
    ]
    return spark.createDataFrame(nodes, NODE).cache(), spark.createDataFrame(edges, EDGE).cache()


def test_review(spark, graph):
    nodes, edges = graph
    head = [("src/a.go", 1, "func run( x  int ) {"), ("src/a.go", 7, "  func getItem() int {"), ("src/a.go", 6, "type Store"), ("lib/b.go", 1, "func main() {"), ("lib/b.go", 7, "func help() {")]
    base = [("src/a.go", 1, "func run(x int) {"), ("src/a.go", 9, "func getItem(a string) {"), ("src/a.go", 6, "type Store"), ("lib/b.go", 3, "func mainly() {")]
    lines = "file string, line int, text string"
    hunks = spark.createDataFrame([("src/a.go", 1, 8), ("lib/b.go", 1, 1)], "file string, start_line int, end_line int")
    got = {r.id: r for r in review.review(nodes, edges, hunks, spark.createDataFrame(base, lines), spark.createDataFrame(head, lines), F.col("file").contains("_test")).collect()}
    assert set(got) == {"a#run", "a#S#get", "b#main"}  # the class gives way to its method
    get = got["a#S#get"]
    assert (get.change_kind, get.proven, get.possible, get.direct_proven, get.untested, get.risk) == ("signature", 1, 1, 1, True, "high")
    assert list(get.reasons) == ["signature changed", "hot path", "scan in a loop", "high complexity", "no test", "callers"]
    assert (got["a#run"].change_kind, got["a#run"].untested, got["a#run"].proven) == ("body", False, 1) and got["b#main"].change_kind == "new"
    hits = spark.createDataFrame([("src/a.go", 8, 3), ("src/a.go", 2, 0)], "file string, line int, hits int")
    ran = {r.id: (r.untested, r.untested_by) for r in review.review(nodes, edges, hunks, spark.createDataFrame(base, lines), spark.createDataFrame(head, lines), F.col("file").contains("_test"), hits).collect()}
    assert ran == {"a#run": (True, "coverage"), "a#S#get": (False, ""), "b#main": (True, "static")}


def test_also_consider(spark):
    commits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "d")], "commit int, file string")
    changed = spark.createDataFrame([("a",)], "file string")
    assert [tuple(r) for r in review.also_consider(commits, changed).collect()] == [("b", 2), ("c", 1)]


def test_declarations(spark):
    rows = ["  foo( a,  b )  {", "func (s *S)  Run (x int)\terror", "a b c", "key :  v", "", "é  ü = 1"]
    out = spark.createDataFrame([(r,) for r in rows], "t string").select(fn.declaration(F.col("t")).alias("d")).collect()
    assert [r.d for r in out] == ["foo(a,b){", "func(s*S)Run(x int)error", "a b c", "key:v", "", "é ü=1"]


def test_masks_and_ages(spark):
    row = spark.range(1).select(
        fn.term_mask(F.array(F.lit("b"), F.lit("z")), ["a", "b", "c"]).alias("m"), fn.age_hours(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-02T01:30:00+00:00")).alias("h"), fn.age_hours(F.lit("never"), F.lit("2024-01-02T01:30:00Z")).alias("n"),
        fn.structured_estimate(F.lit("x" * 41)).alias("e"),
    ).first()
    assert (row.m, row.h, row.n, row.e) == (2, 25.5, None, 14)


def test_map_and_architecture(spark, graph):
    nodes, edges = graph
    rows = atlas.repo_map(nodes, edges, ["getItem"], architecture_too=True)
    assert [r["section"] for r in rows if r["section"] != "symbol"] == ["architecture", "file", "file", "file"]
    whole = json.loads(rows[0]["name"])
    assert whole["communities"][0]["nodes"] == 3 and whole["entry_points"] == ["lib/b.go"] and whole["languages"] == [{"files": 3, "language": "go", "symbols": 7}]
    assert sum(r["tokens"] for r in rows) + atlas.FRAME_TOKENS <= atlas.MAP_TOKENS
    few = atlas.repo_map(nodes, edges, budget=60)
    assert 0 < len(few) < 4 and sum(r["tokens"] for r in few) + atlas.FRAME_TOKENS <= 60
    long = {k: [{"n": f"{k}{i}"} for i in range(9)] for k in ("languages", "packages", "entry_points", "routes", "hotspots", "communities", "boundaries")}
    cut = atlas.trimmed(long, 200)
    assert cut["truncated"] and cut["boundaries"] == [] and len(cut["packages"]) <= 3 and cut["tokens"] <= 200


def test_context(spark, graph):
    nodes, edges = graph
    lines = spark.createDataFrame([(f, i, "x" * 8) for f, n in (("src/a.go", 12), ("lib/b.go", 9)) for i in range(1, n + 1)], "file string, line int, text string")
    target = spark.createDataFrame([("a#S#get",)], "node string")
    got = [(r.file, r.start_line, r.end_line, r.why, r.tokens) for r in atlas.fetch_context(nodes, edges, lines, target).orderBy("spent").collect()]
    assert got == [("src/a.go", 7, 9, "target", 6), ("lib/b.go", 1, 9, "caller", 18)]
    assert atlas.fetch_context(nodes, edges, lines, target, budget=10).count() == 1
    status, found = atlas.find_and_fetch(nodes, edges, lines, "help")
    assert status == "found" and found.count() == 2 and atlas.find_and_fetch(nodes, edges, lines, "nothing")[0] == "not_found"


def test_search_with_symbols(spark, graph):
    nodes, edges = graph
    lines = spark.createDataFrame([("src/a.go", 7, "func getItem() int {"), ("src/a.go", 8, "  return load()"), ("lib/b.go", 2, "  getItem()"), ("lib/b.go", 7, "help me get one")], "file string, line int, text string")
    index = search.with_symbols(search.indexed(lines), nodes).cache()
    by = {(r.file, r.line): r for r in index.collect()}
    assert by["src/a.go", 7].definition and by["src/a.go", 8].symbol_tokens == ["func", "get", "item", "store", "type"] and not by["lib/b.go", 2].definition
    plain = {(r.file, r.line): r.score for r in search.scored_lines(index, "get item").collect()}
    assert set(plain) == {("src/a.go", 7), ("src/a.go", 8), ("lib/b.go", 2), ("lib/b.go", 7)} and plain["src/a.go", 7] > plain["src/a.go", 8]
    gained = {(r.file, r.line): r.score for r in search.scored_lines(index, "get item", prefer="definitions").collect()}
    assert gained["src/a.go", 7] - plain["src/a.go", 7] == 420 and gained["lib/b.go", 2] - plain["lib/b.go", 2] == -60
    used = {(r.file, r.line): r.score for r in search.scored_lines(index, "get item", prefer="usages").collect()}
    assert used["src/a.go", 7] - plain["src/a.go", 7] == -80 and used["lib/b.go", 2] - plain["lib/b.go", 2] == 180
    hits, warnings = search.searched(index, "get item")
    assert hits[0][:2] == ("src/a.go", 7) and not warnings
    assert search.searched(index, "nowhere") == ([], ["no line holds a term"])
    assert "context" in search.query_terms("error before the request") and "context" not in search.query_terms("error of a request that fail")[:1]
    peers = {(r.id, r.side): list(r.peers) for r in search.hit_blast_radius(nodes, edges, spark.createDataFrame([("src/a.go", 8)], "file string, line int")).collect()}
    assert peers["a#S#get", "callers"] == ["b#main", "file:x"]
    files = spark.createDataFrame([("a.go", "go", "x"), ("yarn.lock", "yaml", "x"), ("big.json", "json", "x" * (2 * 1024 * 1024 + 1)), ("b.json", "json", "x"), ("z", "", "x")], "path string, language string, content string")
    assert {r.path for r in search.searchable(files).collect()} == {"a.go", "b.json"}


def test_meaning(spark):
    texts = [("a", "fetch user record from the database"), ("b", "load account row storage"), ("c", "draw pixel colour"), ("d", "paint pixel shade")]
    symbols = spark.createDataFrame(texts, "id string, text string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    nodes, words = semantic.build_index(symbols, edges)
    found = semantic.semantic_query(nodes, words, "get member from db").collect()
    assert [r.id for r in found][:1] == ["a"] and set(found[0].terms) == {"read", "user", "database"} and all(r.score >= 0.40 for r in found) and "c" not in {r.id for r in found}
    with pytest.raises(ValueError):
        semantic.semantic_query(nodes, words, "the of")
    assert semantic.CANONICAL["requeue"] == "retry" and semantic.CANONICAL["fetch"] == "read"
    flat = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [4.0, 4.0])], "id int, vector array<double>")
    moved = {r.id: list(r.vector) for r in semantic.diffused(flat, spark.createDataFrame([(1, 2), (3, 1), (1, 1)], "src int, dst int")).collect()}
    assert moved[1] == pytest.approx([1 + 0.18 * 2, 0.18 * 3]) and moved[2] == pytest.approx([0.18, 2.0])


def test_references(spark, graph):
    nodes, edges = graph
    place = lambda f, n: {"file": f, "start_line": n}
    terms = spark.createDataFrame([("t1", "http://x/A", "x:A", "x", "A", [place("v.ttl", 3)]), ("t2", "http://y/B", "y:B", "y", "B", []), ("t3", "http://z#B", "z:B", "z", "B", [place("w.ttl", 1)])], "id string, iri string, term string, prefix string, local_name string, locations array<struct<file: string, start_line: int>>")
    refs = spark.createDataFrame([("t1", "a.ts", 4, "curie", "exact"), ("t1", "a.ts", 9, "curie", "weak")], "term_id string, file string, start_line int, kind string, confidence string")
    ask = lambda q, weak=False: rdf.find_references(terms, refs, nodes, edges, q, weak)
    status, rows = ask("x:A")
    assert status == "found" and [(r.file, r.line) for r in rows.collect()] == [("a.ts", 4)] and ask("x:A", True)[1].count() == 2
    assert ask("B")[0] == "ambiguous" and {r.via for r in ask("B")[1].collect()} == {"t2", "t3"}
    status, rows = ask("getItem")  # no term has the name: the symbol's calls
    assert status == "found" and {(r.file, r.line, r.kind) for r in rows.collect()} == {("lib/b.go", 2, "call"), ("lib/b.go", 9, "call")}
    assert ask("nothing at all")[0] == "not_found"
    lines = spark.createDataFrame([("c.ts", 5, "const v = X_A"), ("c.ts", 6, "other")], "file string, line int, text string")
    assert {(r.file, r.start_line, r.why) for r in rdf.inspect_term(terms, refs, lines, "t1").collect()} == {("a.ts", 2, "reference"), ("c.ts", 3, "implementation")}
    assert [r.iri for r in rdf.rank_candidates(terms).collect()] == ["http://x/A", "http://y/B", "http://z#B"]
    grouped = rdf.grouped_by_file(rdf.trace_term(terms, refs, "t1", True)).collect()
    assert {r.file: len(r.places) for r in grouped} == {"v.ttl": 1, "a.ts": 2}


def test_candidates_are_cut_before_the_driver(spark):
    """However many tasks there are, at most GROUPS of them send candidates to the driver."""
    rows = [(f"f{i % 7}", i, i * 37 % 101) for i in range(900)]
    scored = spark.createDataFrame(rows, "file string, line int, score int").repartition(40)
    found = search.candidates(scored, 50)
    assert [tuple(r) for r in found.collect()] == sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:50]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan and search.emit_hits(scored, 2) == search.emit_hits(spark.createDataFrame(rows, scored.schema), 2)


def test_diffusion_makes_one_row_for_each_edge(spark):
    flat = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [4.0]), (4, [])], "id int, vector array<double>")
    found = semantic.diffused(flat, spark.createDataFrame([(1, 2), (3, 1), (9, 2)], "src int, dst int"))
    moved = {r.id: list(r.vector) for r in found.collect()}
    assert moved == {1: pytest.approx([1 + 0.18 * 2, 0.18 * 2]), 2: pytest.approx([0.18, 2.0]), 3: pytest.approx([4.18])}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_symbols_of_a_line_that_comes_again(spark):
    """Copies of a line, or of a symbol's range, neither multiply nor crowd out the symbols around it."""
    own = [("f", 1, 9, "a", "outer"), *[("f", 4, 6, f"s{i}", "inner") for i in range(9)]]
    nodes = spark.createDataFrame([(*r[:4], r[4], "function", r[4]) for r in own], "file string, start_line int, end_line int, id string, name string, kind string, signature string")
    lines = spark.createDataFrame([("f", 5, "x"), ("f", 5, "x"), ("f", 2, "y")], "file string, line int, text string")
    got = [(r.line, list(r.symbol_ids)) for r in search.with_symbols(search.indexed(lines), nodes).orderBy("line").collect()]
    assert got == [(2, ["a"]), (5, ["s0", "s1", "s2"]), (5, ["s0", "s1", "s2"])]


def test_code_index_is_that_of_its_lines(spark):
    from strandline import code_queries
    from strandline.sources.graph_view import GraphView

    g = GraphView(spark, "/root/testdata/sf0.001")
    rows = [sorted((r.file, r.line, r.text, tuple(r.tokens), r.length) for r in x.collect()) for x in (code_queries._code_index(g), search.indexed(code_queries._code_lines(g)))]
    assert rows[0] == rows[1] and rows[0]
