"""Graph operators on small cases, and every query with SQL against that SQL."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from strandline import code_queries, queries  # noqa: F401
from strandline.functions import text as fn
from strandline.operators import impact, intervals, quality, rank, rdf, routes, search, summary
from strandline.sources.graph_view import GraphView

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(x) for x in r]) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pagerank_equals_numpy(spark):
    links = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 1.0), ("a", "e", 1.0)]
    names = "abcde"
    got = rank.pagerank(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame([(n, 0.2) for n in names], "node string, personal double"))
    m = np.zeros((5, 5))
    for s, d, w in links:
        m[names.index(d), names.index(s)] += w
    out = m.sum(0)
    r = np.full(5, 0.2)
    for _ in range(200):
        r = 0.15 * 0.2 + 0.85 * (np.divide(m, out, where=out > 0, out=np.zeros_like(m)) @ r + r[out == 0].sum() * 0.2)
    found = {x.node: x["rank"] for x in got.collect()}
    assert [found[n] for n in names] == pytest.approx(r.tolist(), abs=1e-6)


def test_communities_and_their_parts(spark):
    links = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.1)]
    edges = spark.createDataFrame(links, "src string, dst string, weight double")
    found = {r.node: r.community for r in rank.communities(edges).collect()}
    assert {found[n] for n in "abcd"} == {"a"} and {found[n] for n in "wxyz"} == {"w"}
    seven = spark.createDataFrame([(n, "7") for n in "0123"], "node string, community string")
    pairs = spark.createDataFrame([("0", "1"), ("2", "3")], "src string, dst string")
    assert {(r.node, r.part) for r in rank.refined(pairs, seven).collect()} == {("0", "0"), ("1", "0"), ("2", "2"), ("3", "2")}
    tight = {r.community: r.cohesion for r in rank.cohesion(edges, spark.createDataFrame(list(found.items()), "node string, community string")).collect()}
    assert tight["a"] == pytest.approx(6 / 6.1)


def test_boundaries_and_names(spark):
    member = spark.createDataFrame([("src/a.go", "A"), ("src/b.go", "A"), ("lib/c.go", "B"), ("x/d.go", "B"), ("y/e.go", "B")], "node string, community string")
    graph = spark.createDataFrame([("src/a.go", "lib/c.go", "calls", 2.0, 2), ("src/b.go", "lib/c.go", "imports", 3.0, 1), ("src/a.go", "src/b.go", "calls", 9.0, 9)], "src_file string, dst_file string, type string, weight double, edges bigint")
    assert [tuple(r) for r in rank.boundaries(graph, member).collect()] == [("A", "B", 5.0, 3, ["imports", "calls"])]
    ranks = spark.createDataFrame([("src/b.go", 0.9), ("y/e.go", 0.5)], "node string, rank double")
    assert {tuple(r) for r in rank.community_names(member, ranks).collect()} == {("A", "src: b + a"), ("B", "e + c")}
    nodes = spark.createDataFrame([("main", "function", "x/d.go"), ("f", "function", "app.py"), ("g", "function", "src/a.go")], "name string, kind string, file string")
    assert [r.file for r in rank.entry_points(nodes, ranks).collect()] == ["app.py", "x/d.go"]


def test_search_points(spark):
    row = spark.range(1).select(
        search.support_penalty(queries.F.lit("examples/a.py")).alias("a"), search.support_penalty(queries.F.lit("src/a.py")).alias("b"), search.path_score(queries.F.lit("src/user/UserStore.go"), ["user", "store"], {"user": 80}).alias("c"),
        search.rare_cluster(queries.F.array(queries.F.lit("x"), queries.F.lit("y")), {"x": 300, "y": 401, "z": 10}).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (3000, 0, 2 * 18 + 2 * 28 + 10 + 16, 900)
    assert search.low_signal(["a", "b"], {"a": 10}, 1) and not search.low_signal(["a"], {"a": 10}, 1) and search.low_confidence(["a", "b", "c"], 1) and not search.low_confidence(["a"], 0)


def test_co_change(spark):
    commits = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "commit int, file string")
    assert [tuple(r) for r in summary.cochange(commits).filter("file = 'a'").collect()] == [("a", "b", 2)]


def test_coverage(spark):
    nodes = spark.createDataFrame([("compute", "f", 1, 3), ("never", "f", 4, 6), ("other", "g", 1, 2)], "id string, file string, start_line int, end_line int")
    hits = spark.createDataFrame([("f", 1, 5), ("f", 2, 5), ("f", 4, 0), ("f", 5, 0)], "file string, line int, hits int")
    assert {tuple(r) for r in intervals.coverage_verdict(nodes, hits).collect()} == {("compute", True, True), ("never", True, False), ("other", False, False)}


def test_gates():
    card = {m: 5.0 for m in quality.METRICS}
    assert quality.broken_gates(card, "dead_code<=4, untested_pct<=5") == [("dead_code", 5.0, 4.0)]
    for bad in ("dead_code<=nan", "what<=1", "dead_code<1", ",".join(["dead_code<=1"] * 21)):
        with pytest.raises(ValueError):
            quality.parse_gates(bad)


def test_shapes(spark):
    code = "def {0}(x):\n  y = {1}\n  for i in x:\n    y += i * {1}\n  if y > 3:\n    return y\n  return None"
    lines = [(n, i, t) for n, src in (("a", code.format("f", 1)), ("b", code.format("g", 22)), ("c", "x = 1")) for i, t in enumerate(src.split("\n"))]
    found = {r.id: r.shape_hash for r in quality.shapes(spark.createDataFrame(lines, "id string, line int, text string")).collect()}
    assert set(found) == {"a", "b"} and found["a"] == found["b"]


def test_routes(spark):
    calls = spark.createDataFrame([(1, "GET", "/api/users/:"), (2, "GET", "/users/:"), (3, "POST", "/x"), (4, "GET", "/users/list")], "call int, method string, path string")
    handlers = spark.createDataFrame([("r1", "GET", "/users/:"), ("r2", "GET", "/users/:"), ("r3", "GET", "/api/users/:")], "route string, method string, path string")
    assert {tuple(r) for r in routes.match_routes(calls, handlers).collect()} == {(1, "r3", "exact"), (2, "r1", "heuristic"), (2, "r2", "heuristic")}
    with pytest.raises(ValueError):
        routes.find_route(handlers, "not-a-route")


def test_search_terms_and_phrases():
    assert search.query_terms("how to validate the HTTPServer2 stories") == ["validate", "httpserver", "2", "story", "validation", "validator", "valid"]
    assert search.exact_phrases("GET /signing/:id uses previewEnvelope and data-id of text/html \"a b\" sh:path") == {
        "a b": 900, "/signing/:id": 1000, "previewEnvelope": 700, "data-id": 700, "text/html": 800, "sh:path": 850,
    }


def test_terms(spark):
    iris = spark.createDataFrame([("http://x/a#B",), ("http://x/a/c",), ("http://y/ q",)], "iri string")
    prefixes = spark.createDataFrame([("x", "http://x/"), ("xa", "http://x/a#"), ("y", "http://y/")], "prefix string, iri string")
    assert {r.iri: r.term for r in rdf.compact_iris(iris, prefixes).collect()} == {"http://x/a#B": "xa:B", "http://x/a/c": "http://x/a/c", "http://y/ q": "http://y/ q"}
    assert rdf.derived_identifiers("sh", "targetClass") == ["shTargetClass", "SH_TARGET_CLASS", "sh_targetClass", "SHTargetClass", "targetClass"]


def test_review_risk(spark):
    rows = [(True, 1, 5, True, 3, 1, 20), (False, 0, 0, False, 0, 0, 1), (False, 1, 1, True, 0, 0, 8)]
    frame = spark.createDataFrame(rows, "signature_changed boolean, direct_proven int, proven int, untested boolean, transitive_loop_depth int, linear_scan_in_loop int, complexity int")
    assert [(r.score, r.risk) for r in impact.review_risk(frame).collect()] == [(11, "high"), (0, "low"), (3, "medium")]


def test_scalars(spark):
    row = spark.range(1).select(
        fn.route_path(queries.F.lit("https://h.x/a//b/:id/${y}/?q#z")).alias("r"), fn.is_test_path(queries.F.lit("src/foo_test.go")).alias("t"), fn.branches(queries.F.lit("if (a && b) for x ?? y")).alias("b"),
        fn.unresolved_name(queries.F.lit("unresolved:a.b::c#d")).alias("n"), fn.one_decimal(queries.F.lit(2.25)).alias("d"),
    ).first()
    assert (row.r, row.t, row.b, row.n, row.d) == ("/a/b/:/:", True, 4, "d", 2.3)


def test_batch_trace_equals_single_traces(spark):
    g = GraphView(spark, SF)
    starts = g.parts.limit(5).select(queries.F.col("id").alias("node")).cache()
    whole = {tuple(r) for r in impact.trace(g.calls, starts).collect()}
    single = {tuple(r) for s in starts.collect() for r in impact.trace(g.calls, spark.createDataFrame([(s.node,)], "node string")).collect()}
    assert whole == single


def test_possible_callers_are_counted_before_they_meet_the_nodes(spark):
    nodes = spark.range(3_000).selectExpr("concat('n', id) as id", "'same' as name", "'function' as kind", "'python' as language")
    edges = spark.range(6_000).selectExpr("concat('n', id % 2000) as src", "'unresolved:same' as dst", "'calls' as type", "'unresolved' as confidence")
    found = impact.possible_callers(nodes, edges)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # no row for each pair of a call and a node
    assert [tuple(r) for r in found.select("callers", "calls").distinct().collect()] == [(2_000, 6_000)] and found.count() == 3_000


def test_documents_of_the_same_tokens_share_a_vector(spark):
    from strandline.operators import semantic

    docs = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["b", "a", "b"]), (3, ["a", "b", "b"]), (4, ["c"]), (5, [])], "id int, tokens array<string>")
    words = {r.token: (r.df, r.vector) for r in semantic.token_vectors(docs).collect()}
    near = semantic.base_vector("a") + semantic.CONTEXT_SCALE / 30 * 6 * semantic.base_vector("b")
    assert {t: n for t, (n, _) in words.items()} == {"a": 3, "b": 3, "c": 1} and np.allclose(words["a"][1], near)
    made = semantic.document_vectors(docs, semantic.token_vectors(docs))
    found = {r.id: list(r.vector) for r in made.collect()}
    assert set(found) == {1, 2, 3, 4} and found[1] == found[2] == found[3] != found[4]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # vectors are added up for each set of tokens, not for each document


def test_moves_are_those_of_one_node_at_a_time():
    """Blocks give what the plain loop gives, of which each choice reads all edges."""

    def plain(links, passes=100):
        n = len(links)
        community, strength = list(range(n)), [float(sum(x.values())) for x in links]
        inside, total = list(strength), sum(strength)
        for _ in range(passes):
            before = list(community)
            for i, near in enumerate(links):
                weights = {}
                for other, w in near.items():
                    weights[community[other]] = weights.get(community[other], 0.0) + w
                own = community[i]
                inside[own] -= strength[i]
                gain = lambda c: weights.get(c, 0.0) - inside[c] * strength[i] / total  # noqa: B023, E731
                best = min({own, *weights}, key=lambda c: (-gain(c), c))  # noqa: B023
                community[i] = best if gain(best) > gain(own) + 1e-12 else own
                inside[community[i]] += strength[i]
            if community == before:
                break
        return community

    draw = np.random.default_rng(7)
    for n, many, most in ((3, 12, 1), (40, 90, 1), (700, 3000, 3), (1500, 12000, 2)):
        links = [{} for _ in range(n)]
        for a, b, w in zip(draw.integers(0, n, many).tolist(), draw.integers(0, n, many).tolist(), draw.integers(1, most + 1, many).tolist(), strict=True):
            if a != b:
                links[a][b] = links[b][a] = links[a].get(b, 0.0) + w
        links = [dict(sorted(x.items())) for x in links]
        starts = np.cumsum([0] + [len(x) for x in links])
        ends, weight = np.array([b for x in links for b in x], dtype=np.int64), np.array([w for x in links for w in x.values()], dtype=float)
        assert rank.move_locally(starts, ends, weight).tolist() == plain(links), n


def test_components_read_all_edges_once(spark, monkeypatch):
    """A path in shuffled order, a star around a large node, a pair and a lone node; a path of 600 nodes takes one round."""
    links = [(f"p{a:03d}", f"p{a + 1:03d}") for a in range(599)] + [("z", f"s{i}") for i in range(9)] + [("y1", "y0"), ("y0", "y0")]
    nodes = sorted({x for e in links for x in e} | {"lone"})
    written = []
    put = rank.Scratch.put
    monkeypatch.setattr(rank.Scratch, "put", lambda self, name, df: written.append(name) or put(self, name, df))
    found = {r.node: r.component for r in rank.components(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    assert found == {n: "p000" if n[0] == "p" else "s0" if n[0] in "sz" else "y0" if n[0] == "y" else "lone" for n in nodes}
    assert [x for x in written if x[0] == "l"] == ["l0", "l1", "l2"]


def test_communities_keep_each_edge_once(spark, monkeypatch):
    written = {}
    put = rank.Scratch.put
    monkeypatch.setattr(rank.Scratch, "put", lambda self, name, df: written.setdefault(name, put(self, name, df)))
    edges = spark.createDataFrame([("b", "a", 1.0), ("a", "b", 2.0), ("c", "b", 1.0), ("c", "c", 5.0)], "src string, dst string, weight double")
    found = {r.node: r.community for r in rank.communities(edges).collect()}
    assert set(found) == {"a", "b", "c"}
    assert sorted(tuple(r) for r in written["edges"].collect()) == [("a", "b", 3.0), ("b", "c", 1.0)]
