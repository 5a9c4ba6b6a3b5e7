"""Who calls whom: traces, impact, review, possible callers, tests that reach a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import language_family, unresolved_name
from strandline.model import confidence_of, rank
from strandline.operators.traverse import reachable, spread_max, weakest_paths

#: Edge types that impact follows, and those that a trace shows.
IMPACT_TYPES = ("calls", "depends-on")
TRACE_TYPES = ("calls", "handles-route", "calls-http-route", "references-symbol", "renders-component", "passes-prop", "binds-model", "listens-event", "uses-css-class")
#: Hops of impact, review, tests and loop depth.
IMPACT_HOPS, REVIEW_HOPS, TEST_HOPS, LOOP_HOPS = 2, 2, 6, 6


def _of_types(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return edges.filter(F.col("type").isin(*types))


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = IMPACT_HOPS) -> DataFrame:
    """(start, node, depth, confidence): what depends on each start, layer by layer.

    Files are no callers.  A node's confidence is the best of the paths that end in its layer.
    """
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("src"))
    steps = _of_types(edges, IMPACT_TYPES).join(files, "src", "left_anti").select("src", "dst", rank(F.col("confidence")).alias("rank"))
    return weakest_paths(steps, starts, hops).select("start", "node", "depth", confidence_of(F.col("rank")).alias("confidence"))


def review_callers(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, confidence): callers within two hops by their best path of either length."""
    steps = edges.filter("type = 'calls'").groupBy("src", "dst").agg(F.min(rank(F.col("confidence"))).alias("rank"))
    one = starts.select(F.col("node").alias("start")).join(steps, F.col("start") == F.col("dst")).select("start", F.col("src").alias("node"), "rank")
    far = one.withColumnRenamed("rank", "first").join(steps, F.col("node") == F.col("dst")).select("start", F.col("src").alias("node"), F.greatest("first", "rank").alias("rank"))
    best = one.union(far).filter("node <> start").groupBy("start", "node").agg(F.min("rank").alias("rank"))
    return best.select("start", "node", confidence_of(F.col("rank")).alias("confidence"), (F.col("rank") <= 2).alias("proven"))


def trace(edges: DataFrame, targets: DataFrame, inbound: bool = True, types: tuple[str, ...] = TRACE_TYPES) -> DataFrame:
    """(target, peer, type, edges, confidence, first_line): direct callers, or callees, of each target (node)."""
    own, other = ("dst", "src") if inbound else ("src", "dst")
    met = _of_types(edges, types).join(targets.select(F.col("node").alias("target")), F.col(own) == F.col("target"))
    found = met.groupBy("target", F.col(other).alias("peer"), "type").agg(F.count(F.lit(1)).alias("edges"), F.min(rank(F.col("confidence"))).alias("rank"), F.min("line").alias("first_line"))
    return found.select("target", "peer", "type", "edges", confidence_of(F.col("rank")).alias("confidence"), "first_line")


def possible_callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, calls): unresolved calls whose simple name is the node's, by nodes of its language family that are no files.

    Calls are counted by name and family before they meet the nodes, so nodes that share a name share one count.
    """
    callers = nodes.filter("kind <> 'file'").select(F.col("id").alias("src"), language_family(F.col("language")).alias("family"))
    open_calls = edges.filter("type = 'calls' and confidence = 'unresolved'").select("src", unresolved_name(F.col("dst")).alias("name")).join(callers, "src")
    by_caller = open_calls.groupBy("name", "family", "src").agg(F.count(F.lit(1)).alias("n"))
    counted = by_caller.groupBy("name", "family").agg(F.count(F.lit(1)).alias("callers"), F.sum("n").alias("calls"))
    return nodes.select("id", "name", language_family(F.col("language")).alias("family")).join(counted, ["name", "family"]).select("id", "callers", "calls")


def tested(nodes: DataFrame, edges: DataFrame, tests: Column, hops: int = TEST_HOPS) -> DataFrame:
    """(node, depth): what tests reach along calls, nearest first.

    One search from all tests at once, never through files: ids stand for their own start.
    """
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("node"))
    steps = edges.filter("type = 'calls'").select("src", "dst")
    sources = nodes.filter(tests).select(F.col("id"))
    # All tests are one source: an extra first step from a common start.
    hub = "tests:"
    joined = steps.union(sources.select(F.lit(hub).alias("src"), F.col("id").alias("dst")))
    start = nodes.sparkSession.createDataFrame([(hub,)], "node string")
    met = reachable(joined, start, hops + 1, files).join(sources.withColumnRenamed("id", "node"), "node", "left_anti")
    return met.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("node", (F.col("depth") - 1).alias("depth"))


def tests_for(nodes: DataFrame, edges: DataFrame, targets: DataFrame, tests: Column, hops: int = TEST_HOPS) -> DataFrame:
    """(target, test, depth): the tests that reach each target (node) along calls, nearest first; never through files."""
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("node"))
    back = edges.filter("type = 'calls'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    met = reachable(back, targets.select("node"), hops, files, nodes.filter(tests).select(F.col("id").alias("node")))
    return met.select(F.col("start").alias("target"), F.col("node").alias("test"), "depth")


def test_caller_groups(nodes: DataFrame, edges: DataFrame, targets: DataFrame, tests: Column) -> DataFrame:
    """(target, file, count, first_line, lines, names, truncated): direct test callers of each target (node) by their file.

    ``names`` are the first two in order; ``truncated`` says that there are more calls or lines than names.
    """
    met = edges.filter("type = 'calls'").join(targets.select(F.col("node").alias("target")), F.col("dst") == F.col("target"))
    met = met.select("target", "src", "line").join(nodes.filter(tests).select(F.col("id").alias("src"), "file", "name"), "src")
    found = met.groupBy("target", "file").agg(F.count(F.lit(1)).alias("count"), F.min("line").alias("first_line"), F.array_sort(F.collect_set("line")).alias("lines"), F.slice(F.array_sort(F.collect_set("name")), 1, 2).alias("names"))
    return found.withColumn("truncated", (F.col("count") > F.size("names")) | (F.size("lines") > F.size("names")))


def untested(nodes: DataFrame, edges: DataFrame, tests: Column, kinds: tuple[str, ...], hops: int = TEST_HOPS) -> DataFrame:
    """Nodes of ``kinds`` that are no tests and that no test reaches."""
    reached = tested(nodes, edges, tests, hops).select(F.col("node").alias("id"))
    return nodes.filter(F.col("kind").isin(*kinds) & ~tests).join(reached, "id", "left_anti")


def transitive_loop_depth(nodes: DataFrame, edges: DataFrame, hops: int = LOOP_HOPS) -> DataFrame:
    """(id, loop_depth, transitive_loop_depth): the deepest loop among a node and what it calls within ``hops``."""
    values = nodes.select(F.col("id").alias("node"), F.col("loop_depth").alias("own"))
    calls = edges.filter("type = 'calls'").select("src", "dst")
    done = spread_max(calls, values, hops, F.col("best"))
    return done.select(F.col("node").alias("id"), F.col("own").alias("loop_depth"), F.col("value").alias("transitive_loop_depth"))


def review_risk(changed: DataFrame) -> DataFrame:
    """``changed`` with ``score`` and ``risk``.

    Columns: signature_changed, direct_proven, proven, untested, transitive_loop_depth, linear_scan_in_loop, complexity.
    """
    points = (
        F.when(F.col("signature_changed") & (F.col("direct_proven") > 0), 2).otherwise(0)
        + F.when(F.col("transitive_loop_depth") >= 3, 2).otherwise(0)
        + F.when(F.col("linear_scan_in_loop") > 0, 2).otherwise(0)
        + F.when(F.col("complexity") >= 15, 2).when(F.col("complexity") >= 8, 1).otherwise(0)
        + F.when(F.col("untested"), 1).otherwise(0)
        + F.when(F.col("proven") >= 5, 2).when(F.col("proven") >= 1, 1).otherwise(0)
    )
    scored = changed.withColumn("score", points)
    return scored.withColumn("risk", F.when(F.col("score") >= 4, "high").when(F.col("score") >= 2, "medium").otherwise("low"))
