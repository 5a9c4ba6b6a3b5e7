"""Graph queries that once ran over a part of their tables."""

from strandline.queries import communities
from strandline.sources.graph_view import GraphView

SF = "/root/testdata/sf0.001"


def test_communities_hold_every_part_with_a_call(spark):
    calls = GraphView(spark, SF).resolved_calls.filter("src <> dst").select("src", "dst").collect()
    found = {r.node: r.community for r in communities(spark, SF).collect()}
    assert set(found) == {x for r in calls for x in r}
    least = {}
    for node, name in found.items():
        least[name] = min(node, least.get(name, node))
    assert all(name == node for name, node in least.items())


def test_context_sends_no_nodes_through_the_driver(spark):
    from strandline.operators import atlas
    from strandline.queries import _starts

    g = GraphView(spark, SF)
    plan = atlas.context_ranges(g.parts, g.resolved_calls, _starts(spark, SF, 100))._jdf.queryExecution()
    assert "strategy=merge" in plan.optimizedPlan().toString() and "SortMergeJoin" in plan.sparkPlan().toString()


def test_lines_meet_ranges_without_the_driver(spark):
    from pyspark.sql import functions as F

    from strandline.operators import intervals

    parts = GraphView(spark, SF).parts
    lines = parts.select("file", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    plan = intervals._in_ranges(lines, parts.select("file", "start_line", "end_line", "id"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_symbols_are_inspected_on_calls_that_are_made_once(spark):
    from pyspark.sql import functions as F

    from strandline.operators import atlas
    from strandline.queries import _starts

    g = GraphView(spark, SF)
    assert "Window" in g.calls._jdf.queryExecution().optimizedPlan().toString()
    found = atlas.inspect_symbols(g.parts, g.calls, _starts(spark, SF, 100), F.col("is_test"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
