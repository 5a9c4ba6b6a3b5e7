"""Connected components by smallest member, as joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import Scratch, iterate


def smallest_reachable(scratch: Scratch, edges: DataFrame, name: str = "cc", rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest reachable node.

    Each round gives a node the least label of its neighbours' labels and hooks the
    node's old label to it as well (FastSV), so trees of labels merge as wholes and
    the rounds needed grow with the logarithm of the longest path.  Rounds go on
    until nothing moves; RuntimeError if that takes more than ``rounds``.  A node
    with very many neighbours is combined before the shuffle; on the join's side
    the rows of one node can be split by Spark.  An empty edge table gives an
    empty result.
    """
    both = scratch.put(f"{name}-edges", edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    start = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")).withColumn("moved", F.lit(True))

    def step(state: DataFrame) -> DataFrame:
        label = state.select("node", "label")
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        raised = label.join(up, "label").select("node", "label", "up")
        near = both.join(raised.select(F.col("node").alias("b"), "up"), "b").groupBy(F.col("a").alias("node")).agg(F.min("up").alias("near"))
        own = raised.join(near, "node")
        hooked = own.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        least = F.least("label", "up", "near", F.coalesce("hook", "label"))
        return own.join(hooked, "node", "left").select("node", least.alias("label"), (least < F.col("label")).alias("moved"))

    done = iterate(scratch, name, start, step, lambda s: not s.filter("moved").isEmpty(), rounds)
    return done.select("node", F.col("label").alias("component"))
