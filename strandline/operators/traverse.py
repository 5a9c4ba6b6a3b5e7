"""Frontier loops: breadth-first reach, weakest confidence along paths, propagation of maxima.

Each round joins the newest rows with the edges and keeps what was not there
before.  The visited rows are written once a round (see ``runtime.Scratch``), so
plans stay short and a lost executor costs one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import Scratch


#: Starts that one row of a walk holds, as bits of so many words of 64.
WORDS = 4
SPAN = WORDS * 64


def reachable(edges: DataFrame, starts: DataFrame, rounds: int, through: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """(start, node, depth): nodes within ``rounds`` edges (src, dst) of each of ``starts`` (node), each at its least depth.

    A start is not its own result.  ``through`` (node) names nodes that may be
    reached but are not passed, ``keep`` (node) those that are wanted; parallel
    edges and cycles change nothing.  Starts walk together: a row is a node with
    the starts, SPAN at most, that have come to it, as bits, and is made into
    pairs only at the end.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    steps = scratch.put("edges", edges.select("src", "dst").distinct())
    own = scratch.put("own", starts.select("node").distinct())
    scratch.free()
    # Ids that differ in their last digits lie together, as they often walk to the same nodes.
    order = [F.length("node"), F.col("node")]
    dealt = own.repartitionByRange(max(1, -(-own.count() // 65_536)), *order).sortWithinPartitions(*order).select("node", F.monotonically_increasing_id().alias("at"))
    numbered = scratch.put("starts", dealt.select("node", F.floor(F.col("at") / SPAN).alias("chunk"), (F.col("at") % SPAN).cast("int").alias("slot")))
    names = numbered.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "node"))), lambda x: x["node"]).alias("names"))
    words = range(WORDS)
    fresh = F.greatest(*[(F.col(f"n{w}") != 0).cast("int") for w in words]) == 1
    bit = lambda w: F.when(F.floor(F.col("slot") / 64) == w, F.expr("shiftleft(1L, slot % 64)")).otherwise(F.lit(0).cast("bigint"))
    none = lambda x: [F.lit(0).cast("bigint").alias(f"{x}{w}") for w in words]
    state = scratch.put("d0", numbered.select("node", "chunk", *[bit(w).alias(f"n{w}") for w in words], *[bit(w).alias(f"s{w}") for w in words]))
    layers = []
    for depth in range(1, rounds + 1):
        front = state.filter(fresh).select("node", "chunk", *[f"n{w}" for w in words])
        front = front if through is None else front.join(through, "node", "left_anti")
        met = front.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("at"), "chunk").agg(*[F.bit_or(f"n{w}").alias(f"n{w}") for w in words])
        both = met.select(F.col("at").alias("node"), "chunk", *[f"n{w}" for w in words], *none("s")).unionByName(state.select("node", "chunk", *none("n"), *[f"s{w}" for w in words]))
        whole = both.groupBy("node", "chunk").agg(*[F.bit_or(f"{x}{w}").alias(f"{x}{w}") for x in "ns" for w in words])
        here, seen = (lambda w: F.col(f"n{w}")), (lambda w: F.col(f"s{w}"))
        after = whole.select("node", "chunk", *[here(w).bitwiseAND(F.bitwise_not(seen(w))).alias(f"n{w}") for w in words], *[here(w).bitwiseOR(seen(w)).alias(f"s{w}") for w in words])
        state = scratch.put(f"d{depth}", after)
        newest = state.filter(fresh)
        if newest.isEmpty():
            break
        scratch.free()
        layers.append(newest.select("node", "chunk", *[f"n{w}" for w in words], F.lit(depth).alias("depth")))
    found = _union(layers) if layers else state.filter(fresh & F.lit(False)).select("node", "chunk", *[f"n{w}" for w in words], F.lit(0).alias("depth"))
    found = found if keep is None else found.join(keep, "node", "left_semi")
    slots = F.concat(*[F.expr(f"transform(filter(sequence(0, 63), i -> getbit(n{w}, i) = 1), i -> i + {64 * w + 1})") for w in words])
    return found.join(names, "chunk").select(F.explode(F.transform(slots, lambda i: F.element_at("names", i))).alias("start"), "node", "depth")


def _union(layers: list[DataFrame]) -> DataFrame:
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out


def weakest_paths(edges: DataFrame, starts: DataFrame, rounds: int) -> DataFrame:
    """(start, node, depth, rank): layers of first discovery against the edges (src, dst, rank).

    ``rank`` is the best over the paths that end in that layer, a path being as weak
    as its weakest edge.  Starts are not results.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    steps = scratch.put("edges", edges.groupBy("src", "dst").agg(F.min("rank").alias("weight")))
    newest = scratch.put("d0", starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.lit(1).alias("rank")).distinct())
    layers = [newest]
    for depth in range(1, rounds + 1):
        met = newest.join(steps, F.col("node") == F.col("dst")).groupBy("start", F.col("src").alias("found")).agg(F.min(F.greatest("rank", "weight")).alias("rank"))
        met = met.withColumnRenamed("found", "node").join(_union(layers).select("start", "node"), ["start", "node"], "left_anti")
        newest = met.select("start", "node", F.lit(depth).alias("depth"), "rank")
        if depth < rounds:
            newest = scratch.put(f"d{depth}", newest)
            if newest.isEmpty():
                break
        layers.append(newest)
    return _union(layers[1:]) if len(layers) > 1 else layers[0].filter("depth > 0")


def spread_max(edges: DataFrame, values: DataFrame, rounds: int, combine: Column) -> DataFrame:
    """(node, own, value) after synchronous rounds: ``combine`` over own ``own`` and the callees' best ``best``.

    ``values`` has (node, own); ``edges`` (src, dst) point from caller to callee.
    """
    scratch = Scratch(edges.sparkSession, "spread")
    steps = scratch.put("edges", edges.select("src", "dst").distinct())
    state = scratch.put("r0", values.select("node", "own", F.col("own").alias("value")))
    for k in range(1, rounds + 1):
        best = steps.join(state.select(F.col("node").alias("dst"), "value"), "dst").groupBy(F.col("src").alias("node")).agg(F.max("value").alias("best"))
        after = state.join(best, "node", "left").select("node", "own", F.greatest("value", combine).alias("value"))
        state_after = scratch.put(f"r{k}", after)
        scratch.drop(f"r{k - 1}") if k > 1 else None
        state = state_after
    return state
