"""Personalised PageRank, hotspots, and communities by modularity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import directory
from strandline.runtime import Scratch

#: Damping, tolerance in L1, rounds.
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 100


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(node, rank) of ``nodes`` (node, personal) over weighted edges (src, dst, weight).

    ``personal`` sums to one.  The rank of nodes without edges out goes back by
    ``personal``.  Rounds stop when the ranks move by less than ``tolerance`` in all.
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    known = scratch.put("nodes", nodes.select("node", "personal"))
    total = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = scratch.put("shares", edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    ends = scratch.put("ends", known.join(shares.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node"))
    state = scratch.put("r0", known.select("node", "personal", F.col("personal").alias("rank"), F.lit(0.0).alias("moved")))
    for k in range(1, rounds + 1):
        loose = state.join(ends, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("x")).first()["x"]
        given = state.join(shares, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        fresh = (1 - damping + damping * loose) * F.col("personal") + damping * F.coalesce("given", F.lit(0.0))
        after = state.join(given, F.col("node") == F.col("dst"), "left").select("node", "personal", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("moved"))
        after = scratch.put(f"r{k}", after)
        scratch.drop(f"r{k - 1}")
        state = after
        if (state.agg(F.sum("moved").alias("m")).first()["m"] or 0.0) < tolerance:
            break
    return state.select("node", "rank")


def hotspots(ranks: DataFrame, graph: DataFrame, nodes: DataFrame, n: int = 20) -> DataFrame:
    """(file, score): a millionfold rank, 30 for each edge in, 10 for each edge out, 20 for each point of complexity."""
    ends = graph.select(F.col("dst_file").alias("file"), F.col("edges").alias("inbound"), F.lit(0).alias("outbound")).union(graph.select("src_file", F.lit(0), "edges"))
    met = ends.groupBy("file").agg(F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound"))
    weight = nodes.groupBy("file").agg(F.sum("complexity").alias("complexity"))
    found = ranks.select(F.col("node").alias("file"), "rank").join(met, "file", "left").join(weight, "file", "left").na.fill(0, ["inbound", "outbound", "complexity"])
    score = F.floor(F.col("rank") * 1_000_000) + F.col("inbound") * 30 + F.col("outbound") * 10 + F.col("complexity") * 20
    return found.select("file", score.cast("bigint").alias("score"), "inbound", "outbound", "complexity").orderBy(F.desc("score"), "file").limit(n)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, edges taken both ways; ``nodes`` (node) without edges are their own.

    Each node points to its least smaller neighbour, pointers are followed to their ends, and the edges are drawn anew
    between those ends: only the first round reads all edges.  ``nodes`` holds the ends of all edges.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = lambda df: df.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    links = scratch.put("l0", pairs(edges))
    state = scratch.put("c0", nodes.select("node", F.col("node").alias("component")))
    k = 0
    while not links.isEmpty():
        k += 1
        up, steps = scratch.put("u0", links.groupBy("src").agg(F.min("dst").alias("up"))), 0
        while True:
            steps += 1
            onward = up.select(F.col("src").alias("at"), F.col("up").alias("onward"))
            after = scratch.put(f"u{steps}", up.join(onward, F.col("up") == F.col("at"), "left").select("src", F.coalesce("onward", "up").alias("up"), F.col("at").isNotNull().alias("moved")))
            scratch.drop(f"u{steps - 1}")
            if after.filter("moved").isEmpty():
                break
            up = after.select("src", "up")
        ends = lambda x: after.select(F.col("src").alias(f"{x}_at"), F.col("up").alias(f"{x}_up"))  # noqa: B023, E731
        met = links.join(ends("s"), F.col("src") == F.col("s_at")).join(ends("d"), F.col("dst") == F.col("d_at"), "left")
        links = scratch.put(f"l{k}", pairs(met.select(F.col("s_up").alias("src"), F.coalesce("d_up", "dst").alias("dst"))))
        state = scratch.put(f"c{k}", state.join(ends("n"), F.col("component") == F.col("n_at"), "left").select("node", F.coalesce("n_up", "component").alias("component")))
        scratch.drop(f"l{k - 1}", f"c{k - 1}", f"u{steps}")
    return state


#: Nodes whose choices are made together, before the moves among them are applied.
BLOCK = 512


def _choices(starts: np.ndarray, held: np.ndarray, weight: np.ndarray, own: np.ndarray, k: np.ndarray, total: float, inside: np.ndarray) -> tuple[list, list, np.ndarray, np.ndarray]:
    """(choice, margin, node, community) of some nodes as things stand: the community with the largest gain, and how far the next one is behind.

    ``held`` and ``weight`` are the communities and weights of their edges, ``starts`` where each node's begin; the last
    two columns are all pairs of a node and a community at hand.  Of equal gains any is the choice, with margin zero.
    """
    n = len(own)
    # The own community is always at hand, with or without an edge to it.
    row = np.concatenate([np.repeat(np.arange(n), np.diff(starts)), np.arange(n)])
    key = row * len(inside) + np.concatenate([held, own])
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    w = np.bincount(np.cumsum(new) - 1, weights=np.concatenate([weight, np.zeros(n)])[order])
    row, held = np.divmod(key[new], len(inside))
    gain = w - (inside[held] - np.where(held == own[row], k[row], 0.0)) * k[row] / total
    first = np.searchsorted(row, np.arange(n))
    best = np.maximum.reduceat(gain, first)
    where = np.flatnonzero(gain == best[row])
    where = where[np.searchsorted(row[where], np.arange(n))]
    gain[where] = -np.inf
    return held[where].tolist(), (best - np.maximum.reduceat(gain, first)).tolist(), row, held


def move_locally(starts: np.ndarray, ends: np.ndarray, weight: np.ndarray, passes: int = 100) -> np.ndarray:
    """Greedy modularity: each node in turn joins the neighbour community with the largest gain, the lower number on a tie.

    The edges of node ``i`` are ``ends`` and ``weight`` from ``starts[i]`` to ``starts[i + 1]``, given both ways.  Nodes
    move one at a time.  The choices of a block are made together; one is taken over only if no move since then can have
    changed it: no neighbour moved, and its margin is beyond what the choice has grown and the others at hand have
    shrunk.  Any other node looks at its edges when its turn comes.
    """
    n = len(starts) - 1
    strength = np.bincount(np.repeat(np.arange(n), np.diff(starts)), weights=weight, minlength=n)
    total = float(strength.sum())
    at, degree = np.arange(n), strength.tolist()
    community, inside, bounds = at.tolist(), strength.tolist(), starts.tolist()
    for _ in range(passes if total else 0):
        moved = False
        for low in range(0, n, BLOCK):
            high = min(n, low + BLOCK)
            a, b = bounds[low], bounds[high]
            choice, margin, node, hand = _choices(starts[low : high + 1], at[ends[a:b]], weight[a:b], at[low:high], strength[low:high], total, np.array(inside))
            stale: set[int] = set()  # nodes with a neighbour that moved
            eased: set[int] = set()  # nodes, from the block's first, with a community at hand that has shrunk
            grown: dict[int, float] = {}
            shrunk = 0.0
            for i in range(low, high):
                own, k, best = community[i], degree[i], choice[i - low]
                if i in stale or margin[i - low] <= (grown.get(best, 0.0) + (shrunk if i - low in eased else 0.0)) * k / total + 1e-9:
                    weights: dict[int, float] = {}
                    for other, w in zip(ends[bounds[i] : bounds[i + 1]].tolist(), weight[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                        c = community[other]
                        weights[c] = weights.get(c, 0.0) + w
                    best, most = own, (stays := weights.get(own, 0.0) - (inside[own] - k) * k / total)
                    for c, w in weights.items():
                        if w >= most and c != own and ((gain := w - inside[c] * k / total) > most or (gain == most and c < best)):
                            best, most = c, gain
                    best = best if most > stays + 1e-12 else own
                if best != own:
                    moved = True
                    community[i] = at[i] = best
                    inside[own] -= k
                    inside[best] += k
                    grown[own], grown[best] = grown.get(own, 0.0) - k, grown.get(best, 0.0) + k
                    shrunk = max(shrunk, -grown[own])
                    eased.update(node[hand == own].tolist())
                    stale.update(ends[bounds[i] : bounds[i + 1]].tolist())
        if not moved:
            break
    return at


def communities(edges: DataFrame, passes: int = 100) -> DataFrame:
    """(node, community) over weighted edges (src, dst, weight), taken both ways; named by the least node.

    Local moving is sequential, so it runs once for each connected component: no
    component's result depends on another's.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    # An edge is kept one way only, until the task that holds its component.
    once = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    once = scratch.put("edges", once)
    nodes = once.select(F.col("src").alias("node")).union(once.select("dst")).distinct()
    part = components(once, nodes)

    def run(found: pa.Table) -> pa.Table:
        src, dst = (found.column(x).combine_chunks() for x in ("src", "dst"))
        names = pc.unique(pa.concat_arrays([src, dst]))
        names = names.take(pc.sort_indices(names))  # by code points
        a, b = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((b, a))
        weight = np.tile(found.column("weight").to_numpy().astype(float), 2)[order]
        starts = np.searchsorted(a[order], np.arange(len(names) + 1))
        _, first, which = np.unique(move_locally(starts, b[order], weight, passes), return_index=True, return_inverse=True)
        return pa.table({"node": names, "community": names.take(pa.array(first[which]))})

    met = once.join(part.hint("merge"), F.col("src") == F.col("node")).select("component", "src", "dst", "weight")
    # A component takes long for its bytes, so Spark, which joins small partitions, would leave cores idle; a given number stays.
    dealt = met.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component")
    return dealt.groupBy("component").applyInArrow(run, "node string, community string")


def refined(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, community, part): communities (node, community) split where they hang together by no edge of their own."""
    side = lambda x: membership.select(F.col("node").alias(x), F.col("community").alias(f"{x}_c"))
    own = edges.join(side("src"), "src").join(side("dst"), "dst").filter("src_c = dst_c").select("src", "dst")
    return membership.join(components(own, membership.select("node")), "node").select("node", "community", F.col("component").alias("part"))


def cohesion(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, nodes, internal, external, cohesion): the share of a community's edge weight that stays inside."""
    side = lambda x: membership.select(F.col("node").alias(x), F.col("community").alias(f"{x}_c"))
    met = edges.join(side("src"), "src").join(side("dst"), "dst")
    same = F.col("src_c") == F.col("dst_c")
    rows = met.select(F.col("src_c").alias("community"), F.when(same, F.col("weight")).otherwise(0.0).alias("internal"), F.when(same, 0.0).otherwise(F.col("weight")).alias("external"))
    rows = rows.union(met.filter(~same).select("dst_c", F.lit(0.0), "weight"))
    found = rows.groupBy("community").agg(F.sum("internal").alias("internal"), F.sum("external").alias("external"))
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.join(found, "community").withColumn("cohesion", F.col("internal") / (F.col("internal") + F.col("external")))


def boundaries(graph: DataFrame, membership: DataFrame) -> DataFrame:
    """(src_community, dst_community, weight, edges, types): what ties communities (node, community) of files together, by edge type."""
    side = lambda x: membership.select(F.col("node").alias(f"{x}_file"), F.col("community").alias(f"{x}_community"))
    met = graph.join(side("src"), "src_file").join(side("dst"), "dst_file").filter("src_community <> dst_community")
    typed = met.groupBy("src_community", "dst_community", "type").agg(F.sum("weight").alias("weight"), F.sum("edges").alias("edges"))
    one = F.struct((-F.col("weight")).alias("w"), "type", "edges")
    return typed.groupBy("src_community", "dst_community").agg(F.sum("weight").alias("weight"), F.sum("edges").alias("edges"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["type"]).alias("types"))


def community_names(membership: DataFrame, ranks: DataFrame) -> DataFrame:
    """(community, name): the folder of half the files or more, and the stems of the two files of highest rank (node, rank)."""
    folder = directory(F.col("node"))
    stem = F.regexp_replace(F.element_at(F.split("node", "/"), -1), r"\.[^.]*$", "")
    rows = membership.join(ranks, "node", "left").select("community", folder.alias("folder"), stem.alias("stem"), F.coalesce("rank", F.lit(0.0)).alias("rank"), "node")
    size = rows.groupBy("community").agg(F.count(F.lit(1)).alias("files"))
    folders = rows.groupBy("community", "folder").agg(F.count(F.lit(1)).alias("n"))
    main = folders.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder")).alias("x"), F.count(F.lit(1)).alias("folders"))
    best = rows.groupBy("community", "stem").agg(F.min(F.struct((-F.col("rank")).alias("r"), "node")).alias("x"))
    w = Window.partitionBy("community").orderBy("x")
    two = best.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "stem"))), lambda x: x["stem"]), " + ").alias("label"))
    met = size.join(main, "community").join(two, "community")
    half = (F.col("folders") == 1) | (-F.col("x.n") * 2 >= F.col("files"))
    return met.select("community", F.when(half, F.concat_ws(": ", "x.folder", "label")).otherwise(F.col("label")).alias("name"))


def entry_points(nodes: DataFrame, ranks: DataFrame, limit: int = 20) -> DataFrame:
    """Files that start something, by name or by a ``main``, best ranked (node, rank) first."""
    starts = nodes.filter("name = 'main' and kind in ('function', 'method')").select("file").distinct()
    named = nodes.select("file").filter(F.col("file").rlike(r"(^|/)(main|index|app|server|cli|__main__|manage)\.[a-z]+$")).distinct()
    files = starts.union(named).distinct()
    return files.join(ranks.withColumnRenamed("node", "file"), "file", "left").orderBy(F.desc_nulls_last("rank"), "file").limit(limit)
