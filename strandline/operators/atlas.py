"""Maps of a code base for a reader: ranked files and symbols, its architecture, context around symbols, within a budget of tokens.

All that is ranked, counted and joined runs on tables; a map is cut by rank and budget, as its purpose is, and
what is left of it (at most ``limit`` rows of each section) is put together on the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import structured_estimate, token_estimate
from strandline.operators import explore, impact, intervals, lookup, rank, summary
from strandline.runtime import Scratch

#: Tokens of a map, of the rest of its frame, rows of a section, and the least and most tokens of the architecture.
MAP_TOKENS, FRAME_TOKENS, MAP_ROWS, LEAST_ARCHITECTURE, MOST_ARCHITECTURE = 1_800, 24, 20, 160, 900
#: Communities and boundaries that are shown; weight of an edge between repositories.
COMMUNITIES, BOUNDARIES, CROSS_WEIGHT = 8, 12, 1.0


def ranked_files(nodes: DataFrame, edges: DataFrame, named: list[str] | None = None, query: str = "") -> tuple[DataFrame, DataFrame]:
    """((node, rank), file graph): PageRank of the files, pulled to what is named or asked for."""
    terms = explore.mentions(named or [], query)
    scratch = Scratch(nodes.sparkSession, "map")
    graph = scratch.put("graph", summary.file_graph(nodes, edges, terms))
    personal = explore.personal_weights(nodes, terms)
    return rank.pagerank(graph.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), "weight"), personal), graph


def ranked_symbols(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, name, file, score): a file's rank is shared by its symbols, by one and the number of their callers."""
    callers = edges.filter("confidence <> 'unresolved' and src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    own = nodes.filter("kind <> 'file'").join(callers, "id", "left").withColumn("share", F.lit(1.0) + F.coalesce("callers", F.lit(0)))
    total = own.groupBy("file").agg(F.sum("share").alias("total"))
    met = own.join(total, "file").join(ranks.select(F.col("node").alias("file"), "rank"), "file")
    return met.select("id", "name", "file", (F.col("rank") * F.col("share") / F.col("total")).alias("score"))


def repo_map(nodes: DataFrame, edges: DataFrame, named: list[str] | None = None, query: str = "", budget: int = MAP_TOKENS, limit: int = MAP_ROWS, architecture_too: bool = False) -> list[dict]:
    """Rows (section, name, score, tokens) of the files and symbols that matter most, in order, while they fit the budget.

    Files come before symbols; each section ends at the first row that does not fit.  With ``architecture_too``, the
    architecture takes half the budget at most, 900 tokens at most.
    """
    ranks, graph = ranked_files(nodes, edges, named, query)
    ranks = Scratch(nodes.sparkSession, "map").put("ranks", ranks)
    files = ranks.select(F.lit("file").alias("section"), F.col("node").alias("name"), F.col("rank").alias("score"))
    symbols = ranked_symbols(nodes, edges, ranks).select(F.lit("symbol").alias("section"), F.col("id").alias("name"), "score")
    spent, out = FRAME_TOKENS, []
    if architecture_too:
        room = min(budget // 2, MOST_ARCHITECTURE)
        whole = architecture(nodes, edges, ranks, graph, budget if room < LEAST_ARCHITECTURE else room)
        spent += whole["tokens"]
        out.append({"section": "architecture", "name": json.dumps(whole, sort_keys=True), "score": 0.0, "tokens": whole["tokens"]})
    for rows in (files, symbols):
        cost = structured_estimate(F.to_json(F.struct("section", "name", F.round("score", 6).alias("score"))))
        taken = 0
        for r in rows.withColumn("tokens", cost).orderBy(F.desc(F.round("score", 9)), "name").limit(limit).collect():
            if spent + r["tokens"] > budget:
                break
            taken += 1
            spent += r["tokens"]
            out.append({"section": r["section"], "name": r["name"], "score": float(r["score"]), "tokens": int(r["tokens"])})
    return out


def architecture(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, graph: DataFrame, budget: int = MOST_ARCHITECTURE) -> dict:
    """Languages, packages, entry points, routes, hotspots, communities and their boundaries, cut to ``budget`` tokens."""
    rows = lambda df, n: [r.asDict(recursive=True) for r in df.limit(n).collect()]
    weighted = graph.groupBy(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).agg(F.sum("weight").alias("weight"))
    scratch = Scratch(nodes.sparkSession, "architecture")
    found = scratch.put("communities", rank.communities(weighted))
    parts = scratch.put("parts", rank.refined(weighted, found).select("node", F.col("part").alias("community")))
    tight = rank.cohesion(weighted, parts).join(rank.community_names(parts, ranks), "community").orderBy(F.desc("nodes"), "community")
    top = [r["community"] for r in tight.select("community").limit(COMMUNITIES).collect()]
    routes = nodes.filter("kind = 'http-route'").join(ranks.withColumnRenamed("node", "file"), "file", "left").orderBy(F.desc_nulls_last("rank"), "name").select("name", "file")
    out = {
        "languages": rows(summary.languages(nodes.filter("language <> ''")).orderBy(F.desc("symbols"), "language"), MAP_ROWS),
        "packages": rows(summary.packages(nodes, ranks.withColumnRenamed("node", "file")).withColumn("rank", F.round("rank", 6)).orderBy(F.desc("rank"), "package"), MAP_ROWS),
        "entry_points": [r["file"] for r in rows(rank.entry_points(nodes, ranks).select("file"), MAP_ROWS)],
        "routes": rows(routes, MAP_ROWS),
        "hotspots": rows(rank.hotspots(ranks, graph, nodes), MAP_ROWS),
        "communities": rows(tight.select("community", "name", "nodes", F.round("cohesion", 4).alias("cohesion")), COMMUNITIES),
        "boundaries": rows(top_boundaries(graph, parts, top), BOUNDARIES),
    }
    return trimmed(out, budget)


def top_boundaries(graph: DataFrame, membership: DataFrame, communities: list[str], limit: int = BOUNDARIES) -> DataFrame:
    """What ties the given communities together, the heaviest first."""
    some = membership.filter(F.col("community").isin(*communities)) if communities else membership.limit(0)
    return rank.boundaries(graph, some).withColumn("weight", F.round("weight", 6)).orderBy(F.desc("weight"), "src_community", "dst_community").limit(limit)


#: In what order sections of an architecture give up rows, and the rows that each keeps at first.
GIVE_UP = (("boundaries", 0), ("packages", 3), ("hotspots", 3), ("routes", 3), ("entry_points", 3), ("communities", 2), ("packages", 1), ("hotspots", 1), ("entry_points", 1), ("routes", 1), ("languages", 3))


def trimmed(whole: dict, budget: int) -> dict:
    """``whole`` without the last rows of its sections, in the order of GIVE_UP, until its JSON fits ``budget`` tokens."""
    size = lambda: math.ceil(math.ceil(len(json.dumps(whole, sort_keys=True)) / 4) * 1.2)
    cut = False
    for section, least in GIVE_UP:
        while size() > budget and len(whole[section]) > least:
            whole[section].pop()
            cut = True
    return whole | {"tokens": size(), "truncated": cut}


def context_ranges(nodes: DataFrame, edges: DataFrame, targets: DataFrame, callers: bool = True, callees: bool = True) -> DataFrame:
    """(file, start_line, end_line, priority, why) of the targets (node) and what they call and are called by."""
    # Spark judges a table by its compressed size, so many nodes would pass through the driver: they are merged instead.
    place = nodes.select("id", "file", "start_line", "end_line").hint("merge")
    own = targets.select(F.col("node").alias("id")).withColumn("priority", F.lit(0)).withColumn("why", F.lit("target"))
    for wanted, inbound, priority, why in ((callers, True, 1, "caller"), (callees, False, 2, "callee")):
        if wanted:
            peers = impact.trace(edges, targets, inbound).select(F.col("peer").alias("id")).distinct()
            own = own.union(peers.select("id", F.lit(priority), F.lit(why)))
    return own.join(place, "id").groupBy("file", "start_line", "end_line").agg(F.min(F.struct("priority", "why")).alias("x")).select("file", "start_line", "end_line", "x.priority", "x.why")


def fetch_context(nodes: DataFrame, edges: DataFrame, lines: DataFrame, targets: DataFrame, budget: int = MAP_TOKENS, callers: bool = True, callees: bool = True) -> DataFrame:
    """(file, start_line, end_line, why, tokens, spent): what to read of the targets (node) and around them, within ``budget`` tokens.

    Ranges that overlap or touch are one, with the best priority of theirs; targets come first, then callers, then callees.
    """
    ranges = Scratch(nodes.sparkSession, "context").put("ranges", context_ranges(nodes, edges, targets, callers, callees))
    merged = intervals.merged_ranges(ranges).drop("parts")
    inner = ranges.select("file", F.col("start_line").alias("a"), F.col("end_line").alias("b"), "priority", "why").hint("merge")
    best = merged.join(inner, "file").filter("a >= start_line and b <= end_line").groupBy("file", "start_line", "end_line").agg(F.min(F.struct("priority", "why")).alias("x"))
    text = intervals._in_ranges(lines, best.select("file", "start_line", "end_line")).groupBy("file", "start_line", "end_line").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))
    found = best.join(text, ["file", "start_line", "end_line"]).select("file", "start_line", "end_line", "x.priority", "x.why", "tokens")
    return intervals.within_budget(found, ["priority", "file", "start_line"], "tokens", budget).select("file", "start_line", "end_line", "why", "tokens", "spent")


def inspect_symbols(nodes: DataFrame, edges: DataFrame, targets: DataFrame, tests: Column) -> DataFrame:
    """(id, callers, callees, proven_callers, possible, tests, imports): one row for each target (node)."""
    edges = Scratch(nodes.sparkSession, "inspect").put("edges", edges.filter("type = 'calls'").select("src", "dst", "type", "confidence", "line"))
    into = impact.trace(edges, targets).filter("type = 'calls'")
    out = impact.trace(edges, targets, inbound=False)
    possible = impact.possible_callers(nodes, edges).select("id", F.col("callers").alias("possible"))
    reach = impact.tests_for(nodes, edges, targets, tests).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("tests"))  # a pair comes once
    rows = targets.select(F.col("node").alias("id"))
    rows = rows.join(into.groupBy(F.col("target").alias("id")).agg(F.count_distinct("peer").alias("callers"), F.count_if(F.col("confidence").isin("exact", "scoped")).alias("proven_callers")), "id", "left")
    rows = rows.join(out.filter("type = 'calls' and confidence <> 'unresolved'").groupBy(F.col("target").alias("id")).agg(F.count_distinct("peer").alias("callees")), "id", "left")
    return rows.join(possible, "id", "left").join(reach, "id", "left").na.fill(0, ["callers", "proven_callers", "callees", "possible", "tests"])


#: Points of an anchor by kind, and for each edge, ten edges at most.
ANCHOR_POINTS = {"http-route": 60, "component": 45, "function": 40, "method": 40, "class": 25, "interface": 20}


def flow_anchors(nodes: DataFrame, edges: DataFrame, found: DataFrame, limit: int = 3) -> DataFrame:
    """(id, score): where a flow begins, of the symbols found (id, score): their score, their kind's points and 5 for each resolved edge, up to ten."""
    kind = F.lit(0)
    for k, points in ANCHOR_POINTS.items():
        kind = F.when(F.col("kind") == k, points).otherwise(kind)
    ends = summary.degree(edges.filter("confidence <> 'unresolved'")).select("id", "degree")
    met = found.select("id", "score").join(nodes.select("id", "kind"), "id").join(ends, "id", "left")
    total = F.col("score") + kind + F.least(F.coalesce("degree", F.lit(0)), F.lit(10)) * 5
    return met.select("id", total.cast("bigint").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def cross_repo_graph(graphs: DataFrame, links: DataFrame) -> DataFrame:
    """(src_file, dst_file, type, weight, edges) of several repositories as one graph: files carry their repository's name.

    ``graphs`` has (repo, src_file, dst_file, type, weight, edges); ``links`` (from_repo, from_file, to_repo, to_file, kind).
    """
    at = lambda repo, file: F.concat_ws(":", repo, file)
    own = graphs.select(at("repo", "src_file").alias("src_file"), at("repo", "dst_file").alias("dst_file"), "type", "weight", "edges")
    across = links.groupBy("from_repo", "from_file", "to_repo", "to_file", "kind").agg(F.count(F.lit(1)).alias("edges"))
    across = across.select(at("from_repo", "from_file").alias("src_file"), at("to_repo", "to_file").alias("dst_file"), F.concat(F.lit("cross-repo-"), "kind").alias("type"), (F.col("edges") * CROSS_WEIGHT).alias("weight"), "edges")
    return own.unionByName(across)


def cross_repo_architecture(graphs: DataFrame, links: DataFrame) -> DataFrame:
    """(community, files, repos, cohesion): communities of files over all repositories, and which repositories each holds."""
    graph = Scratch(graphs.sparkSession, "repos").put("graph", cross_repo_graph(graphs, links))
    weighted = graph.groupBy(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).agg(F.sum("weight").alias("weight"))
    found = Scratch(graphs.sparkSession, "repos").put("communities", rank.communities(weighted))
    repos = found.groupBy("community").agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_set(F.substring_index("node", ":", 1))).alias("repos"))
    return repos.join(rank.cohesion(weighted, found).select("community", "cohesion"), "community")


def health_overlay(groups: DataFrame, nodes: DataFrame, level: str, dead: DataFrame, untested: DataFrame) -> DataFrame:
    """``groups`` (group, ...) with their dead, untested and complex symbols (``dead`` and ``untested``: id)."""
    marked = nodes.select(F.col(level).alias("group"), "id", (F.col("complexity") >= 15).alias("complex"))
    marked = marked.join(dead.select("id", F.lit(1).alias("dead")).distinct(), "id", "left").join(untested.select("id", F.lit(1).alias("untested")).distinct(), "id", "left")
    found = marked.groupBy("group").agg(F.count("dead").alias("dead"), F.count("untested").alias("untested"), F.count_if("complex").alias("complex"))
    return groups.join(found, "group", "left").na.fill(0, ["dead", "untested", "complex"])


def suggestions(names: DataFrame, asked: str, limit: int = 5) -> DataFrame:
    """(event, distance): known events (event) closest to one that is not known, in any case, by edits."""
    distance = F.levenshtein(F.lower("event"), F.lit(asked.lower()))
    near = names.select("event").distinct().withColumn("distance", distance)
    close = (F.col("distance") <= max(2, len(asked) // 2)) | F.contains(F.lower("event"), F.lit(asked.lower()))
    return near.filter(close).orderBy("distance", "event").limit(limit)


def best_of_file(nodes: DataFrame, limit: int = 3) -> DataFrame:
    """(file, name): the symbols of a file that tell most of it, by kind and complexity."""
    points = F.when(F.col("kind") == "http-route", 40).when(F.col("kind").isin("class", "interface", "component") | F.col("kind").startswith("terraform-"), 20).when(F.col("kind").isin("function", "method"), 10).otherwise(0)
    w = Window.partitionBy("file").orderBy(F.desc(F.col("complexity") + points), "start_line", "id")
    return nodes.filter("kind <> 'file'").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).select("file", "name", F.col("r").alias("place"))


def find_and_fetch(nodes: DataFrame, edges: DataFrame, lines: DataFrame, query: str, budget: int = MAP_TOKENS) -> tuple[str, DataFrame]:
    """(status, context) of the one symbol that a query means; several are ambiguous and give their own ranges."""
    found = Scratch(nodes.sparkSession, "find").put("found", lookup.find_symbols(nodes, query).select(F.col("id").alias("node")).limit(50))
    n = found.count()
    return ("not_found" if not n else "found" if n == 1 else "ambiguous"), fetch_context(nodes, edges, lines, found, budget, n == 1, n == 1)
