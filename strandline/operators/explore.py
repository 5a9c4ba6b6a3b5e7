"""From a question to evidence: search, anchors, traces and merged context within a budget; mentions for the map."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import token_estimate
from strandline.operators import impact, intervals, search

#: Weights of what is named and of what is only alike, and the shortest part of a name that counts.
STRONG, WEAK, SHORTEST = 12.0, 2.0, 5


def mentions(named: list[str], query: str = "") -> dict[str, float]:
    """Terms with weights: names and base names strongly, their longer parts and the query's terms weakly."""
    out: dict[str, float] = {}

    def add(term: str, weight: float) -> None:
        if term:
            out[term] = max(out.get(term, 0.0), weight)

    for raw in (x.strip() for value in named for x in value.split(",")):
        low = raw.lower()
        add(low, STRONG)
        base = re.split(r"[/\\]", low)[-1]
        add(base.rsplit(".", 1)[0] if "." in base[1:] else base, STRONG)
        for part in search.query_terms(raw, expand=False):
            if len(part) >= SHORTEST:
                add(part, WEAK)
    for term in search.query_terms(query) if query else []:
        if len(term) > 1:
            add(term, WEAK)
    return out


def personal_weights(nodes: DataFrame, terms: dict[str, float]) -> DataFrame:
    """(node, personal) of files: the weights of the terms that their symbols' names, signatures or paths hold; equal without any."""
    text = F.lower(F.concat_ws(" ", "name", "signature", "file"))
    weight = sum((F.when(F.contains(text, F.lit(t)), w).otherwise(0.0) for t, w in terms.items()), F.lit(0.0))
    files = nodes.groupBy(F.col("file").alias("node")).agg(F.sum(weight).alias("w"))
    total = files.agg(F.sum("w").alias("t"), F.count(F.lit(1)).alias("n")).first()
    share = F.col("w") / total["t"] if total["t"] else F.lit(1.0) / max(1, total["n"])
    return files.select("node", share.alias("personal"))


def explore(question: str, lines: DataFrame, nodes: DataFrame, edges: DataFrame, anchors: int = 3, hits: int = 10, budget: int = 1_800) -> DataFrame:
    """(file, start_line, end_line, why, tokens): what to read to answer a question, within ``budget`` tokens.

    Best lines of a search lead to the symbols around them (the anchors); their
    own lines come first, then those of their direct callers and callees.  A
    reader's answer is small: it is cut by rank and budget as its purpose is.
    """
    top = search.top_lines(search.scored_lines(search.indexed(lines), question), hits)
    around = intervals.containing_symbol(top, nodes).join(top.select("file", "line", "score"), ["file", "line"])
    chosen = around.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(anchors)
    targets = chosen.select(F.col("id").alias("node"))
    near = impact.trace(edges, targets).select("peer").union(impact.trace(edges, targets, inbound=False).select("peer")).distinct()
    place = nodes.select("id", "file", "start_line", "end_line")
    own = chosen.join(place, "id").select("file", "start_line", "end_line", F.lit(0).alias("rank"), F.lit("anchor").alias("why"))
    more = near.withColumnRenamed("peer", "id").join(chosen.select("id"), "id", "left_anti").join(place, "id").select("file", "start_line", "end_line", F.lit(1).alias("rank"), F.lit("neighbour").alias("why"))
    ranges = own.union(more).distinct()
    size = token_estimate(F.col("text"))
    cost = ranges.join(lines, "file").filter("line between start_line and end_line").groupBy("file", "start_line", "end_line", "rank", "why").agg(F.sum(size).alias("tokens"))
    return intervals.within_budget(cost, ["rank", "file", "start_line"], "tokens", budget).select("file", "start_line", "end_line", "why", "tokens")
