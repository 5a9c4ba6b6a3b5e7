"""Finding symbols by what a reader types, and plans to edit them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import is_test_path
from strandline.operators.summary import qualified_names

#: Points of a symbol's kind, of how it matches, and off for where it lies.
KIND_POINTS = {"file": 30, "template-class": 5, "css-class": 5} | dict.fromkeys("function method component class interface type constant getter setter enum".split(), 100)
MATCH_POINTS = {"name": 1_000, "file_name": 850, "suffix": 800, "in_name": 600, "in_id": 300}
STORY, TEST, BACKUP = 250, 200, 400
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")


def is_backup(path: Column) -> Column:
    """Whether a file's name marks a copy kept aside."""
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike(r"~$|\.(bak|old|orig|backup)(\.|$)|[._-](backup|copy|old)\.[a-z]+$")


def match_score(query: str) -> Column:
    """Points of a symbol (id, name, file, kind) for a query."""
    q = query.lower()
    name, ident, file = F.lower("name"), F.lower("id"), F.lower("file")
    base = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    whole = F.concat(file, F.lit(":"), name)
    suffix = whole.rlike(r"(^|[^a-zA-Z0-9])" + re.escape(q).replace("\\-", "-") + "$")
    kind = F.lit(50)
    for k, points in KIND_POINTS.items():
        kind = F.when(F.col("kind") == k, points).otherwise(kind)
    kind = F.when(F.col("kind").startswith("terraform-"), 100).otherwise(kind)
    match = (
        F.when(name == q, MATCH_POINTS["name"]).when(base == q, MATCH_POINTS["file_name"]).when(suffix, MATCH_POINTS["suffix"])
        .when(F.contains(name, F.lit(q)), MATCH_POINTS["in_name"]).when(F.contains(ident, F.lit(q)), MATCH_POINTS["in_id"]).otherwise(0)
    )
    off = F.when(file.rlike(r"\.stor(y|ies)\."), STORY).otherwise(0) + F.when(is_test_path(F.col("file")), TEST).otherwise(0) + F.when(is_backup(F.col("file")), BACKUP).otherwise(0)
    return kind + match - off


def _ordered(found: DataFrame, query: str) -> DataFrame:
    return found.withColumn("score", match_score(query)).orderBy(F.desc("score"), is_backup(F.col("file")), "file", "start_line", "name")


def list_symbols(nodes: DataFrame, query: str = "", kind: str | None = None, language: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols whose name, id or file holds ``query``, best first; all of them by place without a query."""
    found = nodes
    if kind:
        found = found.filter(F.col("kind") == kind)
    if language:
        found = found.filter(F.col("language") == language)
    if not query:
        return found.orderBy(is_backup(F.col("file")), "file", "start_line", "name").limit(limit)
    q = F.lit(query.lower())
    return _ordered(found.filter(F.contains(F.lower("name"), q) | F.contains(F.lower("id"), q) | F.contains(F.lower("file"), q)), query).limit(limit)


def find_symbols(nodes: DataFrame, query: str) -> DataFrame:
    """The first tier with a match: the id, the qualified name, the name, ``file:name``, then names that hold the query."""
    q = query.strip()
    tiers = [nodes.filter(F.col("id") == q)]
    if "." in q and not any(c in q for c in "/\\:"):
        own = qualified_names(nodes).filter(F.col("qualified_name") == q).select("id")
        tiers.append(nodes.join(own, "id", "left_semi"))
    tiers += [nodes.filter(F.col("name") == q), nodes.filter(F.concat("file", F.lit(":"), "name") == q), nodes.filter(F.contains(F.lower("name"), F.lit(q.lower())))]
    for tier in tiers[:-1]:
        if not tier.isEmpty():
            return _ordered(tier, q)
    return _ordered(tiers[-1], q) if q else nodes.limit(0)


def rename_plan(nodes: DataFrame, edges: DataFrame, lines: DataFrame, symbol_id: str, new_name: str) -> DataFrame:
    """(file, line, column, old_text, new_text, confidence) of the edits that rename a symbol; nothing is written.

    The definition's first line with the name, and every line that an edge to the
    symbol gives as evidence.  Weak confidences are to be checked by the reader.
    """
    if not IDENTIFIER.fullmatch(new_name):
        raise ValueError(f"{new_name!r} is no identifier")
    target = nodes.filter(F.col("id") == symbol_id)
    row = target.first()
    if row is None:
        raise ValueError(f"no symbol {symbol_id!r}")
    if row["name"] == new_name:
        raise ValueError(f"the symbol has the name {new_name!r} already")
    word = rf"(?<![A-Za-z0-9_$]){re.escape(row['name'])}(?![A-Za-z0-9_$])"
    hit = lines.filter(F.col("text").rlike(word)).withColumn("column", F.length(F.element_at(F.split("text", word, 2), 1)) + 1)
    own = hit.filter((F.col("file") == row["file"]) & F.col("line").between(row["start_line"], row["end_line"])).orderBy("line").limit(1).withColumn("confidence", F.lit("exact"))
    uses = edges.filter(F.col("dst") == symbol_id).groupBy("file", "line").agg(F.min("confidence").alias("confidence"))
    met = hit.join(uses, ["file", "line"])
    both = own.select("file", "line", "column", "confidence").union(met.select("file", "line", "column", "confidence"))
    w = Window.partitionBy("file", "line", "column").orderBy("confidence")
    once = both.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return once.select("file", "line", "column", F.lit(row["name"]).alias("old_text"), F.lit(new_name).alias("new_text"), "confidence").orderBy("file", "line", "column")


def body_plan(nodes: DataFrame, symbol_id: str, text: str, after: bool = False) -> DataFrame:
    """(file, start_line, end_line, new_text): the one edit that replaces a symbol's lines, or inserts after them (an empty range)."""
    own = nodes.filter(F.col("id") == symbol_id)
    start = F.col("end_line") + 1 if after else F.col("start_line")
    return own.select("file", start.alias("start_line"), "end_line", F.lit(text).alias("new_text"))


def recall(gold: DataFrame, callers: DataFrame) -> DataFrame:
    """(name, expected, found, recall, violations): expected callers (name, caller, wanted) among ``callers`` (name, caller).

    Rows with ``wanted`` false name callers that must not be found.
    """
    hit = callers.select("name", "caller", F.lit(True).alias("hit")).distinct()
    met = gold.join(hit, ["name", "caller"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    out = met.groupBy("name").agg(F.count_if(F.col("wanted")).alias("expected"), F.count_if(F.col("wanted") & F.col("hit")).alias("found"), F.count_if(~F.col("wanted") & F.col("hit")).alias("violations"))
    return out.withColumn("recall", F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(1.0))
