"""Dead code, duplicates, index differences, the doctor's counts, report cards and gates."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import age_hours, language_family, one_decimal, shape, unresolved_name
from strandline.model import CONFIDENCES
from strandline.runtime import Scratch

#: Fields that an index difference compares, in this order.
COMPARED = ("name", "kind", "file", "start_line", "end_line", "signature", "exported", "parent_id", "confidence", "complexity")
#: A god file's symbols, a hot path's loops, a shape's least lines and characters.
GOD_FILE, HOT_LOOPS, SHAPE_LINES, SHAPE_CHARS = 40, 2, 6, 40


def used(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes that some resolved edge points to, and of all their parents."""
    scratch = Scratch(nodes.sparkSession, "used")
    parents = nodes.select("id", "parent_id")
    targets = edges.filter("confidence <> 'unresolved'").select(F.col("dst").alias("id")).distinct()
    found = scratch.put("u0", targets.join(nodes.select("id"), "id", "left_semi"))
    newest, k = found, 0
    while True:
        k += 1
        up = newest.join(parents, "id").select(F.col("parent_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
        newest = scratch.put(f"u{k}", up.join(found, "id", "left_anti"))
        if newest.isEmpty():
            return found
        found = found.union(newest)


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], include_exported: bool = False) -> DataFrame:
    """(id, name, file, uncertain): nodes of ``kinds`` that nothing uses.

    ``uncertain`` marks those that an unresolved call of the same name, from a caller of the same language
    family, may mean.  A self call counts as use.
    """
    some = nodes.filter(F.col("kind").isin(*kinds))
    if not include_exported:
        some = some.filter(~F.col("exported"))
    callers = nodes.select(F.col("id").alias("src"), language_family(F.col("language")).alias("family"))
    open_calls = edges.filter("type = 'calls' and confidence = 'unresolved'").select("src", unresolved_name(F.col("dst")).alias("name")).distinct()
    open_names = open_calls.join(callers, "src").select("name", "family", F.lit(True).alias("hit")).distinct()
    unused = some.join(used(nodes, edges), "id", "left_anti").withColumn("family", language_family(F.col("language")))
    return unused.join(open_names, ["name", "family"], "left").select("id", "name", "file", F.coalesce("hit", F.lit(False)).alias("uncertain"))


def shapes(lines: DataFrame, least_lines: int = SHAPE_LINES, least_chars: int = SHAPE_CHARS) -> DataFrame:
    """(id, lines, shape_hash) of (id, line, text): identifiers and numbers do not count."""
    shaped = lines.select("id", "line", shape(F.col("text")).alias("s")).filter("s <> ''")
    whole = shaped.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n").alias("s"), F.count(F.lit(1)).alias("lines"))
    enough = whole.filter((F.col("lines") >= least_lines) & (F.length("s") >= least_chars))
    return enough.select("id", "lines", F.concat_ws(":", "lines", F.sha2("s", 256)).alias("shape_hash"))


def duplicates(items: DataFrame, key: str, members: int = 5) -> DataFrame:
    """(key, count, members): keys of two items (id) or more, with the first few ids; counted before anything is listed."""
    counted = items.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("first")).filter("count > 1")
    several = items.join(counted.select(key, "count"), key)
    ranked = several.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter(F.col("r") <= members)
    return ranked.groupBy(key, "count").agg(F.array_sort(F.collect_list("id")).alias("members"))


def index_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, change, fields): added, removed and changed nodes, with the names of the fields that differ."""
    a = base.select("id", *[F.col(c).alias(f"a_{c}") for c in COMPARED], F.lit(True).alias("in_a"))
    b = head.select("id", *[F.col(c).alias(f"b_{c}") for c in COMPARED], F.lit(True).alias("in_b"))
    both = a.join(b, "id", "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in COMPARED]))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.size(fields) > 0, "changed")
    out = both.select("id", change.alias("change"), F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), F.array().cast("array<string>")).otherwise(fields).alias("fields"))
    return out.filter("change is not null")


def edge_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(src, dst, type, change): edges that only one of two graphs has; where an edge stands does not count."""
    key = ["src", "dst", "type"]
    a, b = base.select(*key).distinct(), head.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def doctor(nodes: DataFrame, edges: DataFrame, files: DataFrame, indexed_at: Column | None = None, now: Column | None = None) -> DataFrame:
    """(what, name, count) rows of a graph's health.

    Files by language, status and parser (``files``: path, language, parse_status, parser), symbols by kind and by
    language, edges by type, confidence and reason; the files that did not parse; and, where ``indexed_at`` is given,
    the whole hours since, with ``old`` for more than a day.
    """
    def by(rows: DataFrame, what: str, column: str) -> DataFrame:
        return rows.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(what).alias("what"), "name", "count")

    out = by(files, "file language", "language").union(by(files, "file status", "parse_status")).union(by(files, "file parser", "parser"))
    out = out.union(by(nodes, "symbol kind", "kind")).union(by(nodes, "symbol language", "language"))
    out = out.union(edge_counts(edges).select(F.concat(F.lit("edge "), "what"), "name", "edges"))
    failed = files.filter("parse_status = 'error'").select(F.lit("parse failure"), "path", F.lit(1).cast("bigint"))
    out = out.union(failed)
    if indexed_at is not None:
        hours = F.floor(age_hours(indexed_at, F.current_timestamp() if now is None else now)).cast("bigint")
        out = out.union(nodes.sparkSession.range(1).select(F.lit("age in hours"), F.when(hours > 24, "old").otherwise("fresh"), hours))
    return out


def edge_counts(edges: DataFrame) -> DataFrame:
    """(what, name, edges): by type, by confidence and by reason of unresolved edges, in one pass."""
    rows = edges.select("type", "confidence", F.when(F.col("confidence") == "unresolved", F.col("reason")).alias("reason"))
    found = rows.groupingSets([["type"], ["confidence"], ["reason"]], "type", "confidence", "reason").agg(F.count(F.lit(1)).alias("edges"), F.grouping_id().alias("g"))
    what = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "confidence").otherwise("reason")
    return found.select(what.alias("what"), F.coalesce("type", "confidence", "reason").alias("name"), "edges").filter("name is not null")


def top_unresolved(edges: DataFrame, n: int = 20) -> DataFrame:
    """(name, reason, edges): the names that most unresolved edges point to."""
    open_edges = edges.filter("confidence = 'unresolved'").select(unresolved_name(F.col("dst")).alias("name"), "reason")
    return open_edges.groupBy("name", "reason").agg(F.count(F.lit(1)).alias("edges")).orderBy(F.desc("edges"), "name", "reason").limit(n)


def confidence_pivot(edges: DataFrame) -> DataFrame:
    """(type, exact, scoped, heuristic, unresolved): edges of each type by confidence."""
    return edges.groupBy("type").agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCES])


def blast_radius(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers): distinct proven callers, without self calls and files."""
    callers = nodes.filter("kind <> 'file'").select(F.col("id").alias("src"))
    proven = edges.filter("type = 'calls' and confidence in ('exact', 'scoped') and src <> dst").join(callers, "src", "left_semi")
    found = proven.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    return found.join(nodes.select("id"), "id", "left_semi")


def god_files(nodes: DataFrame, least: int = GOD_FILE) -> DataFrame:
    """(file, symbols): files that hold ``least`` symbols or more."""
    return nodes.filter("kind <> 'file'").groupBy("file").agg(F.count(F.lit(1)).alias("symbols")).filter(F.col("symbols") >= least)


def report_card(nodes: DataFrame, edges: DataFrame, dead: DataFrame, untested_nodes: DataFrame, clusters: DataFrame, kinds: tuple[str, ...], files: DataFrame | None = None) -> DataFrame:
    """One row of totals and shares; ``files`` (path, parse_status) gives the files that did not parse, none without it."""
    total = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("confidence") == "unresolved").alias("unresolved"))
    some = F.col("kind").isin(*kinds)
    of_nodes = nodes.agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(some).alias("testable"),
        F.count_if(some & ((F.col("transitive_loop_depth") >= HOT_LOOPS) | (F.col("linear_scan_in_loop") > 0))).alias("hot_path_symbols"),
        F.count_if(some & (F.col("complexity") >= 15)).alias("complex_symbols"),
    )
    of_dead = dead.agg(F.count_if(~F.col("uncertain")).alias("dead_code"), F.count_if(F.col("uncertain")).alias("dead_code_uncertain"))
    of_tests = untested_nodes.agg(F.count(F.lit(1)).alias("untested"))
    of_clusters = clusters.agg(F.count(F.lit(1)).alias("duplication_clusters"))
    of_files = (nodes.select(F.lit("").alias("parse_status")) if files is None else files).agg(F.count_if(F.col("parse_status") == "error").alias("parse_failures"))
    tables = (total, of_nodes, of_dead, of_tests, of_clusters, of_files)
    # Tables of one row each, brought together as (metric, value) rows of one aggregate.
    flat = None
    for one in tables:
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in one.columns])).alias("x")).select("x.*")
        flat = rows if flat is None else flat.union(rows)
    names = [c for one in tables for c in one.columns]
    row = flat.agg(*[F.max(F.when(F.col("metric") == c, F.col("value"))).alias(c) for c in names])
    share = lambda a, b: F.when(F.col(b) > 0, one_decimal(F.col(a) * F.lit(100.0) / F.col(b))).otherwise(F.lit(0.0))
    return row.withColumns({"unresolved_pct": share("unresolved", "edges"), "untested_pct": share("untested", "testable")})


#: What a gate may bound.
METRICS = ("dead_code", "duplication_clusters", "unresolved_pct", "untested_pct", "untested", "hot_path_symbols", "parse_failures")
_GATE = re.compile(r"\s*([a-z_]+)\s*<=\s*([^\s,]+)\s*")


def parse_gates(text: str) -> list[tuple[str, float]]:
    """``metric<=value`` items, parted by commas, twenty at most."""
    parts = [x for x in text.split(",") if x.strip()]
    if len(parts) > 20:
        raise ValueError("more than 20 gates")
    out = []
    for part in parts:
        m = _GATE.fullmatch(part)
        if m is None or m[1] not in METRICS:
            raise ValueError(f"{part.strip()!r} is no gate")
        value = float(m[2])
        if not math.isfinite(value):
            raise ValueError(f"{m[2]!r} is no bound")
        out.append((m[1], value))
    return out


def broken_gates(card: Mapping[str, float], text: str) -> list[tuple[str, float, float]]:
    """(metric, value, bound) of the gates that ``card`` breaks."""
    return [(name, float(card[name]), bound) for name, bound in parse_gates(text) if float(card[name]) > bound]
