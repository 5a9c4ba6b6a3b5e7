"""Review of a change: what it touched, who depends on that, what no test reaches, and how risky it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import declaration
from strandline.model import rank
from strandline.operators.impact import REVIEW_HOPS, TEST_HOPS, review_risk, tested
from strandline.operators.intervals import changed_symbols, coverage_verdict, leaf_symbols
from strandline.operators.summary import cochange
from strandline.operators.traverse import weakest_paths

#: Fixed value: files that are named for also being changed, as a rule.
ALSO = 10


def change_kinds(changed: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, change_kind) of ``changed`` nodes by their declarations before (``base``) and now (``head``: file, line, text).

    ``body`` if all lines of the declaration stood in the file before, apart from formatting; ``signature`` if they did
    not but the name did, as a whole word; ``new`` otherwise, and for files that were not there.
    """
    span = F.regexp_count(F.coalesce("signature", F.lit("")), F.lit("\n"))
    own = changed.select("id", "name", "file", F.explode(F.sequence("start_line", F.col("start_line") + span)).alias("line"), F.substring_index("signature", "\n", 1).alias("first"))
    written = own.join(head.select("file", "line", "text"), ["file", "line"], "left")
    lines = written.select("id", "name", "file", "first", declaration(F.coalesce("text", F.lit(""))).alias("d"))
    # A declaration that is not found in the file is read from the signature's first line.
    lines = lines.groupBy("id", "name", "file", "first").agg(F.collect_set(F.when(F.col("d") != "", F.col("d"))).alias("d"))
    lines = lines.withColumn("d", F.when(F.size("d") > 0, F.col("d")).otherwise(F.array(declaration(F.coalesce("first", F.lit("")))))).select("id", "name", "file", F.explode("d").alias("d"))
    touched = changed.select("file").distinct()
    before = base.join(touched, "file", "left_semi")
    known = before.select("file", declaration(F.col("text")).alias("d")).filter("d <> ''").distinct().withColumn("stood", F.lit(True))
    files = before.select("file").distinct().withColumn("there", F.lit(True))
    met = lines.join(known, ["file", "d"], "left").groupBy("id", "name", "file").agg(F.bool_and(F.col("stood").isNotNull() & (F.col("d") != "")).alias("intact"))
    met = met.join(files, "file", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    word = F.concat(F.lit(r"(?<![\w$])\Q"), F.col("name"), F.lit(r"\E(?![\w$])"))
    open_ = met.filter("there and not intact and name <> ''").select("id", "name", "file")
    named = open_.join(before.select("file", "text"), "file").filter(F.contains("text", F.col("name")) & F.regexp_like("text", word)).select("id").distinct().withColumn("named", F.lit(True))
    kind = F.when(F.col("there") & F.col("intact"), "body").when(F.col("there") & F.col("named"), "signature").otherwise("new")
    return met.join(named, "id", "left").select("id", kind.alias("change_kind"))


def also_consider(commits: DataFrame, changed: DataFrame, limit: int = ALSO) -> DataFrame:
    """(file, count): what is often changed together with the ``changed`` files (file) and is not among them."""
    peers = cochange(commits).join(changed.select("file").distinct(), "file", "left_semi").select(F.col("peer").alias("file"), "count")
    found = peers.join(changed.select("file").distinct(), "file", "left_anti").groupBy("file").agg(F.sum("count").alias("count"))
    return found.orderBy(F.desc("count"), "file").limit(limit)


def review(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, base: DataFrame, head: DataFrame, tests: Column, coverage: DataFrame | None = None, hops: int = REVIEW_HOPS) -> DataFrame:
    """One row for each innermost node that a changed range of lines (``hunks``) touches.

    (id, name, file, start_line, change_kind, proven, possible, direct_proven, untested, untested_by, score, risk, reasons).
    Callers within ``hops`` are proven if some path to them is exact or scoped throughout, possible if not; files are no
    callers.  Where a coverage report knows a node it says whether it was tested, else the calls from tests do.
    """
    solid = nodes.filter("kind <> 'file'")
    changed = leaf_symbols(changed_symbols(solid, hunks))
    starts = changed.select(F.col("id").alias("node"))
    callers = solid.select(F.col("id").alias("src"))
    steps = edges.filter("type = 'calls' and src <> dst").join(callers, "src", "left_semi").select("src", "dst", rank(F.col("confidence")).alias("rank"))
    # The best rank over paths of any length up to ``hops``, not only over the shortest.
    reach = _best_ranks(steps, starts, hops)
    counts = reach.groupBy(F.col("start").alias("id")).agg(F.count_if(F.col("rank") <= 2).alias("proven"), F.count_if(F.col("rank") > 2).alias("possible"))
    direct = weakest_paths(steps, starts, 1).filter("rank <= 2").groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("direct"))
    reached = tested(nodes, edges, tests, TEST_HOPS).select(F.col("node").alias("id")).union(nodes.filter(tests).select("id")).distinct().withColumn("reached", F.lit(True))
    met = changed.join(counts, "id", "left").join(direct, "id", "left").join(reached, "id", "left").join(change_kinds(changed, base, head), "id", "left")
    met = met.na.fill(0, ["proven", "possible", "direct"]).withColumn("static", F.col("reached").isNull())
    if coverage is None:
        met = met.withColumn("untested", F.col("static")).withColumn("untested_by", F.when(F.col("static"), "static").otherwise(""))
    else:
        met = met.join(coverage_verdict(changed, coverage).withColumnRenamed("tested", "ran"), "id", "left")
        untested = F.when(F.col("known"), ~F.col("ran")).otherwise(F.col("static"))
        met = met.withColumn("untested", untested).withColumn("untested_by", F.when(~untested, "").when(F.col("known"), "coverage").otherwise("static"))
    met = met.withColumn("change_kind", F.coalesce("change_kind", F.lit("body"))).withColumn("signature_changed", F.col("change_kind") == "signature")
    met = met.withColumn("direct_proven", F.when(F.col("signature_changed"), F.col("direct")).otherwise(F.lit(0).cast("bigint")))
    scored = review_risk(met)
    reasons = F.array_compact(F.array(
        F.when(F.col("signature_changed") & (F.col("direct_proven") > 0), "signature changed"), F.when(F.col("transitive_loop_depth") >= 3, "hot path"), F.when(F.col("linear_scan_in_loop") > 0, "scan in a loop"),
        F.when(F.col("complexity") >= 15, "high complexity").when(F.col("complexity") >= 8, "complexity"), F.when(F.col("untested"), "no test"), F.when(F.col("proven") >= 1, "callers"),
    ))
    return scored.select("id", "name", "file", "start_line", "change_kind", "proven", "possible", "direct_proven", "untested", "untested_by", "score", "risk", reasons.alias("reasons"))


def _best_ranks(steps: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, rank) over (src, dst, rank): the best rank of all backward paths of at most ``hops`` edges that do not pass the start."""
    one = steps.groupBy("src", "dst").agg(F.min("rank").alias("weight"))
    state = starts.select(F.col("node").alias("start"), "node", F.lit(1).alias("rank"))
    best = None
    for _ in range(hops):
        state = state.join(one, F.col("node") == F.col("dst")).filter("src <> start").groupBy("start", F.col("src").alias("found")).agg(F.min(F.greatest("rank", "weight")).alias("rank")).withColumnRenamed("found", "node")
        best = state if best is None else best.union(state)
    return best.groupBy("start", "node").agg(F.min("rank").alias("rank"))


def review_totals(reviewed: DataFrame, callers: DataFrame, files: int) -> DataFrame:
    """One row: changed files and symbols, distinct proven and possible callers (``callers``: start, node, rank), untested and high-risk symbols."""
    own = reviewed.agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("untested")).alias("untested"), F.count_if(F.col("risk") == "high").alias("high_risk"))
    who = callers.groupBy("node").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).agg(F.count_if(F.col("lo") <= 2).alias("proven"), F.count_if(F.col("hi") > 2).alias("possible"))
    rows = own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in own.columns])).alias("x")).union(who.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in who.columns])).alias("x")))
    names = [*own.columns, *who.columns]
    row = rows.select("x.*").agg(*[F.max(F.when(F.col("metric") == c, F.col("value"))).alias(c) for c in names])
    return row.withColumn("files", F.lit(files))
