"""Lines and ranges: containing symbols, changed symbols, coverage verdicts, merged context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import Scratch


#: Lines of one bucket: lines and ranges meet by file and bucket, so a large file is no single key.
BUCKET = 256


def _in_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """``lines`` (file, line, ...) joined with the ``ranges`` (file, start_line, end_line, ...) that hold them.

    Spark judges lines that are made from ranges by the ranges' file, so many would pass through the driver: they are merged instead.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET).cast("int")
    cut = ranges.withColumn("bucket", F.explode(F.sequence(bucket("start_line"), F.greatest(bucket("start_line"), bucket("end_line")))))
    return lines.withColumn("bucket", bucket("line")).hint("merge").join(cut, ["file", "bucket"]).filter("line between start_line and end_line").drop("bucket")


def containing_symbol(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, line, id): the innermost node around each line: the latest start, then the least id."""
    met = _in_ranges(lines.select("file", "line").distinct(), nodes.select("file", "start_line", "end_line", "id"))
    best = met.groupBy("file", "line").agg(F.min(F.struct((-F.col("start_line")).alias("s"), "id")).alias("x"))
    return best.select("file", "line", F.col("x.id").alias("id"))


def changed_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Nodes that a changed range of lines touches."""
    bucket = lambda c: F.floor(F.col(c) / BUCKET).cast("int")
    cut = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(bucket(a), F.greatest(bucket(a), bucket(b)))))
    h = cut(hunks.select("file", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line")), "from_line", "to_line")
    own = cut(nodes.select("id", "file", "start_line", F.greatest("start_line", "end_line").alias("end_line")), "start_line", "end_line")
    touched = own.join(h, ["file", "bucket"]).filter("start_line <= to_line and end_line >= from_line").select("id").distinct()
    return nodes.join(touched, "id", "left_semi")


def leaf_symbols(nodes: DataFrame) -> DataFrame:
    """Those of ``nodes`` that are no other one's parent."""
    return nodes.join(nodes.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")


def coverage_verdict(nodes: DataFrame, coverage: DataFrame) -> DataFrame:
    """(id, known, tested): whether any line of a node is recorded, and whether any was run."""
    met = _in_ranges(coverage, nodes.select("id", "file", "start_line", "end_line"))
    found = met.groupBy("id").agg(F.max(F.col("hits") > 0).alias("tested"))
    return nodes.select("id").join(found, "id", "left").select("id", F.col("tested").isNotNull().alias("known"), F.coalesce("tested", F.lit(False)).alias("tested"))


def merged_ranges(ranges: DataFrame, gap: int = 1) -> DataFrame:
    """(file, start_line, end_line, parts): ranges of a file that overlap or touch, as one."""
    w = Window.partitionBy("file").orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.select("file", "start_line", "end_line").withColumn("new", F.when(F.col("start_line") > before + gap, 1).otherwise(0))
    island = opened.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("file", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("parts")).drop("island")


def within_budget(items: DataFrame, order: list[str], cost: str, budget: int) -> DataFrame:
    """The first of ``items`` in ``order`` whose running cost stays within ``budget``.

    Items are dealt by ranges of the order; the cost of the ranges before (one number for each range reaches the
    driver) is where a range's own running sum begins, so no task sees all items.
    """
    scratch = Scratch(items.sparkSession, "budget")
    dealt = scratch.put("items", items.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, spent = {}, 0
    for r in dealt.groupBy("_range").agg(F.sum(cost).alias("c")).orderBy("_range").collect():
        if spent <= budget:
            before[r["_range"]] = spent
        spent += r["c"] or 0
    if not before:
        return dealt.drop("_range").withColumn("spent", F.lit(0).cast("bigint"))
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_range")]
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.filter(F.col("_range").isin(*before)).withColumn("spent", F.sum(cost).over(w) + start)
    return within.filter(F.col("spent") <= budget).drop("_range")


def source_slice(lines: DataFrame, file: str, start: int, end: int) -> DataFrame:
    """(line, text) of one file, in order."""
    return lines.filter((F.col("file") == file) & F.col("line").between(start, end)).select("line", "text").orderBy("line")


def outline(nodes: DataFrame, file: str, levels: int = 25, limit: int = 1_000) -> DataFrame:
    """(id, name, kind, depth, path) of a file's nodes, each after its parent."""
    from strandline.operators.summary import qualified_names

    own = nodes.filter(F.col("file") == file)
    return own.join(qualified_names(own, levels), "id").select("id", "name", "kind", "depth", F.col("qualified_name").alias("path")).orderBy("path", "id").limit(limit)
