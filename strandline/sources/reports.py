"""Text reports of other tools as tables: coverage, diffs, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(report, at, text): the lines of each report, numbered within it."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), F.split("value", "\n").alias("v"))
    return whole.select("report", F.posexplode("v").alias("at", "text"))


def _carried(lines: DataFrame, header: str) -> DataFrame:
    """``lines`` with ``head``: the last value of ``header``'s first group at or above each line."""
    found = F.when(F.col("text").rlike(header), F.regexp_extract("text", header, 1))
    w = Window.partitionBy("report").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("head", F.last(found, ignorenulls=True).over(w))


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits) of LCOV reports: hits of a line add up."""
    rows = _carried(_numbered(spark, path), "^SF:(.*?)\\s*$").filter(F.col("text").startswith("DA:") & F.col("head").isNotNull())
    part = lambda n: F.regexp_extract("text", r"^DA:(\d+),(\d+)", n).try_cast("int")
    return rows.select(F.col("head").alias("file"), part(1).alias("line"), part(2).alias("hits")).filter("line is not null").groupBy("file", "line").agg(F.sum("hits").alias("hits"))


def known_files(coverage: DataFrame, files: DataFrame) -> DataFrame:
    """``coverage`` with files named as in ``files`` (path): equal, or the only one that the report's path ends with, or that ends it."""
    names = coverage.select("file").distinct()
    exact = names.join(files.select(F.col("path").alias("file")), "file").select("file", F.col("file").alias("path"))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    rest = names.join(exact, "file", "left_anti").withColumn("base", last("file"))
    met = rest.join(files.select("path", last("path").alias("base")), "base").filter(F.endswith(F.concat(F.lit("/"), "file"), F.concat(F.lit("/"), "path")) | F.endswith(F.concat(F.lit("/"), "path"), F.concat(F.lit("/"), "file")))
    only = met.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").select("file", "path")
    return coverage.join(exact.union(only), "file").groupBy(F.col("path").alias("file"), "line").agg(F.sum("hits").alias("hits"))


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """(file, start_line, end_line) of the new ranges in unified diffs; a deletion touches the line before it."""
    rows = _carried(_numbered(spark, path), r"^\+\+\+ (?:b/)?(.*?)\s*$").filter(F.col("text").startswith("@@") & (F.col("head") != "/dev/null"))
    at = F.regexp_extract("text", r"\+(\d+)", 1).cast("int")
    count = F.coalesce(F.regexp_extract("text", r"\+\d+,(\d+)", 1).try_cast("int"), F.lit(1))
    return rows.select(F.col("head").alias("file"), F.greatest(at, F.lit(1)).alias("start_line"), F.greatest(at + count - 1, at, F.lit(1)).alias("end_line"))


def read_history(spark: SparkSession, path: str, most: int = 1_000) -> DataFrame:
    """(commit, file) of ``git log --name-only --pretty=format:commit:%H``, the newest ``most`` commits."""
    rows = _carried(_numbered(spark, path), "^commit:([0-9a-f]+)$").filter("head is not null")
    newest = rows.groupBy(F.col("head").alias("commit")).agg(F.min("at").alias("at")).orderBy("at").limit(most).select("commit")
    files = rows.filter((F.trim("text") != "") & ~F.col("text").startswith("commit:")).select(F.col("head").alias("commit"), F.trim("text").alias("file"))
    return files.join(newest, "commit", "left_semi").distinct()
