"""The journal of changed files and what changed since a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: entries that a journal keeps.
KEPT = 200


def journal_of(events: DataFrame) -> DataFrame:
    """(seq, updated, removed) per batch of (seq, file, kind): the last event of a file in a batch wins, by ``at``."""
    last = events.groupBy("seq", "file").agg(F.max_by("kind", "at").alias("kind"))
    return last.groupBy("seq").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") != "remove", F.col("file")))).alias("updated"), F.array_sort(F.collect_list(F.when(F.col("kind") == "remove", F.col("file")))).alias("removed")
    )


def changed_since(events: DataFrame, seq: int) -> DataFrame:
    """(file, kind): the last thing that happened to each file after ``seq``."""
    return events.filter(F.col("seq") > seq).groupBy("file").agg(F.max_by("kind", F.struct("seq", "at")).alias("kind"))


def missed_history(journal: DataFrame, seq: int, kept: int = KEPT) -> bool:
    """Whether entries after ``seq`` have left a journal that keeps the last ``kept``."""
    row = journal.agg(F.max("seq").alias("last")).first()
    return row["last"] is not None and row["last"] - kept > seq


def replayed(events: DataFrame) -> DataFrame:
    """(file, version): the files that exist after all events, each with the number of its updates since it last appeared."""
    w = Window.partitionBy("file").orderBy("seq", "at")
    life = events.withColumn("life", F.sum(F.when(F.col("kind") == "remove", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    life = life.withColumn("life", F.coalesce("life", F.lit(0)))
    last = life.groupBy("file").agg(F.max_by("kind", F.struct("seq", "at")).alias("kind"), F.max("life").alias("life"))
    alive = last.filter("kind <> 'remove'").select("file", "life")
    return life.join(alive, ["file", "life"]).groupBy("file").agg(F.count(F.lit(1)).alias("version"))
