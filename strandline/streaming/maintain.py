"""Micro-batch upkeep of derived tables: drop what changed files had, derive it anew, publish a version.

Tables are kept in BUCKETS parts by a hash of the path.  A batch writes only the parts that hold its paths, each in a
folder of its own, and then names the folders of all parts in one small row: readers always see one whole version, and
parts that a batch does not touch are not written again.  A batch that is run again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.runtime import Scratch

Derive = Callable[[DataFrame], DataFrame]
#: Parts that a table is kept in.
BUCKETS = 32
_POINTER = "version int, stream string, batch bigint, folders map<string, string>"


def coalesced(changes: DataFrame) -> DataFrame:
    """(path, kind, content): the last change of each path in a batch (path, kind, at, content)."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("kind", "content"), "at").alias("x"))
    return last.select("path", "x.kind", "x.content")


def dependents(imports: DataFrame, changed: DataFrame, rounds: int = 100) -> DataFrame:
    """(path): files that import a changed file (path), directly or not, without the changed ones; ``imports`` is (path, target)."""
    from strandline.operators.traverse import reachable

    edges = imports.select(F.col("target").alias("src"), F.col("path").alias("dst"))
    met = reachable(edges, changed.select(F.col("path").alias("node")), rounds)
    return met.select(F.col("node").alias("path")).distinct().join(changed.select("path"), "path", "left_anti")


def surface(nodes: DataFrame) -> DataFrame:
    """(path, surface): a hash of what other files can see of a file, signatures included."""
    seen = F.concat_ws("|", "kind", "parent_id", "name", F.col("exported").cast("string"), "signature")
    return nodes.groupBy(F.col("file").alias("path")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(seen)), "\n"), 256).alias("surface"))


@dataclass(frozen=True)
class Maintainer:
    """Keeps ``rows(path, ...)`` = derive(files(path, content)) under ``root``.

    Where ``imports`` (rows -> path, target) and ``seen`` (rows -> path, surface) are given, files that import a changed
    file are derived again too, but only if what others see of it has changed.  ``deriving`` is told what is derived.
    """

    spark: SparkSession
    root: str
    derive: Derive
    imports: Derive | None = None
    seen: Derive | None = None
    deriving: Callable[[DataFrame], None] | None = None

    def _pointer(self, version: int | None = None):
        """The row that publishes a version, the last by default; None before the first."""
        try:
            found = self.spark.read.schema(_POINTER).json(f"{self.root}/published")
        except Exception as e:  # no pointer yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return (found if version is None else found.filter(F.col("version") == version)).orderBy(F.desc("version")).first()

    def version(self) -> int:
        """The last published version; 0 before the first."""
        row = self._pointer()
        return int(row["version"]) if row else 0

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """``files`` or ``rows`` of a version."""
        row = self._pointer(version)
        if row is None:
            raise ValueError(f"no version {version or ''} under {self.root}")
        return self._parts(table, row["folders"])

    def _parts(self, table: str, folders: dict[str, str], buckets: list[int] | None = None) -> DataFrame:
        wanted = [v for k, v in sorted(folders.items()) if k.startswith(f"{table}/") and (buckets is None or int(k.split("/")[1]) in buckets)]
        schema = self.spark.read.schema(self._schema(table))
        return schema.parquet(*[f"{self.root}/{x}" for x in wanted]) if wanted else self.spark.createDataFrame([], self._schema(table))

    def _schema(self, table: str):
        return self.spark.read.parquet(f"{self.root}/{table}/schema").schema

    def build(self, files: DataFrame) -> None:
        """The first version, from all files (path, content)."""
        for name, df in (("files", files), ("rows", self.derive(files))):
            df.limit(0).write.mode("overwrite").parquet(f"{self.root}/{name}/schema")
        self._publish(1, "", -1, {}, files, self.derive(files), list(range(BUCKETS)))

    def apply(self, changes: DataFrame, batch_id: int, stream: str = "") -> None:
        """One micro-batch of changes (path, kind, at, content); for ``foreachBatch``.

        Batches of one ``stream`` come in order; one that was published already is left out.
        """
        done = self.spark.read.schema(_POINTER).json(f"{self.root}/published").filter(F.col("stream") == stream).agg(F.max("batch").alias("b")).first()["b"]
        if done is not None and done >= batch_id:
            return
        row = self._pointer()
        scratch = Scratch(self.spark, "upkeep")
        last = scratch.put("last", coalesced(changes).withColumn("bucket", _bucket()))
        updated = last.filter("kind <> 'remove'").select("path", "content")
        fresh = scratch.put("fresh", self._derived(updated))
        again = self._to_derive(last, fresh, row["folders"], scratch)
        touched = last.select("path", "bucket") if again is None else last.select("path", "bucket").union(again.select("path", _bucket()))
        buckets = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())  # at most BUCKETS numbers
        files, rows = (self._parts(t, row["folders"], buckets) for t in ("files", "rows"))
        new_files = files.join(last.select("path"), "path", "left_anti").unionByName(updated)
        new_rows = rows.join(touched.select("path"), "path", "left_anti").unionByName(fresh)
        if again is not None:
            new_rows = new_rows.unionByName(self._derived(again))
        self._publish(row["version"] + 1, stream, batch_id, row["folders"], new_files, new_rows, buckets)

    def _derived(self, files: DataFrame) -> DataFrame:
        if self.deriving is not None:
            self.deriving(files)
        return self.derive(files)

    def _to_derive(self, last: DataFrame, fresh: DataFrame, folders: dict[str, str], scratch: Scratch) -> DataFrame | None:
        """(path, content) of the files to derive again because a file that they import looks different; None without imports."""
        if self.imports is None or self.seen is None:
            return None
        rows = self._parts("rows", folders)
        before = self.seen(rows.join(last.select("path"), "path", "left_semi")).withColumnRenamed("surface", "old")
        both = last.select("path").join(before, "path", "left").join(self.seen(fresh), "path", "left")
        different = scratch.put("different", both.filter(~F.col("old").eqNullSafe(F.col("surface"))).select("path"))
        if different.isEmpty():
            return None
        near = dependents(self.imports(rows), different).join(last.select("path"), "path", "left_anti")
        return scratch.put("again", self._parts("files", folders).join(near, "path", "left_semi").select("path", "content"))

    def _publish(self, version: int, stream: str, batch: int, folders: dict[str, str], files: DataFrame, rows: DataFrame, buckets: list[int]) -> None:
        """Write the given parts of both tables in new folders, then the row that names the folders of all parts."""
        now, mark = dict(folders), f"v{version}-{uuid.uuid4().hex}"
        for table, df in (("files", files), ("rows", rows)):
            df.withColumn("bucket", _bucket()).write.partitionBy("bucket").parquet(f"{self.root}/{table}/{mark}")
            there = {r["bucket"] for r in self.spark.read.parquet(f"{self.root}/{table}/{mark}").select("bucket").distinct().collect()} if not df.isEmpty() else set()
            for b in buckets:
                now.pop(f"{table}/{b}", None)
                if b in there:
                    now[f"{table}/{b}"] = f"{table}/{mark}/bucket={b}"
        self.spark.createDataFrame([(version, stream, batch, now)], _POINTER).coalesce(1).write.mode("append").json(f"{self.root}/published")

    def clean(self) -> int:
        """Remove the folders that the last version does not name; how many they were."""
        row = self._pointer()
        if row is None:
            return 0
        kept = {x.rsplit("/", 1)[0] for x in row["folders"].values()}
        jvm, gone = self.spark.sparkContext._jvm, 0
        for table in ("files", "rows"):
            top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for entry in fs.listStatus(top):
                name = f"{table}/{entry.getPath().getName()}"
                if name not in kept and not name.endswith("/schema"):
                    fs.delete(entry.getPath(), True)
                    gone += 1
        return gone

    def reconcile(self, current: DataFrame, stream: str = "reconcile") -> None:
        """After missed events: one batch of what differs by content between the published files and ``current`` (path, content)."""
        from strandline.sources.tree import stale

        digest = lambda df: df.select("path", F.sha2("content", 256).alias("sha256"))
        found = stale(digest(self.read("files")), digest(current))
        kind = F.when(F.col("change") == "deleted", "remove").otherwise("update")
        self.apply(found.join(current, "path", "left").select("path", kind.alias("kind"), F.lit(0).alias("at"), "content"), self.version(), stream)

    def run(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        """A streaming query that applies each micro-batch of ``stream``: what is there, or, with ``every``, each such interval.

        A checkpoint numbers its own batches, so another checkpoint is another stream.
        """
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n, checkpoint)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _bucket():
    return F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")
