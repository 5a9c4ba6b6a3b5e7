"""Session helpers: table loading and materialisation that survives lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan gives fewer splits than there are cores; else as it is.

    A small file is one split, whatever work its rows need; a large table has
    splits enough and is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (a local master) that names none, a temporary folder is
    made and registered for this application; elsewhere that is a RuntimeError, as
    the driver could not read what executors write there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts the lineage: a lost executor costs only the tasks that
    it ran.  ``drop`` removes a table that no later plan reads; what the result
    still reads is removed when the driver exits.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strandline/{label}-{uuid.uuid4().hex}"
        atexit.register(self._clear, self.root)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def split(self, name: str, df: DataFrame, by: str, values: list) -> list[DataFrame]:
        """One table for each of ``values`` of column ``by``, each to be dropped alone as ``name/by=value``."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").partitionBy(by).parquet(path)
        schema = df.drop(by).schema
        empty = df.sparkSession.createDataFrame([], schema)
        out = []
        for v in values:
            empty.write.mode("append").parquet(f"{path}/{by}={v}")
            out.append(self.spark.read.schema(schema).parquet(f"{path}/{by}={v}"))
        return out

    def free(self) -> None:
        """Let go of the shuffle files of jobs that are done: Spark removes them only once the driver collects its garbage.

        What the last job wrote may still be held while its end is reported, so ask after a further, smaller job.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._clear(f"{self.root}/{name}")

    def _clear(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session may be gone at exit
            pass


def iterate(
    scratch: Scratch,
    name: str,
    state: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    changed: Callable[[DataFrame], bool],
    rounds: int,
) -> DataFrame:
    """Apply ``step`` until ``changed`` says no, RuntimeError if ``rounds`` do not suffice; each round's table is written once."""
    state = scratch.put(f"{name}-0", state)
    for k in range(1, rounds + 1):
        after = scratch.put(f"{name}-{k}", step(state))
        go_on = changed(after)
        scratch.drop(f"{name}-{k - 1}")
        state = after
        if not go_on:
            return state
    raise RuntimeError(f"{name}: not settled after {rounds} rounds")
