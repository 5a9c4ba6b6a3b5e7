"""The graph's tables on disk: one folder per table and version, a pointer to the last version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.model import SCHEMA_VERSION


def write_graph(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """All tables, then the pointer that publishes them; readers never see a part."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/v{version}")
    meta = spark.range(1).select(F.lit(version).alias("version"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.array(*[F.lit(n) for n in sorted(tables)]).alias("tables"))
    meta.write.mode("append").json(f"{root}/_meta")


def read_graph(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the last by default; ValueError if another schema wrote it."""
    meta = spark.read.schema("version int, schema_version int, tables array<string>").json(f"{root}/_meta")
    row = (meta if version is None else meta.filter(F.col("version") == version)).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"no version under {root}")
    if row["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema {row['schema_version']}, expected {SCHEMA_VERSION}")
    return {name: spark.read.parquet(f"{root}/{name}/v{row['version']}") for name in row["tables"]}


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted JSON lines, so that two writes of equal rows are equal."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def valid_vectors(vectors: DataFrame, files: DataFrame) -> bool:
    """Whether stored vectors (file, sha256) were made from exactly ``files`` (path, sha256)."""
    a = vectors.select(F.col("file").alias("path"), "sha256").distinct()
    b = files.select("path", "sha256")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
