"""Queries that once differed from their SQL on larger tables, held against it on small ones."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def held(spark, folder, name):
    """(rows of the query, rows of its SQL) over the tables of ``folder``, in order of their text."""
    db = duckdb.connect()
    for path in folder.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}/*.parquet'")
    found = entry.queries()[name](spark, str(folder))
    want = db.execute(f"select {', '.join(found.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, want))


def test_a_literal_in_another_case_is_not_the_same(spark, tmp_path):
    texts = ["Les.", "les.", "LES.", "Miles. a", "no", None]
    spark.createDataFrame([(i, t, "fr") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = held(spark, tmp_path, "search_literal")
    assert got == want and repr((1, True, 4)) in got and repr((0, False, 4)) in got


def test_two_hits_on_one_line_are_one_row(spark, tmp_path):
    for name, keys in {"part": ["p_partkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}.items():
        one = spark.read.parquet(f"{SF}/{name}.parquet")
        both = one.union(one.select(*[(F.col(c) + (200 if c == "l_partkey" or c == "p_partkey" else 1_000_000)).cast(one.schema[c].dataType).alias(c) if c in keys else F.col(c) for c in one.columns]))
        both.write.parquet(str(tmp_path / f"{name}.parquet"))
    got, want = held(spark, tmp_path, "hit_blast_radius")
    assert got == want and want


def test_what_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    rows = [(i, [-1e-8 if k == i else 1e-8 if k == 5 else 0.5 for k in range(64)]) for i in range(0, 6, 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = held(spark, tmp_path, "semantic_diffusion")
    assert got == want and all("-0.0," in row for row in want)
