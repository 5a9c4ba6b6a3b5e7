"""Streams give what the same expressions give on tables; upkeep equals a full build."""

import pytest
from pyspark.sql import functions as F

from strandline.runtime import table
from strandline.streaming import journal, maintain, windows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["tumbling", "sessions"])
def test_stream_equals_table(spark, tmp_path, kind):
    events = table(spark, SF, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    make = getattr(windows, kind)
    # Complete results need no watermark; sessions in append mode would keep back the last ones.
    q = make(stream).writeStream.format("memory").queryName(f"w_{kind}").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table(f"w_{kind}").collect(), make(events).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def derive(files):
    return files.select("path", F.explode(F.split("content", r"\n")).alias("row"))


def test_upkeep_equals_full_build(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", f"a{i}\nb{i}") for i in range(5)], "path string, content string")
    keeper = maintain.Maintainer(spark, str(tmp_path / "state"), derive)
    keeper.build(files)
    schema = "path string, kind string, at int, content string"
    batches = [[("f1", "update", 1, "x"), ("f2", "remove", 2, None), ("f2", "update", 3, "y\nz")], [("f1", "remove", 4, None), ("new", "update", 5, "n")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"in/b{i}"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in/*"))
        keeper.run(stream, str(tmp_path / "cp")).awaitTermination(120)
    keeper.apply(spark.createDataFrame(batches[1], schema), 1, str(tmp_path / "cp"))  # a batch that comes again changes nothing
    assert keeper.version() == 3
    final = keeper.read("files")
    assert {r.path for r in final.collect()} == {"f0", "f2", "f3", "f4", "new"}
    assert sorted(map(tuple, keeper.read("rows").collect())) == sorted(map(tuple, derive(final).collect()))
    assert {tuple(r) for r in keeper.read("rows", 1).collect()} == {tuple(r) for r in derive(files).collect()}


def test_another_checkpoint_and_missed_events(spark, tmp_path):
    keeper = maintain.Maintainer(spark, str(tmp_path / "state"), derive)
    keeper.build(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string"))
    schema = "path string, kind string, at int, content string"
    for n, text in enumerate(("x", "y")):  # each checkpoint numbers its batches from 0
        keeper.apply(spark.createDataFrame([("a", "update", 1, text)], schema), 0, f"checkpoint {n}")
    assert {(r.path, r.row) for r in keeper.read("rows").collect()} == {("a", "y"), ("b", "2")}
    keeper.reconcile(spark.createDataFrame([("b", "3"), ("c", "4")], "path string, content string"))
    assert {(r.path, r.row) for r in keeper.read("rows").collect()} == {("b", "3"), ("c", "4")}
    assert keeper.clean() > 0 and {r.path for r in keeper.read("files").collect()} == {"b", "c"}


def test_dependents_are_derived_again_if_the_surface_changed(spark, tmp_path):
    """Rows are name=value or import lines; what others see is the names."""
    told = []
    keeper = maintain.Maintainer(
        spark, str(tmp_path / "state"), derive, lambda rows: rows.filter("row like 'import %'").selectExpr("path", "substring(row, 8) as target"),
        lambda rows: rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.substring_index("row", "=", 1))), ",").alias("surface")), lambda df: told.append(sorted(r.path for r in df.collect())),
    )
    keeper.build(spark.createDataFrame([("a", "x=1"), ("b", "import a\ny=1"), ("c", "import b"), ("d", "z=1")], "path string, content string"))
    schema = "path string, kind string, at int, content string"
    keeper.apply(spark.createDataFrame([("a", "update", 1, "x=2")], schema), 0)
    assert told == [["a"]]  # a value changed: nobody else sees it
    keeper.apply(spark.createDataFrame([("a", "update", 1, "w=2")], schema), 1)
    assert told[1:] == [["a"], ["b", "c"]]
    assert sorted(map(tuple, keeper.read("rows").collect())) == sorted(map(tuple, derive(keeper.read("files")).collect()))


def test_dependents(spark):
    imports = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x"), ("a", "c")], "path string, target string")
    assert {r.path for r in maintain.dependents(imports, spark.createDataFrame([("a",)], "path string")).collect()} == {"b", "c"}


def test_missed_history(spark):
    entries = spark.createDataFrame([(i,) for i in range(1, 301)], "seq bigint")
    assert journal.missed_history(entries, 99) and not journal.missed_history(entries, 100) and not journal.missed_history(entries.limit(0), 0)
