"""Near duplicates of repeated ids, and of families that stay below the threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import components

import corpus_pipeline
from strandline.llm.neardup import SketchSettings, near_duplicates, one_of_each, prefix_rows


def family(n, own=14, seed=5):
    rng = np.random.default_rng(seed)
    template = [f"t{k}" for k in range(100)]
    return {i: " ".join(template + [f"own{i}x{rng.integers(10**9)}" for _ in range(own)]) for i in range(n)}


@pytest.mark.parametrize("n", [60, 120])
def test_a_family_below_the_threshold_makes_no_pairs(spark, n):
    """t = 99 common two-word shingles and 14 own ones each: 99 / 127 < 0.8."""
    s = SketchSettings(words=2)
    sets = [(i.to_bytes(16, "big"), i.to_bytes(16, "big"), 113, [{"count": n, "g": g} for g in range(99)]) for i in range(n)]
    frame = spark.createDataFrame(sets, "node binary, component binary, n bigint, order array<struct<count: bigint, g: bigint>>")
    rows = prefix_rows(frame, s)
    assert rows.filter("not probe").count() == 0
    rows = family(n)
    frame = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    assert {r.component_id for r in near_duplicates(spark, frame, s).collect()} == set(range(n))


def test_families_around_the_threshold_equal_all_pairs(spark):
    rows = {}
    for k, own in enumerate((8, 11, 12, 13, 14, 16)):
        rows.update({100 * k + i: t for i, t in family(25, own, seed=own).items()})
    frame = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(spark, frame, SketchSettings(words=2)).collect()}
    assert got == components(rows, 2)[0]


A, B, C = ("alpha beta gamma delta epsilon zeta eta theta " * 3, "one two three four five six seven eight nine ten " * 3, "red green blue cyan pink teal gray black " * 3)


def test_repeated_ids_of_different_texts(spark):
    rows = [(1, A, 1), (5, A, 2), (5, B, 3), (7, C, 4), (7, C, 5), (8, B + " more", 6), (None, A, 7), (None, A, 8), (9, "", 9), (9, None, 10), (10, " ", 11)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, extra int")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near_duplicates(spark, frame, SketchSettings(words=2)).collect())
    assert got.count(("7", 8, 7)) == 2 and ("5", 8, 1) in got and ("5", 10, 5) in got and ("8", 11, 5) in got
    stay = sorted((str(r.doc_id), r.text) for r in one_of_each(spark, frame, SketchSettings(words=2)).collect() if r.text is not None)
    assert stay == sorted([("1", A), ("5", B), ("7", C), ("None", A), ("None", A), ("9", ""), ("10", " ")])


def test_stages_take_columns_with_the_names_used_inside(spark):
    rows = [(1, A, 0, "x", "y", "z"), (2, A, 0, "x", "y", "z"), (3, "x y z 1 2 3 4 5 6\n" + B, 0, "x", "y", "z"), (4, "x y z 1 2 3 4 5 6", 0, "x", "y", "z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, _Dropped string, _gone string, text_id string")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, frame, "")
        assert out.columns == frame.columns and out.select(F.count("text_id")).first()[0] > 0
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [1, 3, 4]
