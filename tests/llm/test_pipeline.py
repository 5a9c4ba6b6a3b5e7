"""The stages on what their predecessors kept, held against brute force."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_llm_operators import ODD, SF, brute_quality, brute_spans, check_packing, components, drain, verdict  # noqa: E402

import corpus_pipeline  # noqa: E402
from strandline.llm import linededup, secret_scan  # noqa: E402
from strandline.runtime import table  # noqa: E402


def test_stages_equal_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    names = docs.columns
    state = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name == "quality":
            state = {d: t for d, t in state.items() if verdict(*brute_quality(t))}
        elif name == "lines":
            gone = drain(state, linededup.TemplateSettings())
            state = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone.get(d, ()))) for d, t in state.items()}
            state = {d: t for d, t in state.items() if d not in gone or t.split()}
        elif name == "near_dedup":
            component = components(state, 5)[0]
            state = {d: t for d, t in state.items() if component[d] == d}
        elif name == "secrets":
            state = {d: secret_scan.redacted(t, [(int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_spans(t))]) for d, t in state.items()}
        if name == "packing":
            assert {r.doc_id for r in rows} == set(state)
            check_packing(rows, 1024)
        else:
            assert docs.columns == names
            assert {r.doc_id: r.text for r in rows} == state
            if name in ("lines", "secrets"):
                assert all(r.n_chars == len(r.text) for r in rows)


def test_run_and_odd_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    odd = spark.createDataFrame([(i, t, "en", "s", 0, "z") for i, t in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string")
    for frame in (odd, odd.limit(0)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF).cache()
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
