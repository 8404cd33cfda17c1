"""The pipeline's stages one after another, against what each stage must do to its own input."""

import corpus_pipeline
from kinseg.llm import registry
from kinseg.llm.shared import written

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name.replace(" ", "-"))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and after.items() <= before.items()
        if name == "exact dedup":
            assert len({t.lower() for t in after.values()}) == len(after) == len({t.lower() for t in before.values()})
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(before)


def test_odd_and_empty_rows_pass_every_stage(spark, odd, none):
    for docs in (odd, none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SMALL), name.replace(" ", "-"))
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= 0


def test_every_number_has_a_query():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(registry.oracles()) <= set(names)
