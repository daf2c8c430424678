"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from buildlens.llm.common import store
from buildlens.llm.tokens import vocabulary_text
from tests.llm.conftest import ODD
from tests.llm.test_alike import slow_firsts
from tests.llm.test_dedup import slow_removal
from tests.llm.test_tokens import check_packing


def test_stages_on_their_own_inputs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, rows = docs.schema, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = store(stage(spark, docs, folder), name)
        rows = docs.collect()
        if name != "packing":
            assert docs.schema.names == schema.names
            assert all(r.n_chars == len(r.text) for r in rows)
        if name in ("quality", "language"):
            assert 0.7 * len(before) < len(rows) <= len(before)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in rows) == slow_firsts([(i, r.text) for i, r in before.items()])
        if name == "repeated_passages":
            want = slow_removal([(i, r.text) for i, r in before.items()], 50)
            assert {r.doc_id: len(r.text.split()) for r in rows} == {i: n - gone for i, n, gone, _ in want}
            kept = [(r.doc_id, r.text) for r in rows]
    check_packing(rows, kept, 2048)
    assert corpus_pipeline.run(spark, folder).count() == len(rows)


def test_stages_on_odd_and_empty_rows(spark, odd):
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            names = docs.columns
            docs = store(stage(spark, docs, ""), name)
            assert docs.columns == names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
    assert len(ODD) == odd.count() and vocabulary_text(corpus_pipeline.VOCABULARY)
