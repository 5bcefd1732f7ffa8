import collections

import corpus_pipeline
from windrow.llm import attention_mil, occurrence_join, open_windows, positional_index, subword_language
from windrow.llm.queries import QUERIES
from windrow.llm.registry import table

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    docs = table(spark, SMALL, "documents").cache()
    labels, benchmark = table(spark, SMALL, "labels"), table(spark, SMALL, "benchmark")
    rows = lambda df: collections.Counter(tuple(r) for r in df.collect())
    for (name, stage), step in zip(corpus_pipeline.STAGES[:-1], (5, 8, 6, 2)):
        out = stage(spark, docs, SMALL).cache()
        assert out.columns == docs.columns, name
        verdict = {
            5: lambda: {r.doc_id for r in attention_mil.classified(docs, labels).collect() if r.predicted},
            8: lambda: {r.doc_id for r in subword_language.identified(docs).collect() if r.accepted},
            6: lambda: {r.doc_id for r in occurrence_join.grouped(docs).collect() if r.doc_id == r.component_id},
            2: lambda: {r.doc_id for r in positional_index.contaminated(docs, benchmark).collect() if not r.contaminated},
        }[step]()
        assert rows(out) == rows(docs.where(docs.doc_id.isin(verdict))), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()} == {r.doc_id for r in packed}


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_one_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert open_windows.Settings().length == 2048
