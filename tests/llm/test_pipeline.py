import corpus_pipeline
from plumbline.llm import queries

from .helpers import corpus, empty

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    names, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "line_dedup", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == names
            assert out.count() <= before
        docs, before = out, out.count()
    assert before > 0


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), DATA).count() == 0


def test_queries_equal_sql(same):
    for name, sql in queries.ORACLE.items():
        same(name, queries.QUERIES[name], sql)
