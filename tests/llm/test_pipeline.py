import corpus_pipeline
import __spark_entry__

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, DIR), "test")
        kept = out.count()
        assert 0.7 * n <= kept <= n
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs, n = out, kept
    assert __spark_entry__.queries()["pipeline"](spark, DIR).count() == n


def test_all_operators_are_registered():
    names = {q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)}
