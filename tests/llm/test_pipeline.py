import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_end_in_packed_sequences(spark):
    from groundmark.llm.common import materialise, table

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= 2 * before
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    used = {}
    for r in found:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 1024


def test_run_equals_the_stages_and_is_stable(spark):
    one = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    two = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert one == two and one


def test_every_query_is_registered():
    from groundmark.llm import queries

    assert sorted(int(x[2:].split("_")[0]) for x in queries.queries()) == list(range(1, 14))


def test_run_and_stages_on_empty_tables(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, str(tmp_path))
        assert out.collect() == [], name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == no_docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
