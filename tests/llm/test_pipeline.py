import __spark_entry__ as entry
import corpus_pipeline


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def test_stages_follow_each_other(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= count
            count = docs.count()
    assert docs.select("doc_id").distinct().count() == count
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
