import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == n and {"shard", "slot", "size"} <= set(last.columns)
    run = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in run.collect()) == sorted(r.doc_id for r in docs.collect())
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[1][0]] == [5, "near_dedup"]
