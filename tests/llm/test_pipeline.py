import collections

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_their_contracts(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k in (0, 1):
            ids = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
            assert max(ids.values()) == 1 and ids.keys() <= {r["doc_id"] for r in before.select("doc_id").collect()}
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4]
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes[5]
