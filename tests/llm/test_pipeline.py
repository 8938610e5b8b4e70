import hashlib

import corpus_pipeline
from tessera.llm.common import cut_table


def test_run_applies_the_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_table(stage(spark, docs, d))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted((r.doc_id, r.decoded, r.n_tokens) for r in corpus_pipeline.run(spark, d).collect())
    assert [g[:2] for g in got] == [(i, t or "") for i, t in texts]
    assert len({hashlib.sha256(t.encode()).digest() for _, t in texts}) == len({i for i, _ in texts})
