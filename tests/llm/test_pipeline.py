"""The pipeline's stages in order, each on all that its predecessor kept."""

from collections import defaultdict

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.persist()
        after = docs.count()
        assert 0.5 * before < after <= before, name
        before = after
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16,}'").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(mixed) == before
    per = defaultdict(lambda: [0, 0.0])
    for r in mixed:
        per[(r.source_size, r.target)][0] += r.taken
    assert all(abs(taken - target) <= max(0.5 * target, 6000) for (_, target), (taken, _) in per.items())
    assert len(corpus_pipeline.run(spark, sf).collect()) == before
