"""The pipeline's stages on documents whose fate is known."""

import corpus_pipeline


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[2:4]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and 0 < kept.count() < docs.count(), name
    rows = corpus_pipeline.run(spark, sf)
    assert 0 < rows.count() < docs.count() and "doc_id" in rows.columns
