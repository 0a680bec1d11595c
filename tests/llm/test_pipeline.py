import corpus_pipeline
from polyscan.llm import quality, simhash


def test_stages_take_effect_and_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before, n = docs.columns, docs, docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == columns, name
        kept.append((name, after))
        before = after
    by = dict(kept)
    stats = quality.features(docs)
    scores = quality.scores(stats, quality.fit(spark, stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    good = {r.id for r in scores.where("predicted = 1").collect()}
    assert {r.doc_id for r in by["quality"].select("doc_id").collect()} == good and len(good) < n
    classes = simhash.near_duplicates(spark, by["quality"]).collect()
    assert {r.doc_id for r in by["near_dedup"].select("doc_id").collect()} == {r.component_id for r in classes}
    assert all(r.n_chars == len(r.text) for r in by["passages"].collect())
    out = corpus_pipeline.STAGES[-1][1](spark, by["mixing"], sf_dir)
    assert out.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()
