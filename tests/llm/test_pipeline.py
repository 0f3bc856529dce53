import corpus_pipeline
from loomstat.llm import quality, secrets, simhash
from pyspark.sql import functions as F


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    model = quality.fit(quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    want = {r["doc_id"] for r in quality.scores(docs, model).where(F.col("score") >= 0.7).collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and tuple(kept.columns) == corpus_pipeline.COLUMNS
    single = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    groups = {r["component_id"] for r in simhash.near_duplicates(kept, words=corpus_pipeline.SHINGLE_WORDS, similarity=corpus_pipeline.SIMILARITY).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(groups) and len(single.select("text").distinct().collect()) == single.count()
    clean = corpus_pipeline.redact_secrets(spark, single, sf_dir)
    assert clean.count() == single.count()
    assert secrets.scan(clean, secrets.fit(secrets.labelled(spark))).where("size(spans) > 0").count() == 0
    out = corpus_pipeline.pack_sequences(spark, clean, sf_dir)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in clean.collect()}


def test_null_ids_and_repeated_rows(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (2, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (None, "quite another text that has no id", "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3]


def test_all_documents_stay_without_a_model(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"a clean text {k}", "en", "s", 14) for k in range(9)] + [(9, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, labels in enumerate(([], [(0, 1, 0), (1, 0, 0), (3, 0, 0)])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        kept = corpus_pipeline.keep_quality(spark, docs, f"{tmp_path}/{k}")
        assert kept.count() == 10 and tuple(kept.columns) == corpus_pipeline.COLUMNS
