"""The pipeline's stages on planted rows, each against what its operator should do."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_methods import appended, frame, plain_classes

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    text = docs.orderBy(F.desc("n_chars")).first().text
    planted = spark.createDataFrame([(900_001, "12 34 !!", "en", "p", 8), (900_002, text, "en", "p", 1), (900_003, text + " again", "en", "p", 1), (900_004, "Before. " + item + " After.", "en", "p", 1), (900_005, None, None, None, None)], docs.schema)
    now = docs.union(planted)
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
        assert now.columns == docs.columns
        ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert not ids["languages"] & {900_001, 900_005} and {900_002, 900_003, 900_004} <= ids["languages"]
    assert ids["lines"] == ids["languages"]
    assert not ids["near_copies"] & {900_002, 900_003} and 900_004 in ids["near_copies"]
    assert 900_004 not in ids["benchmark"]
    assert 0 < len(ids["mix"]) <= len(ids["benchmark"])
    clean = docs.join(docs.groupBy("text").count().where("count = 1"), "text").count()
    assert len(ids["languages"]) >= 0.95 * docs.count() and len(ids["near_copies"]) >= 0.8 * clean


def test_run_returns_documents(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_texts_with_an_added_paragraph_are_near_copies(spark):
    texts = appended(6, 100, 0.1, 0.2)
    want = set(plain_classes(texts))
    assert len(want) == len(texts) // 2
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, texts), SMALL).collect()} == want
