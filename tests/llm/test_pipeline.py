"""The corpus pipeline, stage by stage, against plain versions and on odd rows."""

import random

import pytest
from pyspark.sql import functions as F
from test_dedup import brute_jaccard

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "the same text of some words that is here twice", "en", "a", 46),
    (4, "The same text of some words that is here twice", "en", "b", 46),
    (5, "word " * 30_000, "en", None, 150_000),
    (6, "12 34 !!", None, "a", 8),
    (None, "a text without a key but with some more words", "en", "a", 45),
    (3, "the same text of some words that is here twice", "en", "a", 46),
]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_keep_columns(spark, sf, documents):
    docs = documents
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == documents.columns, name
        assert 0 < after.count() <= docs.count()
        docs = after.persist()
    last = pipeline.tokens(spark, docs, sf)
    assert last.columns == ["doc_id", "ids", "n_tokens"] and last.count() == docs.count()


def test_near_duplicate_stage(spark, sf, documents):
    want = {k for k, (_, c) in brute_jaccard([(r.doc_id, r.text) for r in documents.collect()], 5, 80, 100).items() if k == c}
    assert {r.doc_id for r in pipeline.near_duplicates(spark, documents, sf).collect()} == want


def test_language_stage_keeps_clean(spark, sf, documents):
    kept = {r.doc_id for r in pipeline.language(spark, documents, sf).collect()}
    clean = {r.doc_id for r in documents.where("length(text) > 200 and lang is not null").collect()}
    assert len(clean - kept) <= len(clean) // 100


def test_near_duplicate_stage_by_row(spark, sf):
    """Unlike texts under one doc_id stay, copies under one doc_id do not, further columns are left alone."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en", "a", 1, 7), (1, long, "en", "a", 1, 7), (1, "quite another text of some words here", "en", "a", 1, 8), (None, long + " x", "en", "a", 1, 9), (2, "", "en", "a", 1, 1), (2, "", "en", "a", 1, 1), (3, None, None, None, None, 2)]
    docs = spark.createDataFrame(rows, SCHEMA + ", __n long").withColumnRenamed("__n", "component_id")
    kept = [(r.doc_id, r.text, r.component_id) for r in pipeline.near_duplicates(spark, docs, sf).collect()]
    assert sorted(kept, key=str) == sorted([(1, long, 7), (1, rows[2][1], 8), (2, "", 1), (2, "", 1), (3, None, 2)], key=str)


def test_language_stage_rejects_what_fits_no_language(spark, sf, documents):
    rng = random.Random(0)
    noise = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(3, 9))) for _ in range(60)), "これは日本語の文章です。" * 10, "Это предложение написано по-русски. " * 5]
    extra = spark.createDataFrame([(10**9 + i, t, None, "a", len(t)) for i, t in enumerate(noise)], SCHEMA).select(*documents.columns)
    docs = documents.unionByName(extra).withColumn("lang_pred", F.lit("own")).withColumn("bits_per_byte", F.col("doc_id"))
    kept = pipeline.language(spark, docs, sf).select("doc_id", "lang", "lang_pred", "bits_per_byte").collect()
    assert not any(r.doc_id >= 10**9 for r in kept) and all(r.lang_pred == "own" and r.bits_per_byte == r.doc_id and r.lang for r in kept)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, sf, name):
    stage = dict(pipeline.STAGES)[name]
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert stage(spark, odd, sf).count() <= len(ODD)
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0
