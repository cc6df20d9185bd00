"""What the third round's findings showed, each on a small input."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from conftest import same_rows
from pyspark.sql import functions as F

from docloom import catalog
from docloom.functions.text import upper_by_character
from docloom.llm import langid
from docloom.operators import lexical


def folder_of(tmp_path, **tables):
    for name, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def same(spark, folder, name):
    same_rows(catalog.QUERIES[name](spark, folder), catalog.ORACLES[name], folder)


def test_heading_ids_by_character(spark, tmp_path):
    """the upper case of \u00df is one character in SQL."""
    words = ["Ch\u00df.", "Ab \ufb01xe.", "\u1fb3 alpha.", "Plain abcde.", "\u00df\u00dfx\u0149a."]
    found = spark.createDataFrame([(w,) for w in words], "t string").select(upper_by_character(F.col("t")).alias("u"))
    assert [r.u for r in found.collect()] == ["CH\u1e9e.", "AB \ufb01XE.", "\u1fbc ALPHA.", "PLAIN ABCDE.", "\u1e9e\u1e9eX\u0149A."]
    docs = [{"doc_id": i, "text": f"one\n{w}\nSchach. Ch\u00df.\ntwo\n"} for i, w in enumerate(words)]
    same(spark, folder_of(tmp_path, documents=docs), "heading_blocks")


def test_history_of_many_conversations(spark, tmp_path):
    """more than 1,000 conversations, where the latest after the change are not the latest before it."""
    turns = [{"conv_id": c, "turn": t, "role": ("user", "assistant")[t % 2], "text": "x"} for c in range(2500) for t in range(3 if c < 2000 else 1)]
    same(spark, folder_of(tmp_path, conversations=turns), "history_saved")


def documents_of(texts, ids=None):
    return [{"doc_id": i, "text": t, "source": "s", "lang": "en", "n_chars": len(t or "")} for i, t in zip(ids or range(len(texts)), texts)]


TEXTS = ["one two two", "", None, "two three-four THREE two", "five", "one one one one"] * 5


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_term_counts_without_a_shuffle(spark, tmp_path):
    """Tokens are counted within their documents; repeated keys are merged as the SQL has them."""
    folder = folder_of(tmp_path, documents=documents_of(TEXTS, [*range(20), *range(10)]))
    same(spark, folder, "doc_freq")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = docs.select("doc_id", F.coalesce(lexical.index_tokens(F.col("text"), (), False), F.array().cast("array<string>")).alias("__tokens"))
    counts = lexical.term_counts(own, "doc_id")
    assert exchanges(counts) == 0
    found = sorted((r.term, r.tf, r.dl) for r in counts.where("doc_id = 3").collect())
    assert found == [("one", 4, 4), ("three", 1, 4), ("three-four", 1, 4), ("two", 2, 4)]


def test_usual_bits_of_all_rows(spark):
    """the limits are medians of all labelled rows, however many a language has."""
    rng = random.Random(1)
    words = {"en": ["the", "house", "of", "water", "and", "green"], "de": ["das", "haus", "und", "wasser", "grün", "der"]}
    rows = [(i, g, " ".join(rng.choices(w, k=rng.randint(1, 9)))) for g, w in words.items() for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    model = langid.train(docs)
    found = langid.identify(docs, model)
    exact = found.where("lang = lang_pred").groupBy("lang").agg(F.percentile("bits_per_byte", F.lit(0.5)).alias("m"))
    assert langid.usual_bits(docs, model) == {r.lang: r.m for r in exact.collect()}
