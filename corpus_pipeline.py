"""A training-corpus pipeline over documents: language, near duplicates, secrets, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of docs.

1. language: documents without a letter go, those whose best language has less than half of the likelihood, and
   those that need over FOREIGN times the bits per byte that is usual in their best language, as they are in none.
   A null lang is filled in; a given one stays, even if another is predicted. The model is
   trained on the stage's own labelled rows; without any, no document can be told and all go.
2. near_duplicates: of documents whose sets of five-word shingles are connected by similarities of at
   least 0.8, the one with the smallest doc_id stays (all documents without words stay). Documents are told apart by
   text, not by doc_id; of rows that repeat both one stays.
3. secrets: every secret span of the text is replaced by a mark, and n_chars is set anew where the text changed.
4. mixture: documents are drawn, once at most, by raked probabilities towards tempered source, language and topic
   shares of MIX_BUDGET of the tokens.
5. tokens: doc_id, token ids of the whole text, and their number.

Nulls in any column, repeated rows and empty tables pass through as the operators define it: a null text has no
letter and goes in stage 1, a null doc_id is a document like others, a null source or lang is a margin value
of its own. Added columns have reserved names (two underscores), so further columns of documents stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import jaccard_join, langid, mixing, pieces, secrets
from docloom.llm.common import drop_table, materialize, read

LEAST_SCORE, FOREIGN = 0.5, 4.0
WIDTH, SIMILARITY = 5, jaccard_join.Similarity(80, 100)
MIX_ALPHA, MIX_BUDGET = 0.9, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    found = materialize(langid.identify(docs, model, names=("__lang", "__score", "__bits")), "pipeline-bits")
    usual = langid.median_bits(found, "lang", "__lang", "__bits")
    limit = F.lit(None).cast("double")
    for name, bits in usual.items():
        limit = F.when(F.col("__lang") == name, FOREIGN * bits).otherwise(limit)
    fits = F.coalesce(F.col("__bits") <= limit, F.lit(True))
    kept = found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE) & fits)
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, width=WIDTH, similarity=SIMILARITY)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs.withColumn("__before", F.col("text")), secrets.default_model(docs))
    same = F.col("text").eqNullSafe(F.col("__before"))
    return clean.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    topics = docs.withColumn("__topic", mixing.topic_of(F.col("text")))
    mixed = mixing.mix(topics, ["source", "lang", "__topic"], alpha=MIX_ALPHA, budget=MIX_BUDGET)
    return mixed.where("kept").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(docs.select("doc_id", "text"), pieces.Vocabulary.load(), carry=["doc_id"])
    return encoded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_spans), ("mixture", mixture), ("tokens", tokens)]

#: Near duplicates and the language model can't be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            drop_table(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
