"""Reciprocal-rank fusion, hybrid search, reranking and the retrieval entry point."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions.vectors import cosine
from docloom.io import written
from docloom.operators.dense import dense_topk
from docloom.operators.lexical import LexicalIndex, bm25_search


def rrf_fuse(rankings: list[DataFrame], key: str, query_key: str = "query_id", k: int = 60, digits: int | None = None) -> DataFrame:
    """query_key, key, rrf_score and fused rank (from 0): sums of 1 / (k + rank counted from 1).

    Scores of the rankings are ignored. A key that a ranking holds twice is an error, and so is k <= 0.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    parts = [r.select(query_key, key, F.lit(i).alias("__from"), F.col("rank").cast("double").alias("__rank")) for i, r in enumerate(rankings)]
    each = reduce(DataFrame.unionByName, parts).groupBy(query_key, key, "__from").agg(F.min("__rank").alias("__rank"), F.count("*").alias("__n"))
    part = F.when(F.col("__n") > 1, F.raise_error(F.lit("a ranking holds a key twice")).cast("double")).otherwise(1 / (k + F.col("__rank") + 1))
    fused = each.groupBy(query_key, key).agg(F.sum(part).alias("rrf_score"))
    if digits is not None:
        fused = fused.withColumn("rrf_score", F.round("rrf_score", digits))
    order = Window.partitionBy(query_key).orderBy(F.desc("rrf_score"), key)
    return fused.withColumn("rank", F.row_number().over(order) - 1)


def attach_chunks(fused: DataFrame, dense: DataFrame, chunks: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """fused with score (the dense one, else the stored vector's cosine); keys found in neither are dropped, ranks are dense again."""
    scored = dense.select(query_key, key, F.col("score").alias("__dense"))
    stored = chunks.select(key, F.col(vector).alias("__vector")).where("__vector is not null")
    rows = fused.join(scored, [query_key, key], "left").join(stored, key, "left").join(queries.select(query_key, F.col(query_vector).alias("__query")), query_key, "left")
    rows = rows.where("__dense is not null or (__vector is not null and __query is not null)")
    score = F.coalesce("__dense", cosine(F.col("__query"), F.col("__vector")))
    order = Window.partitionBy(query_key).orderBy("rank")
    return rows.select(query_key, key, "rrf_score", score.alias("score"), "rank").withColumn("rank", F.row_number().over(order) - 1)


def hybrid_search(chunks: DataFrame, index: LexicalIndex, queries: DataFrame, limit: int, key: str, vector: str, settings: Settings = Settings(), stemmed: bool = True, stop_words=None, digits: int | None = None) -> DataFrame:
    """Dense and lexical rankings fused and cut to limit. queries: query_id, query_vector, query_text."""
    options = {} if stop_words is None else {"stop_words": stop_words}
    dense = dense_topk(chunks, queries, settings.top_k_dense, key, vector, digits=digits)
    sparse = bm25_search(index, queries, settings.top_k_bm25, stemmed=stemmed, settings=settings, digits=digits, **options)
    fused = rrf_fuse([dense, sparse], key, k=settings.rrf_k, digits=digits).where(F.col("rank") < limit)
    return attach_chunks(fused, dense, chunks, queries, key, vector)


def rerank(found: DataFrame, queries: DataFrame, chunks: DataFrame, scorer: Callable, limit: int, key: str, text: str = "text", query_key: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """found ordered anew by scorer(query text, chunk text), a column function; other scores stay, rank is new (from 0)."""
    rows = found.join(chunks.select(key, F.col(text).alias("__text")), key).join(queries.select(query_key, F.col(query_text).alias("__asked")), query_key)
    scored = rows.withColumn("rerank_score", scorer(F.col("__asked"), F.col("__text"))).drop("__text", "__asked")
    order = Window.partitionBy(query_key).orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < limit)


def retrieve(chunks: DataFrame, queries: DataFrame, limit: int, key: str, vector: str, text: str = "text", mode: str | None = None, index: LexicalIndex | None = None, reranker: Callable | None = None, settings: Settings = Settings(), texts: DataFrame | None = None, **options) -> DataFrame:
    """The limit best chunks of each query; with a reranker, out of a larger pool. Unknown modes, and hybrid without an index, are errors.

    texts: the chunks' key and text, if chunks has no text. The pool is written, so that Catalyst knows its size: while it
    is small, no text is shuffled for it.
    """
    mode = mode or settings.retrieval_mode
    if limit <= 0:
        raise ValueError("limit must be positive")
    pool = max(settings.rerank_candidates, limit) if reranker else limit
    if mode == "dense":
        found = dense_topk(chunks, queries, pool, key, vector)
    elif mode == "hybrid":
        if index is None:
            raise ValueError("hybrid retrieval needs a lexical index")
        found = hybrid_search(chunks, index, queries, pool, key, vector, settings, **options)
    else:
        raise ValueError(f"unknown retrieval mode {mode!r}")
    return rerank(written(found, "pool"), queries, chunks if texts is None else texts, reranker, limit, key, text) if reranker else found
