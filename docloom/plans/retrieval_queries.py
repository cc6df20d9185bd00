"""Retrieval queries. Queries are every vector, or benchmark item, whose id is divisible by 20, against all rows."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions.stemmer import STOP_WORDS
from docloom.functions.text import lexical_tokens, word_tokens
from docloom.functions.vectors import cosine
from docloom.io import shared_dir, table
from docloom.operators.block_index import block_search, build_block_index, load_block_index
from docloom.operators.dense import dense_topk
from docloom.operators.fusion import attach_chunks, hybrid_search, rrf_fuse
from docloom.operators.lexical import bm25_search, build_index, document_frequency, fresh_index
from docloom.operators.signature import FileSignatures, signed
from docloom.operators.vector_index import build_vector_index, index_topk, load_vector_index

K, DIGITS = 20, 6
TOKENS = r"[\p{L}\p{N}_][\p{L}\p{N}_-]*"
_stop = ()


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def q_dense(spark: SparkSession, d: str) -> DataFrame:
    v, asked = _vectors(spark, d)
    return dense_topk(v, asked, K, digits=DIGITS)


def _asked_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _signed(spark: SparkSession, d: str, name: str, key: str, content: str) -> tuple[str, int]:
    """Signature and number of rows of a table; only files that were not there before are read."""
    kept = hashlib.md5(f"{d} {name} {content}".encode(), usedforsecurity=False).hexdigest()
    return FileSignatures(spark, f"{shared_dir(spark)}/docloom-signatures-{kept}").sign(f"{d}/{name}.parquet", key, content)[:2]


def saved_index(spark: SparkSession, d: str, stop_words: tuple[str, ...] = _stop, stemmed: bool = False):
    """The lexical index of documents in the shared folder, made once and used as long as the documents are the same."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    name = hashlib.md5(f"{d} {stop_words} {stemmed}".encode(), usedforsecurity=False).hexdigest()
    mark = signed(spark, *_signed(spark, d, "documents", "doc_id", "sha2(text, 256)"))
    return fresh_index(docs, f"{shared_dir(spark)}/docloom-lexical-{name}", "vec_id", "text", signed=mark, stop_words=stop_words, stemmed=stemmed)


def _made_once(path: str, load, build):
    """What load finds at path, or what build writes there; a path names the content that it is made of."""
    try:
        return load(path)
    except AnalysisException:
        return build(path)


def saved_blocks(spark: SparkSession, d: str):
    """Block-max postings of documents, remade when the documents change."""
    mark, _ = _signed(spark, d, "documents", "doc_id", "sha2(text, 256)")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return _made_once(f"{shared_dir(spark)}/docloom-blocks-{mark}", lambda p: load_block_index(spark, p), lambda p: build_block_index(build_index(docs, "vec_id", "text", _stop, False), p))


def saved_vectors(spark: SparkSession, d: str):
    """The dense index of embeddings, remade when they change."""
    mark, _ = _signed(spark, d, "embeddings", "vec_id", "sha2(cast(embedding as string), 256)")
    return _made_once(f"{shared_dir(spark)}/docloom-vectors-{mark}", lambda p: load_vector_index(spark, p), lambda p: build_vector_index(table(spark, d, "embeddings"), p))


def q_indexed(spark: SparkSession, d: str) -> DataFrame:
    return index_topk(saved_vectors(spark, d), _vectors(spark, d)[1], K, digits=DIGITS)


def q_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = block_search(saved_blocks(spark, d), _asked_text(spark, d), K, stop_words=_stop, stemmed=False, digits=DIGITS)
    return found.withColumnRenamed("vec_id", "doc_id")


def q_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Search as by default: without stop words, by stems."""
    return bm25_search(saved_index(spark, d, STOP_WORDS, True), _asked_text(spark, d), K, digits=DIGITS).withColumnRenamed("vec_id", "doc_id")


def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    found = bm25_search(saved_index(spark, d), _asked_text(spark, d), K, stop_words=_stop, stemmed=False, digits=DIGITS)
    return found.withColumnRenamed("vec_id", "doc_id")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark item i asks with its text and with vector i."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _asked_text(spark, d).join(v, "query_id")


def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    asked = _queries(spark, d)
    dense = dense_topk(table(spark, d, "embeddings"), asked, K, digits=DIGITS)
    sparse = bm25_search(saved_index(spark, d), asked, K, stop_words=_stop, stemmed=False, digits=DIGITS)
    return rrf_fuse([dense, sparse], "vec_id", digits=12).where("rank < 10").select("query_id", F.col("vec_id").alias("doc_id"), F.round("rrf_score", 9).alias("rrf_score"), "rank")


def q_hybrid(spark: SparkSession, d: str) -> DataFrame:
    found = hybrid_search(table(spark, d, "embeddings"), saved_index(spark, d), _queries(spark, d), 10, "vec_id", "embedding", stemmed=False, stop_words=_stop, digits=DIGITS)
    return found.select("query_id", F.col("vec_id").alias("doc_id"), F.round("rrf_score", 6).alias("rrf_score"), F.round("score", 6).alias("score"), "rank")


def q_token_stats(spark: SparkSession, d: str) -> DataFrame:
    words, plain = word_tokens(F.col("text")), lexical_tokens(F.col("text"))
    own = table(spark, d, "documents").select("doc_id", words.alias("w"), plain.alias("p"))
    return own.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.size("p").cast("long").alias("n_lexical"))


def q_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return document_frequency(table(spark, d, "documents"), "doc_id", "text", _stop, False)


def rank_metrics(found: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (5, 10), depth: int = 10, query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """query_key, recall at the cuts, mrr, ndcg at depth and rank1 (0 or 1), per query with a relevant document.

    found: query_key, key, rank (from 0); relevant: distinct (query_key, key).
    """
    total = relevant.groupBy(query_key).agg(F.count("*").alias("__total"))
    hits = found.join(relevant, [query_key, key], "left_semi").select(query_key, (F.col("rank") + 1).alias("__r"))
    at = lambda c: F.sum(F.when(F.col("__r") <= c, 1).otherwise(0))
    gain = F.sum(F.when(F.col("__r") <= depth, 1 / F.log2(F.col("__r") + 1)).otherwise(0.0))
    own = hits.groupBy(query_key).agg(*[at(c).alias(f"__at_{c}") for c in cuts], F.min("__r").alias("__first"), gain.alias("__gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("__total", F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return total.join(own, query_key, "left").select(
        query_key, *[(zero(F.col(f"__at_{c}")) / F.col("__total")).alias(f"recall_{c}") for c in cuts], zero(1 / F.col("__first")).cast("double").alias("mrr"), (zero(F.col("__gain")) / ideal).alias("ndcg"), (zero(F.col("__first")) == 1).cast("int").alias("rank1")
    )


def q_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    v, asked = _vectors(spark, d)
    own = asked.join(v.select(F.col("vec_id").alias("query_id"), "label"), "query_id").select("query_id", "label")
    relevant = own.join(v.select("vec_id", "label"), "label").where("vec_id <> query_id").select("query_id", "vec_id")
    # A query's own vector is ranked first in its list; metrics are over the others.
    found = dense_topk(v, asked, K + 1, digits=DIGITS).where("vec_id <> query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)
    m = rank_metrics(found, relevant)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg")], "rank1")


def q_vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the one that has the next id."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


QUERIES = {"dense_topk": q_dense, "indexed_topk": q_indexed, "block_search": q_blocks, "stemmed_search": q_stemmed, "bm25_search": q_bm25, "rrf_fusion": q_rrf, "hybrid_search": q_hybrid, "token_stats": q_token_stats, "doc_freq": q_doc_freq, "rank_metrics": q_rank_metrics, "vector_cosine": q_vector_cosine}

_DENSE = """v as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n, label from embeddings),
dense_all as (select a.query_id, v.vec_id, round(coalesce(list_dot_product(a.e, v.e) / nullif(a.n * v.n, 0), 0), 6) as score from asked a, v),
dense_ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) - 1 as rank from dense_all)"""
_ASKED_VECTORS = "asked as (select vec_id as query_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings where vec_id % 20 = 0)"
_ASKED_BOTH = "asked as (select item_id as query_id, text, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from benchmark join embeddings on item_id = vec_id where item_id % 20 = 0)"
_ASKED_TEXT = "asked as (select item_id as query_id, text from benchmark where item_id % 20 = 0)"
_BM25 = f"""toks as (select doc_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) as term from documents),
postings as (select term, doc_id, count(*) as tf from toks group by all),
lens as (select doc_id, coalesce(len(regexp_extract_all(lower(text), '{TOKENS}')), 0) as dl from documents),
terms as (select term, count(*) as df from postings group by term),
stats as (select count(*) as n, avg(dl) as avgdl from lens),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) as term from asked) group by all),
sparse_all as (select query_id, doc_id, round(sum(qtf * ln(1 + (stats.n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from qt join terms using (term) join postings using (term) join lens using (doc_id), stats group by query_id, doc_id),
sparse_ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) - 1 as rank from sparse_all where score > 0)"""
_FUSED = """parts as (select query_id, vec_id as doc_id, rank from dense_ranked where rank < 20 union all select query_id, doc_id, rank from sparse_ranked where rank < 20),
fused_all as (select query_id, doc_id, sum(1.0::double / (60 + rank + 1)) as s from parts group by all),
fused as (select query_id, doc_id, s, row_number() over (partition by query_id order by round(s, {digits}) desc, doc_id) - 1 as rank from fused_all)"""

ORACLES = {
    "dense_topk": f"with {_ASKED_VECTORS}, {_DENSE} select query_id, vec_id, score, rank from dense_ranked where rank < 20",
    "bm25_search": f"with {_ASKED_TEXT}, {_BM25} select query_id, doc_id, score, rank from sparse_ranked where rank < 20",
    "rrf_fusion": f"with {_ASKED_BOTH}, {_DENSE}, {_BM25}, {_FUSED.format(digits=12)} select query_id, doc_id, round(s, 9) as rrf_score, rank from fused where rank < 10",
    "hybrid_search": f"""with {_ASKED_BOTH}, {_DENSE}, {_BM25}, {_FUSED.format(digits=6)},
kept as (select f.query_id, f.doc_id, s, f.rank, x.score from fused f join dense_all x on x.query_id = f.query_id and x.vec_id = f.doc_id where f.rank < 10)
select query_id, doc_id, round(s, 6) as rrf_score, score, row_number() over (partition by query_id order by rank) - 1 as rank from kept""",
    "token_stats": f"""select doc_id, len(regexp_extract_all(lower(text), '{TOKENS}'))::bigint as n_tokens, len(list_distinct(regexp_extract_all(lower(text), '{TOKENS}')))::bigint as n_distinct,
len(regexp_extract_all(lower(text), '[a-z0-9]+'))::bigint as n_lexical from documents""",
    "doc_freq": f"select term, count(distinct doc_id) as df from (select doc_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) as term from documents) group by term",
    "rank_metrics": f"""with {_ASKED_VECTORS}, {_DENSE},
rel as (select q.query_id, v.vec_id from asked q join v o on o.vec_id = q.query_id join v on v.label is not distinct from o.label and v.vec_id <> q.query_id and o.label is not null),
total as (select query_id, count(*) as total from rel group by 1),
r as (select query_id, vec_id, row_number() over (partition by query_id order by rank) as rank from dense_ranked where rank < 21 and vec_id <> query_id),
h as (select query_id, sum((rank <= 5)::int) as r5, sum((rank <= 10)::int) as r10, min(rank) as first, sum(case when rank <= 10 then 1 / log2(rank + 1) else 0 end) as gain from r semi join rel using (query_id, vec_id) group by 1)
select query_id, round(coalesce(r5, 0) / total, 6) as recall_5, round(coalesce(r10, 0) / total, 6) as recall_10, round(coalesce(1.0::double / first, 0), 6) as mrr,
round(coalesce(gain, 0) / (select sum(1 / log2(i + 1)) from range(1, least(total, 10) + 1) t(i)), 6) as ndcg, (coalesce(first, 0) = 1)::int as rank1 from total left join h using (query_id)""",
    "vector_cosine": """select a.vec_id, round(coalesce(list_dot_product(a.embedding::double[], b.embedding::double[]) / nullif(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 0), 0), 6) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
}
ORACLES |= {"indexed_topk": ORACLES["dense_topk"], "block_search": ORACLES["bm25_search"]}
