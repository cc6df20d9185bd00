"""BM25: postings and statistics as tables, scored with joins on terms.

The query side (terms) is broadcast by Catalyst while it is small; postings are aggregated before any shuffle and
scores are summed per (query, document), so a frequent term spreads over its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import Settings
from docloom.functions.stemmer import STOP_WORDS, stem, stems
from docloom.functions.text import word_tokens
from docloom.io import small_batches, written

FORMAT_VERSION = 5
#: Postings of a part of a saved index, and the least and the largest number of parts.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 1 << 22, 8, 1 << 14


def parts_for(postings: int) -> int:
    """The number of parts follows the number of postings."""
    return max(LEAST_PARTS, min(MOST_PARTS, -(-postings // PART_ROWS)))


def index_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> Column:
    """The index's tokens of a text: words, without stop words, stemmed."""
    words = word_tokens(text)
    kept = F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words
    return stems(kept) if stemmed else kept


@dataclass(frozen=True)
class LexicalIndex:
    """postings (term, key, tf; dl too if they are saved and no key repeats), lengths (key, dl), terms (term, df) and stats (one row: n, avgdl)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str
    parts: int | None = None  # of saved postings
    counts: DataFrame | None = None  # postings with dl, not merged for repeated keys; of an index that is not saved


def term_counts(own: DataFrame, key: str, stemmed: bool = False) -> DataFrame:
    """key, term, tf, dl of rows (key, __tokens): tokens are counted within their row by Arrow batches, so nothing is shuffled.

    stemmed: terms are the tokens' stems; a batch's distinct tokens are stemmed once, and a worker remembers stems.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            words = batch.column(1).flatten().dictionary_encode()
            terms, numbers = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
            if stemmed:
                found = pa.array([stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
                terms, numbers = found.dictionary, found.indices.to_numpy(zero_copy_only=False)[numbers]
            each = max(1, len(terms))
            at = np.repeat(np.arange(len(sizes)), sizes) * each + numbers
            pairs, tf = np.unique(at, return_counts=True)
            row, word = pairs // each, pairs % each
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.take(pa.array(word)), pa.array(tf), pa.array(sizes[row].astype(np.int32))], names=[key, "term", "tf", "dl"])

    small_batches(own.sparkSession, 20_000)
    fields = [own.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())]
    return own.select(key, "__tokens").mapInArrow(run, T.StructType(fields))


def keys_repeat(rows: DataFrame, key: str) -> bool:
    """Whether two rows have the same key (null is one)."""
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def document_frequency(docs: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = (), stemmed: bool = False) -> DataFrame:
    """term, df: the number of documents (with a key) that hold a term, in one pass and one shuffle of terms."""
    each = docs.select(key, F.explode(F.array_distinct(index_tokens(F.col(text), stop_words, stemmed))).alias("term"))
    counted = F.countDistinct(key) if keys_repeat(docs, key) else F.count(key)
    return each.groupBy("term").agg(counted.alias("df"))


def build_index(docs: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> LexicalIndex:
    """Documents without tokens count with length 0."""
    own = docs.select(key, F.coalesce(index_tokens(F.col(text), stop_words, False), F.array().cast("array<string>")).alias("__tokens"))
    counts = term_counts(own, key, stemmed)
    postings = counts.groupBy("term", key).agg(F.sum("tf").alias("tf"))
    lengths = own.select(key, F.size("__tokens").alias("dl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return LexicalIndex(postings, lengths, terms, stats, key, counts=counts)


def bm25_search(index: LexicalIndex, queries: DataFrame, k: int, query_key: str = "query_id", query_text: str = "query_text", stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = True, settings: Settings = Settings(), digits: int | None = None) -> DataFrame:
    """query_key, key, score, rank (from 0): the k best documents with a score above 0; ties by key.

    Repeated query tokens add again; unknown tokens are ignored. k <= 0 is an error.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    key = index.key
    asked = queries.select(query_key, F.explode(index_tokens(F.col(query_text), stop_words, stemmed)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    # Written, so that Catalyst knows its size: while the asked terms are small, postings are not shuffled for them.
    # Only their postings are needed; the semi-join goes below the postings' aggregation.
    if index.parts:  # saved postings: partitions without an asked term are pruned (Spark prunes by a table that is filtered)
        weighted = written(asked.join(index.terms, "term"), "weights").where("df > 0")
        terms = weighted.select("term", _part(F.col("term"), index.parts).alias("part")).distinct()
        hits = index.postings.join(terms, ["part", "term"], "left_semi").drop("part")
    else:
        asked = written(asked, "asked")
        hits = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
        weighted = written(asked.join(hits.groupBy("term").agg(F.count("*").alias("df")), "term"), "weights")
    k1, b = settings.bm25_k1, settings.bm25_b
    rows = hits.join(weighted, "term")
    rows = rows.where(F.col(key).isNotNull()) if "dl" in hits.columns else rows.join(index.lengths, key)
    rows = rows.crossJoin(F.broadcast(index.stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = rows.groupBy(query_key, key).agg(F.sum(part).alias("score")).where("score > 0")
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def signature(chunks: DataFrame, key: str, content_hash: str) -> DataFrame:
    """One row: a hash over the JSON of the ordered (id, hash) pairs, and their number.

    Pairs are dealt into 4,096 parts by their ids, each part's JSON is hashed in a task of its own, and the parts'
    hashes are hashed in order, so no task holds all pairs.
    """
    pair = F.struct(F.col(key).cast("string").alias("id"), F.col(content_hash).alias("hash"))
    part = F.substring(F.md5(F.col(key).cast("string")), 1, 3)
    parts = chunks.groupBy(part.alias("__part")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(pair)), {"ignoreNullFields": "false"}), 256).alias("__h"), F.count("*").alias("__n"))
    rows = F.array_sort(F.collect_list(F.struct("__part", "__h")))
    return parts.agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["__h"]), "\n"), 256).alias("signature"), F.coalesce(F.sum("__n"), F.lit(0)).alias("count"))


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _postings_schema(lengths: DataFrame, key: str, has_dl: bool) -> str:
    return f"term string, `{key}` {lengths.schema[key].dataType.simpleString()}, tf bigint, {'dl int, ' * has_dl}part int"


def save_index(index: LexicalIndex, path: str, signed: DataFrame) -> None:
    """Tables under path, the one-row metadata last, so a torn write is seen as missing.

    Postings are partitioned by a hash of the term and sorted by it, so a search reads few of them; a part is a task, and
    the number of parts follows the number of tokens. Tokens are counted within their documents and go to their parts in
    one shuffle; only where keys repeat are they merged there. If none does, a posting has its document's length, so a search does not look it up. Texts are cut into tokens once for the postings and once for the lengths.
    """
    spark = index.postings.sparkSession
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    parts = parts_for(lengths.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0])
    single = index.counts is not None and not keys_repeat(lengths, index.key)
    rows = (index.counts if single else index.postings).select("term", index.key, "tf", *["dl"] * single, _part(F.col("term"), parts).alias("part"))
    rows.repartitionById(parts, "part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    postings = spark.read.schema(_postings_schema(lengths, index.key, single)).parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    has_index = F.lit(True)
    signed.select("signature", "count", F.lit(FORMAT_VERSION).alias("format_version"), has_index.alias("has_index"), F.lit(index.key).alias("key"), F.lit(parts).alias("parts"), F.lit(single).alias("has_dl")).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


class IndexMissing(FileNotFoundError):
    """There is no index at this path."""


class IndexCorrupt(ValueError):
    """What is at this path is no index of this format."""


def load_index(spark, path: str) -> tuple[LexicalIndex, str, int]:
    """The index with its signature and count; typed errors tell a missing index from a damaged one."""
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.parquet(f"{path}/metadata")
    except AnalysisException as e:
        raise IndexMissing(path) from e
    if set(meta.columns) != {"signature", "count", "format_version", "has_index", "key", "parts", "has_dl"}:
        raise IndexCorrupt(f"metadata has columns {meta.columns}")
    rows = meta.limit(2).collect()
    if len(rows) != 1 or rows[0].format_version != FORMAT_VERSION:
        raise IndexCorrupt("metadata is not one row of the present format")
    try:
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("lengths", "terms", "stats")}
        tables["postings"] = spark.read.schema(_postings_schema(tables["lengths"], rows[0].key, rows[0].has_dl)).parquet(f"{path}/postings")
    except AnalysisException as e:
        raise IndexCorrupt(str(e)[:200]) from e
    index = LexicalIndex(**tables, key=rows[0].key, parts=rows[0].parts)
    if index.lengths.count() != rows[0]["count"]:
        raise IndexCorrupt("the number of documents differs from the metadata")
    return index, rows[0].signature, rows[0]["count"]


def fresh_index(chunks: DataFrame, path: str, key: str, text: str, content_hash: str | None = None, signed: DataFrame | None = None, **options) -> LexicalIndex:
    """The saved index if its signature is that of chunks; otherwise a new one, which is saved.

    signed: signature and count of chunks (one row), if they are known; without it all of chunks are signed anew.
    """
    signed = signature(chunks, key, content_hash) if signed is None else signed
    now = signed.first()
    try:
        index, mark, n = load_index(chunks.sparkSession, path)
        if (mark, n) == (now.signature, now["count"]):
            return index
    except (IndexMissing, IndexCorrupt):
        pass
    save_index(build_index(chunks, key, text, **options), path, signed)
    return load_index(chunks.sparkSession, path)[0]
