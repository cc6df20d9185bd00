"""BM25 over block-max postings: blocks of documents that can't reach the k-th score are not read.

Documents are dealt into blocks of about DOCS by a hash of their key. A row of the postings holds what a term has in a
block: the documents, their frequencies and lengths, and the greatest share of a full weight that one of them
gets (`top`). A search reads `top` of its terms only (other columns stay on disk), sums it up to a bound for every block,
and scores the documents of the best blocks. The k-th score then tells which other blocks can still hold a better or equal
document; the rest is never read.

A document is in one block, so its score is complete when the block is scored. A frequent term spreads over
its blocks, so no key is hot. Postings are partitioned by a hash of the term into parts whose number follows
the number of postings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import Settings
from docloom.functions.stemmer import STOP_WORDS
from docloom.io import drop_written, small_batches, written
from docloom.operators.lexical import LexicalIndex, index_tokens, keys_repeat, parts_for

DOCS, FIRST = 128, 8


@dataclass(frozen=True)
class BlockIndex:
    """postings (part, term, block, n, top, rows: array of key, tf, dl) and the numbers that a search needs."""

    postings: DataFrame
    documents: int
    average: float
    parts: int
    blocks: int
    key: str
    settings: Settings


def packed(rows: DataFrame) -> DataFrame:
    """term, block, n, top, rows, part of postings sorted by part, term and block: runs of a term in a block become one row."""

    def pack(batch: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        offsets = np.append(starts, len(batch)).astype(np.int32)
        first = batch.take(pa.array(starts))
        at = {c: first.column(c).combine_chunks() for c in ("term", "block", "part")}
        lists = pa.ListArray.from_arrays(pa.array(offsets), batch.column("row").combine_chunks())
        top = np.maximum.reduceat(batch.column("share").to_numpy(), starts)
        return pa.RecordBatch.from_arrays([at["term"], at["block"], pa.array(np.diff(offsets)), pa.array(top), lists, at["part"]], names=["term", "block", "n", "top", "rows", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the run that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            same = lambda c: pc.equal(table.column(c)[1:], table.column(c)[:-1])
            begins = ~pc.and_(same("term"), same("block")).to_numpy().astype(bool)
            starts = np.append(0, np.flatnonzero(begins) + 1)
            last = int(starts[-1])
            if last:
                yield pack(table.slice(0, last).combine_chunks(), starts[:-1])
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield pack(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64))

    small_batches(rows.sparkSession, 20_000)
    kept = {f.name: f.dataType for f in rows.schema.fields}
    kinds = [("term", kept["term"]), ("block", kept["block"]), ("n", T.IntegerType()), ("top", kept["share"]), ("rows", T.ArrayType(kept["row"])), ("part", kept["part"])]
    return rows.mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def build_block_index(index: LexicalIndex, path: str, settings: Settings = Settings(), docs: int = DOCS) -> BlockIndex:
    """Write the block-max postings of an index under path, the one-row description last.

    An index that is not saved gives its documents' counts as they are, so each posting is shuffled once, to its part. Where
    keys repeat, and of saved or stemmed indexes, postings are joined with the lengths first.
    """
    if docs < 1:
        raise ValueError("docs must be positive")
    spark = index.postings.sparkSession
    lengths = written(index.lengths, "lengths")
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    blocks, average = max(1, -(-stats.n // docs)), stats.avgdl or 0.0
    parts = parts_for(stats.tokens)
    k1, b = settings.bm25_k1, settings.bm25_b
    single = index.counts is not None and not keys_repeat(lengths, index.key)
    counts = index.counts if single else index.postings.drop("part", "dl").join(lengths, index.key)
    rows = counts.selectExpr(
        "term", f"cast(pmod(xxhash64(`{index.key}`), {blocks}) as int) as block", f"struct(`{index.key}` as key, cast(tf as int) as tf, cast(dl as int) as dl) as row", f"tf / (tf + {k1}D * (1 - {b}D + {b}D * dl / {average or 1.0}D)) as share", f"cast(pmod(xxhash64(term), {parts}) as int) as part"
    )
    own = packed(rows.repartitionById(parts, "part").sortWithinPartitions("part", "term", "block", "row"))
    own.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    drop_written(lengths)
    about = spark.createDataFrame([(stats.n, float(average), parts, blocks, index.key, k1, b, own.schema.json())], "documents bigint, average double, parts int, blocks int, key string, k1 double, b double, schema string")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return load_block_index(spark, path)


def load_block_index(spark: SparkSession, path: str) -> BlockIndex:
    r = spark.read.parquet(f"{path}/about").first()
    return BlockIndex(spark.read.schema(T.StructType.fromJson(json.loads(r.schema))).parquet(f"{path}/postings"), r.documents, r.average, r.parts, r.blocks, r.key, Settings(bm25_k1=r.k1, bm25_b=r.b))


def block_search(index: BlockIndex, queries: DataFrame, k: int, query_key: str = "query_id", query_text: str = "query_text", stop_words: tuple[str, ...] = STOP_WORDS, stemmed: bool = True, digits: int | None = None, first: int = FIRST, visits: bool = False) -> DataFrame:
    """query_key, key, score, rank (from 0), as bm25_search; with visits also blocks_read and blocks (that hold a term).

    first: blocks that are read before the k-th score is known. k and first below 1 are an error.
    """
    if k < 1 or first < 1:
        raise ValueError("k and first must be positive")
    k1, b = index.settings.bm25_k1, index.settings.bm25_b
    tokens = queries.select(F.col(query_key).alias("q"), F.explode(index_tokens(F.col(query_text), stop_words, stemmed)).alias("term"))
    asked = tokens.groupBy("q", "term").agg(F.count("*").alias("qtf")).withColumn("part", F.expr(f"cast(pmod(xxhash64(term), {index.parts}) as int)"))
    hits = written(asked.join(index.postings.select("part", "term", "block", "n", "top"), ["part", "term"]), "hits")
    weight = f"first(qtf) * ln(1 + ({index.documents} - sum(n) + 0.5D) / (sum(n) + 0.5D)) as weight"
    weights = hits.groupBy("q", "part", "term").agg(F.expr(weight))
    place = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    # A little more than the sum, as sums of other orders differ in their last digits.
    bounds = hits.join(weights, ["q", "part", "term"]).groupBy("q", "block").agg(F.expr("sum(weight * top) * (1 + 1e-9D) as bound"))
    bounds = written(bounds.withColumn("place", F.row_number().over(place)), "bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        each = pairs.select("q", "block").join(weights, "q").join(index.postings.select("part", "term", "block", "rows"), ["part", "term", "block"])
        part = f"weight * row.tf / (row.tf + {k1}D * (1 - {b}D + {b}D * row.dl / {index.average or 1.0}D))"
        score = F.expr("sum(s)") if digits is None else F.expr(f"round(sum(s), {digits})")
        return each.select("q", "weight", F.explode("rows").alias("row")).selectExpr("q", "row.key as key", f"{part} as s").groupBy("q", "key").agg(score.alias("score")).where("score > 0")

    order = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    best = lambda df: df.withColumn("rank", F.row_number().over(order) - 1).where(f"rank < {k}")
    early = written(best(scored(bounds.where(f"place <= {first}"))).drop("rank"), "scored")
    kth = early.groupBy("q").agg(F.expr(f"if(count(*) >= {k}, min(score) - 1e-{digits or 12}D, -1D) as kth"))
    open_blocks = bounds.where(f"place > {first}").join(kth, "q", "left").where("bound >= coalesce(kth, -1D)")
    found = best(early.unionByName(scored(open_blocks)))
    columns = [F.col("q").alias(query_key), F.col("key").alias(index.key), "score", "rank"]
    if visits:
        read = bounds.join(kth, "q", "left").groupBy("q").agg(F.expr(f"count_if(place <= {first} or bound >= coalesce(kth, -1D)) as blocks_read"), F.count("*").alias("blocks"))
        return found.join(read, "q").select(*columns, "blocks_read", "blocks")
    return found.select(*columns)
