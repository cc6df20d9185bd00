"""Exact dense top-k.

A query set is compared with all vectors in blocks: a block of queries is a matrix of bounded size that is
broadcast, each task multiplies its vectors with it and keeps its own k best per query, and only those meet
in a window. No pair is ever a row but a task's best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of a block (a block of 64-wide vectors is 2 MB), and scores that a task holds at a time (8 MB, in some five copies).
QUERY_BLOCK, SCORES = 4096, 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False)
    return np.array([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((0, 0))


def _directions(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_vector", digits: int | None = None) -> DataFrame:
    """query_key, key, score, rank (from 0) of the k most similar vectors of each query.

    Score: cosine, 0 for a zero vector. Order: score falling, then key. digits rounds scores before they are
    ordered. Null vectors are skipped; vectors of another width than the queries' are an error; k <= 0 is an
    error; without vectors the result is empty.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    kinds = {key: vectors.schema[key].dataType, query_key: queries.schema[query_key].dataType}
    rows = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    wanted = queries.where(F.col(query_vector).isNotNull()).select(query_key, query_vector).orderBy(query_key).toArrow()
    parts = []
    for at in range(0, max(wanted.num_rows, 1), QUERY_BLOCK):
        block = wanted.slice(at, QUERY_BLOCK)
        shared = spark.sparkContext.broadcast((block.column(0).to_pylist(), _directions(_matrix(block.column(1).combine_chunks())) if block.num_rows else np.zeros((0, 0))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            found: dict[int, list[tuple[float, object]]] = {}
            rows = max(1, SCORES // max(1, len(names)))
            for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
                if not len(names):
                    continue
                scores = _directions(_matrix(batch.column(1))) @ asked.T
                if digits is not None:
                    scores = np.round(scores, digits)
                ids = batch.column(0).to_pylist()
                take = np.argpartition(-scores, min(k, len(ids)) - 1, axis=0)[:k]
                edge = np.take_along_axis(scores, take, 0).min(axis=0)
                for q in range(len(names)):
                    mine = [(-scores[i, q], ids[i]) for i in np.flatnonzero(scores[:, q] >= edge[q])]  # ties stay
                    found[q] = sorted(found.get(q, []) + mine)[:k]
            for q, mine in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(mine), kinds_arrow[0]), pa.array([i for _, i in mine], kinds_arrow[1]), pa.array([-s + 0.0 for s, _ in mine], pa.float64())], names=[query_key, key, "score"])

        kinds_arrow = (block.schema.field(0).type, pa.int64() if isinstance(kinds[key], T.LongType) else pa.int32() if isinstance(kinds[key], T.IntegerType) else pa.string())
        parts.append(rows.mapInArrow(run, T.StructType([T.StructField(query_key, kinds[query_key]), T.StructField(key, kinds[key]), T.StructField("score", T.DoubleType())])))
    near = parts[0]
    for part in parts[1:]:
        near = near.unionByName(part)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return near.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
