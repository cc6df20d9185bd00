"""A dense index: inverted lists by angle, searched exactly by bounds, or up to a number of cells.

A search runs in two waves. In the first each query visits the few cells that could hold the most similar vectors; its
k-th score so far then tells which other cells can still hold a better or equal one, and only those are visited in the
second. With `probes` there is only a first wave, of so many cells: faster, and some neighbours can be missed.

Queries stay distributed: they are put into packs by cell in tasks of their own, and every task keeps the k best rows
of a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.io import written
from docloom.operators.cells import PACK, Cells, build_blocks, cell_count, cosine_bounds, directions, fit_centres, matrix, slices, summary, visit

FIRST = 4
#: Candidates that a task holds before it keeps the k best of each query.
HELD = 1 << 18
#: Packs of a record batch.
TOGETHER = 16


@dataclass(frozen=True)
class VectorIndex:
    blocks: DataFrame
    cells: Cells
    key: str


def build_vector_index(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Write the index of vectors (null ones are skipped; unequal lengths are an error) under path, the cells last."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    total = rows.count()
    centres = fit_centres(rows, key, vector, cells or cell_count(total), True, total)
    build_blocks(rows, vector, [key], centres, True).write.mode("overwrite").parquet(f"{path}/blocks")
    found = summary(spark.read.parquet(f"{path}/blocks"), centres, True)
    table = [(i, centres[i].tolist() if i < len(centres) else None, float(found.near[i]), float(found.far[i]), int(found.size[i])) for i in range(len(found.size))]
    spark.createDataFrame(table, "cell int, centre array<double>, near double, far double, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return load_vector_index(spark, path, key)


def load_vector_index(spark: SparkSession, path: str, key: str = "vec_id") -> VectorIndex:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS + 1 at most
    centres = np.array([r.centre for r in rows[:-1]], float)
    near, far, size = (np.array([r[c] for r in rows]) for c in ("near", "far", "n"))
    return VectorIndex(spark.read.parquet(f"{path}/blocks"), Cells(centres, near, far, size, True), key)


def _asked(queries: DataFrame, query_key: str, query_vector: str, cells: Cells, first: int) -> DataFrame:
    """q (a number), the query's key and vector, and the cells of its first wave, best bound first; a written table."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)  # MOST_CELLS centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = matrix(batch.column(2)) if batch.num_rows else np.zeros((0, 1))
            if len(x) and x.shape[1] != shared.value.centres.shape[1]:
                raise ValueError("vectors have unequal lengths")
            bound = cosine_bounds(directions(x), shared.value) if len(x) else np.zeros((0, 1))
            order = np.argsort(-bound, axis=1, kind="stable")[:, : min(first, int((shared.value.size > 0).sum()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    own = queries.where(F.col(query_vector).isNotNull()).select(F.monotonically_increasing_id().alias("q"), F.col(query_key).alias("query"), F.transform(query_vector, lambda v: v.cast("double")).alias("v"))
    return written(own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])), "asked")


def _packs(asked: DataFrame, cells: Cells, later: bool) -> DataFrame:
    """cell, qs, kth and vs of packs of at most PACK queries that visit the cell: in the first wave, or later (by kth)."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int32()), ("qs", pa.list_(pa.int64())), ("kth", pa.list_(pa.float64())), ("vs", pa.list_(pa.float64()))])
        for batch in (b.slice(at, PACK) for b in batches for at in range(0, b.num_rows, PACK)):
            q, kth, x = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            go = np.zeros((len(q), len(shared.value.size)), bool)
            before = [(i, c) for i, own in enumerate(batch.column(2).to_pylist()) for c in own]
            for i, c in before:
                go[i, c] = True
            if later:
                go = ~go & (cosine_bounds(directions(x), shared.value) >= kth[:, None]) & (shared.value.size > 0)
            rows = [(int(c), np.flatnonzero(go[:, c])) for c in np.flatnonzero(go.any(axis=0))]
            for at in range(0, len(rows), TOGETHER):  # all cells at once would be as many copies of the pack
                yield pa.RecordBatch.from_pylist([{"cell": c, "qs": q[i], "kth": kth[i], "vs": x[i].ravel()} for c, i in rows[at : at + TOGETHER]], schema)

    own = asked.select("q", "v", "cells", "kth" if "kth" in asked.columns else F.lit(float("-inf")).alias("kth"))
    return written(own.mapInArrow(run, "cell int, qs array<bigint>, kth array<double>, vs array<double>"), "packs")


def _best(q: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: score falling, then key."""
    order = np.lexsort((key, -score, q))
    start = np.flatnonzero(np.diff(q[order], prepend=-1))
    rank = np.arange(len(q)) - np.repeat(start, np.diff([*start, len(q)]))
    return order[rank < k]


def _search(k: int, digits: int | None, kind: pa.DataType):
    """The kernel of a visit: of each query the k best rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, s, names = (np.concatenate(c) for c in zip(*held))
            keep = _best(q, s, names, k)
            return q[keep], s[keep], names[keep]

        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                q, kth, vs, keys, v = (batch.column(names.index(c))[i].values for c in ("qs", "kth", "vs", "keys", "v"))
                q, kth = q.to_numpy(), kth.to_numpy()
                asked = directions(vs.to_numpy().reshape(len(q), -1))
                score = asked @ directions(v.to_numpy().astype(float).reshape(len(keys), -1)).T
                if digits is not None:
                    score = np.round(score, digits)
                least = kth if len(keys) <= k else np.maximum(kth, np.partition(score, len(keys) - k, axis=1)[:, len(keys) - k])
                at, row = np.nonzero(score >= least[:, None])
                held.append((q[at], score[at, row], keys.to_numpy(zero_copy_only=False)[row]))
                n += len(at)
                if n > HELD:
                    held[:] = [best()]
                    n = 0
        if held:
            q, s, found = best()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found, kind), pa.array(s + 0.0)], names=["q", "key", "score"])

    return run


def index_topk(index: VectorIndex, queries: DataFrame, k: int, query_key: str = "query_id", query_vector: str = "query_vector", digits: int | None = None, first: int = FIRST, probes: int | None = None, visits: bool = False) -> DataFrame:
    """query_key, key, score, rank (from 0), as dense_topk; with visits also the numbers of visited and of all cells.

    probes: visit only so many cells (the result may then lack neighbours). k, first and probes below 1 are an error.
    """
    if min(k, first, 1 if probes is None else probes) < 1:
        raise ValueError("k, first and probes must be positive")
    spark, key = queries.sparkSession, index.key
    kind = index.blocks.schema[key].dataType.elementType
    blocks = index.blocks.withColumnRenamed(key, "keys")
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(kind, pa.string())
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("key", kind), T.StructField("score", T.DoubleType())])
    asked = _asked(queries, query_key, query_vector, index.cells, probes or first)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    waves = [_packs(asked, index.cells, False)]
    found = visit(waves[0], blocks, _search(k, digits, arrow), schema, "found")
    if probes is None:
        kth = ranked(found).groupBy("q").agg(F.min("score").alias("s"), F.count("*").alias("n")).select("q", F.when(F.col("n") >= k, F.col("s") - 10.0 ** -(digits or 12)).otherwise(float("-inf")).alias("kth"))
        waves.append(_packs(asked.join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))), index.cells, True))
        found = found.unionByName(visit(waves[1], blocks, _search(k, digits, arrow), schema, "found"))
    out = ranked(found).join(asked.select("q", "query"), "q")
    columns = [F.col("query").alias(query_key), F.col("key").alias(key), "score", "rank"]
    if visits:
        all_packs = waves[0] if len(waves) == 1 else waves[0].unionByName(waves[1])
        seen = all_packs.select("cell", F.explode("qs").alias("q")).groupBy("q").agg(F.countDistinct("cell").alias("cells_visited"))
        return out.join(seen, "q").select(*columns, "cells_visited", F.lit(int((index.cells.size > 0).sum())).alias("cells"))
    return out.select(*columns)
