"""Inverted lists of vectors: cells by distributed k-means, rows of a cell packed in blocks, visits by joins.

Centres are fitted on a bounded sample of the rows (a hash of the key draws it), every row is then put into the
nearest centre's cell. A range shuffle by cell, distance and key brings the rows of a cell together in as many
tasks as its size asks for, so a cell that holds a third of all rows is not one task. Each task packs its rows into
blocks of at most BLOCK rows, which lie in one shell around the centre (from near to far). Cells and blocks have
these distances, so a search can tell which ones can't hold a row that it looks for.

A visit is a join of packs of queries with the blocks of their cells; rows of that join are pairs of a block and
a pack, which are multiplied as matrices. Only the number of cells (MOST_CELLS) bounds what reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.io import settings, written

BLOCK, PACK, SAMPLE, MOST_CELLS, ROUNDS = 1024, 256, 65_536, 1024, 6
#: For rounding: added to every angle or distance, relative to what it is compared with.
SLACK = 1e-6
#: A row of a visit holds a block and a pack, so batches are small in rows.
_VISIT = {"spark__sql__execution__arrow__maxRecordsPerBatch": "16"}


def matrix(column: pa.ListArray, dtype=np.float64) -> np.ndarray:
    """The lists of a column as rows; unequal lengths are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors have unequal lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(sizes), -1)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, as a table of rows x cells is made of each."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def directions(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@dataclass(frozen=True)
class Cells:
    """Centres, and of each cell the least and the greatest distance of a row, and the number of rows."""

    centres: np.ndarray
    near: np.ndarray
    far: np.ndarray
    size: np.ndarray
    sphere: bool


def cell_count(rows: int) -> int:
    return max(1, min(MOST_CELLS, math.isqrt(rows)))


def nearest(x: np.ndarray, centres: np.ndarray, sphere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the cell and the distance from its centre: an angle on the sphere, else a length.

    On the sphere rows without a direction are in a cell of their own after the others, at distance 0.
    """
    if sphere:
        u = directions(x)
        score = u @ centres.T
        cell = score.argmax(axis=1)
        away = np.arccos(np.clip(score[np.arange(len(x)), cell], -1, 1))
        none = ~u.any(axis=1)
        cell[none], away[none] = len(centres), 0.0
        return cell, away
    cell = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
    return cell, np.linalg.norm(x - centres[cell], axis=1)


def fit_centres(rows: DataFrame, key: str, vector: str, cells: int, sphere: bool, total: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """k-means over a sample of about `sample` rows (all, if there are fewer); the sums of a round come from every task."""
    spark = rows.sparkSession
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / max(total, 1)))
    own = written(rows.where(drawn | F.lit(total <= sample)).select(F.xxhash64(F.col(key).cast("string"), F.lit(1)).alias("h"), F.col(vector).alias("v")), "sample")
    first = own.groupBy("v").agg(F.min("h").alias("h")).orderBy("h").limit(cells).select("v").toArrow()
    centres = matrix(first.column(0)) if first.num_rows else np.zeros((1, 1))
    if sphere:
        centres = directions(centres)
        centres = centres[centres.any(axis=1)] if centres.any() else centres[:1]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, count = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for batch in slices(batches):
                x = matrix(batch.column(0))
                if len(x):
                    cell, _ = nearest(x, c, sphere)
                    x, cell = (directions(x)[cell < len(c)], cell[cell < len(c)]) if sphere else (x, cell)
                    np.add.at(total, cell, x)
                    count += np.bincount(cell, minlength=len(c))
            yield pa.RecordBatch.from_pylist([{"cell": i, "n": int(count[i]), "s": total[i].tolist()} for i in np.flatnonzero(count)], pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

        parts = own.select("v").mapInArrow(sums, "cell int, n bigint, s array<double>").toArrow()
        total_, count = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        if parts.num_rows:
            at = parts.column("cell").to_numpy()
            np.add.at(total_, at, matrix(parts.column("s")))
            np.add.at(count, at, parts.column("n").to_numpy())
        shared.unpersist()
        after = np.where(count[:, None] > 0, total_ / np.maximum(count, 1)[:, None], centres)
        centres, before = directions(after) if sphere else after, centres
        if np.allclose(centres, before, atol=1e-6):
            break
    return centres


def build_blocks(rows: DataFrame, vector: str, carry: list[str], centres: np.ndarray, sphere: bool, size: int = BLOCK) -> DataFrame:
    """Blocks (cell, n, near, far, one array per carried column, v: the vectors in one array) of all rows.

    carry begins with the key, which orders rows at equal distances.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    own = rows.select(*carry, F.col(vector).alias("v"))
    placed = T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = matrix(batch.column(batch.num_columns - 1))
            cell, away = nearest(x, shared.value, sphere) if len(x) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    fields = own.schema.fields
    packed = T.StructType([T.StructField(n, t) for n, t in (("cell", T.IntegerType()), ("n", T.IntegerType()), ("near", T.DoubleType()), ("far", T.DoubleType()))] + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields[:-1]] + [T.StructField("v", fields[-1].dataType)])

    def blocks(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        cell = table.column("cell").to_numpy()
        edges = np.flatnonzero(np.diff(cell)) + 1
        cuts = sorted({c for a, b in zip([0, *edges], [*edges, len(cell)]) for c in range(a, b, size)} | {len(cell)})
        if not last:
            cuts = cuts[:-1]  # the last block may go on
        if len(cuts) < 2:
            return None, table
        start, stop = np.array(cuts[:-1]), np.array(cuts[1:])
        whole = table.slice(0, cuts[-1])
        offsets = pa.array([*start, cuts[-1]], pa.int32())
        away = whole.column("away").to_numpy()
        vectors = whole.column("v").combine_chunks()
        width = len(vectors.flatten()) // max(len(vectors), 1)
        lists = [pa.ListArray.from_arrays(offsets, whole.column(f.name).combine_chunks()) for f in fields[:-1]]
        flat = pa.ListArray.from_arrays(pa.array(np.array([*start, cuts[-1]]) * width, pa.int32()), vectors.flatten())
        numbers = [pa.array(cell[start], pa.int32()), pa.array(stop - start, pa.int32()), pa.array(np.minimum.reduceat(away, start)), pa.array(np.maximum.reduceat(away, start))]
        return pa.RecordBatch.from_arrays([*numbers, *lists, flat], names=[f.name for f in packed.fields]), table.slice(cuts[-1])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            made, rest = blocks(rest, False)
            if made is not None:
                yield made
        if rest is not None and len(rest):
            yield blocks(rest, True)[0]

    sorted_rows = own.mapInArrow(assign, placed).repartitionByRange("cell", "away", carry[0]).sortWithinPartitions("cell", "away", carry[0])
    return sorted_rows.mapInArrow(pack, packed)


def summary(blocks: DataFrame, centres: np.ndarray, sphere: bool) -> Cells:
    """Of each cell the distances of its rows; at most one row a cell reaches the driver."""
    n = len(centres) + sphere
    near, far, size = np.zeros(n), np.full(n, -1.0), np.zeros(n, np.int64)
    for r in blocks.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum("n").alias("n")).collect():
        near[r.cell], far[r.cell], size[r.cell] = r.near, r.far, r.n
    return Cells(centres, near, far, size, sphere)


def cosine_bounds(units: np.ndarray, cells: Cells) -> np.ndarray:
    """Rows x cells: no row of a cell is more similar to a direction than this (-inf for an empty cell).

    The angle to a row is at least the difference of the angle to the centre and the row's to the centre.
    """
    to = np.arccos(np.clip(units @ cells.centres.T, -1, 1))
    n = len(cells.centres)
    apart = np.maximum(0, np.maximum(to - cells.far[:n], cells.near[:n] - to) - SLACK)
    bound = np.concatenate([np.cos(np.minimum(apart, np.pi)), np.zeros((len(units), 1))], axis=1) + 1e-9
    bound[~units.any(axis=1)] = 1e-9
    bound[:, cells.size == 0] = -np.inf
    return bound


def product_bounds(x: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Rows x cells: the inner products with a cell's rows lie between these, by Cauchy and Schwarz (empty: inf, -inf)."""
    middle = x @ cells.centres.T
    reach = np.linalg.norm(x, axis=1)[:, None]
    slack = SLACK * (1 + reach * (np.linalg.norm(cells.centres, axis=1) + cells.far)[None, :] * 1e-3)
    low, high = middle - reach * cells.far[None, :] - slack, middle + reach * cells.far[None, :] + slack
    low[:, cells.size == 0], high[:, cells.size == 0] = np.inf, -np.inf
    return low, high


def visit(packs: DataFrame, blocks: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, name: str) -> DataFrame:
    """run over the rows of packs joined with the blocks of their cells (packs' columns, then blocks'), as a written table.

    A pack is much smaller than a block, so Catalyst broadcasts packs while they are few and else deals both by cell,
    splitting cells that hold much.
    """
    joined = packs.join(blocks.withColumnRenamed("n", "rows"), "cell")
    with settings(packs.sparkSession, **_VISIT):
        return written(joined.mapInArrow(run, schema), name)
