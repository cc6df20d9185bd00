"""Hard-negative mining over k-means inverted lists, exact by bounds.

Rows are in cells with a stored centre and radius (docloom.operators.cells), packed in blocks. By Cauchy and Schwarz the
inner products of an anchor with all rows of a cell lie within |anchor| x radius of its product with the centre. So
an anchor's positives (its most similar rows of the same label) are searched in the cells of the highest upper bound;
a cell is left out when its bound falls strictly below the k-th score so far. Each positive opens a window of
scores; a cell whose bounds lie outside of it is skipped, the others are visited until their bound falls strictly
below the k-th score of the window. Each search has two waves: the first few cells give the k-th scores, which
decide on all others. Scores are integers, so ties and limits are exact.

Scale: one range shuffle of the vectors, which splits hot cells; visits are joins of packs of anchors with blocks,
and each task keeps the k best of a search at most. Cells (cells.MOST_CELLS at most) are what is broadcast. Where
vectors have no groups the bounds exclude little, and anchors x rows products are computed, as matrices.

Keys and labels are whole numbers. Defined results. Rows take part if key, label and vector are not null, the vector has no null and no non-finite entry,
has the length that most such vectors have (ties: the longest; not empty), and the sum of its squared integers is below
2^61, so that every score is a 64-bit number. Rows of equal keys are rows of their own, also if wholly equal; an anchor
is never its own positive. Equal scores: smaller key first, then in an order of no meaning. Anchors without a
positive, and positives without a negative, give no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import drop_table, materialize, read
from docloom.operators.cells import PACK, Cells, build_blocks, cell_count, fit_centres, matrix, product_bounds, summary, visit

SCALE, POSITIVES, NEGATIVES, LOW, HIGH, FIRST = 256, 5, 3, 50, 95, 4
#: Candidates that a task holds before it keeps the best of each search.
HELD = 1 << 20
_NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame, key: Column, label: Column, vector: Column, anchor: Column, scale: int) -> DataFrame:
    """key, label, anchor and x (array<bigint>, floor(scale * entry)) of the rows that take part."""
    own = vectors.select(key.cast("bigint").alias("key"), label.cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("v"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, v: s + (v.cast("double") * scale) * (v.cast("double") * scale))
    own = own.where(F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite)).where(squares < float(1 << 61))
    most = own.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return own.where(F.size("v") == (most.width if most else 0)).select("key", "label", "anchor", F.transform("v", lambda v: F.floor(v.cast("double") * scale).cast("bigint")).alias("x"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exact: in floating point where every partial sum is below 2^53."""
    reach = np.linalg.norm(a.astype(float), axis=1).max(initial=0) * np.linalg.norm(b.astype(float), axis=1).max(initial=0)
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if reach < 2**52 else a @ b.T


def _anchors(blocks: DataFrame) -> DataFrame:
    """q (the row's number), key, label and x of the anchors, those of a cell side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, anchor, rid, key, label, v in zip(*(batch.column(c) for c in ("n", "anchor", "rid", "key", "label", "v"))):
                at = np.flatnonzero(anchor.values.to_numpy(zero_copy_only=False))
                if len(at):
                    x = v.values.to_numpy().reshape(n.as_py(), -1)[at]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*(c.values.take(pa.array(at)) for c in (rid, key, label)), lists], names=["q", "anchor_id", "label", "x"])

    return blocks.select("n", "anchor", "rid", "key", "label", "v").mapInArrow(run, "q bigint, anchor_id bigint, label bigint, x array<bigint>")


def _packs(asked: DataFrame, cells: Cells, first: int | None) -> DataFrame:
    """cell and, in lists, q, label, x, and for each window lo, hi and kth of the anchors that visit it.

    asked: q, label, x, lo, hi, kth (arrays, one entry a window), seen (the cells visited before). With first only that
    many cells of the highest bound are visited, else all that are not ruled out or seen. Writes a table.
    """
    shared = asked.sparkSession.sparkContext.broadcast(cells)  # MOST_CELLS centres
    schema = pa.schema([("cell", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("q", "label", "x", "windows", "lo", "hi", "kth"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PACK) for b in batches for at in range(0, b.num_rows, PACK)):
            q, label, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), np.int64)
            windows = pc.list_value_length(batch.column(3)).to_numpy()
            lo, hi, kth = (c.flatten().to_numpy() for c in batch.columns[3:6])
            low, high = product_bounds(x.astype(float), shared.value)
            of = np.repeat(np.arange(len(q)), windows)
            may = (high[of] >= np.maximum(lo, kth)[:, None]) & (low[of] <= hi[:, None])
            go = np.zeros(high.shape, bool)
            np.logical_or.at(go, of, may)
            for i, seen in enumerate(batch.column(6).to_pylist()):
                go[i, seen] = False
            if first is not None:
                order = np.argsort(-np.where(go, high, -np.inf), axis=1, kind="stable")[:, :first]
                best = np.zeros_like(go)
                np.put_along_axis(best, order, True, axis=1)
                go &= best
            rows = []
            for c in np.flatnonzero(go.any(axis=0)):
                i = np.flatnonzero(go[:, c])
                w = np.flatnonzero(go[of, c])
                rows.append({"cell": int(c), "q": q[i], "label": label[i], "x": x[i].ravel(), "windows": windows[i], "lo": lo[w], "hi": hi[w], "kth": kth[w]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    own = asked.select("q", "label", "x", "lo", "hi", "kth", "seen")
    return materialize(own.mapInArrow(run, "cell int, " + ", ".join(f"{c} array<bigint>" for c in schema.names[1:])), "packs")


def _kernel(k: int, same: bool):
    """Of each search (q, window) the k best rows of a task, of the same or of other labels, within lo and hi."""

    def best(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        q, slot, score, key, rid = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((rid, key, -score, slot, q))
        new = np.flatnonzero((np.diff(q[order], prepend=_NONE) != 0) | (np.diff(slot[order], prepend=-1) != 0))
        place = np.arange(len(q)) - np.repeat(new, np.diff([*new, len(q)]))
        return [c[order[place < k]] for c in (q, slot, score, key, rid)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.names.index(c))[row].values.to_numpy()  # noqa: E731, B023
                q, label, windows, lo, hi, kth = (get(c) for c in ("q", "label", "windows", "lo", "hi", "kth"))
                keys, labels, rids = (get(c) for c in ("keys", "labels", "rids"))
                score = products(get("x").reshape(len(q), -1), get("v").reshape(len(keys), -1))
                fits = (label[:, None] == labels) & (q[:, None] != rids) if same else label[:, None] != labels
                start = np.cumsum(windows) - windows
                for slot in range(windows.max()):
                    own = np.flatnonzero(windows > slot)
                    w = start[own] + slot
                    s = score[own]
                    ok = fits[own] & (s >= np.maximum(lo[w], kth[w])[:, None]) & (s <= hi[w][:, None])
                    if len(keys) > k and ok.sum() > 4 * k * len(own):
                        s = np.where(ok, s, _NONE)
                        ok &= s >= np.partition(s, len(keys) - k, axis=1)[:, len(keys) - k : len(keys) - k + 1]
                    at, place = np.nonzero(ok)
                    held.append([q[own[at]], np.full(len(at), slot), s[at, place], keys[place], rids[place]])
                    n += len(at)
                if n > HELD:
                    held = [best(held)]
                    n = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best(held)], names=["q", "slot", "score", "key", "rid"])

    return run


_FOUND = "q bigint, slot bigint, score bigint, key bigint, rid bigint"


def _searched(asked: DataFrame, blocks: DataFrame, cells: Cells, k: int, same: bool, first: int) -> DataFrame:
    """q, slot, score, key, rid and place (from 1) of the k best rows of each window; asked: q, label, x, lo, hi."""
    lists = blocks.select("cell", "n", F.col("key").alias("keys"), F.col("label").alias("labels"), F.col("rid").alias("rids"), "v")
    order = Window.partitionBy("q", "slot").orderBy(F.desc("score"), "key", "rid")
    ranked = lambda df: df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    none = F.transform("lo", lambda _: F.lit(_NONE + 1))
    packs = _packs(asked.withColumn("kth", none).withColumn("seen", F.array().cast("array<int>")), cells, first)
    found = ranked(visit(packs, lists, _kernel(k, same), _FOUND, "found"))
    kth = found.groupBy("q", "slot").agg(F.when(F.count("*") >= k, F.min("score")).alias("s")).where("s is not null").groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("slot", "s"))).alias("by"))
    seen = packs.select("cell", F.explode("q").alias("q")).groupBy("q").agg(F.collect_list("cell").alias("seen"))
    at = F.transform("lo", lambda _, i: F.coalesce(F.try_element_at("by", i.cast("bigint")), F.lit(_NONE + 1)))
    later = asked.join(kth, "q", "left").join(seen, "q", "left").withColumn("kth", at).withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))
    more = _packs(later, cells, None)
    last = visit(more, lists, _kernel(k, same), _FOUND, "found")
    for done in (packs, more):
        drop_table(done)
    return ranked(found.drop("place").unionByName(last))


def mine(vectors: DataFrame, key: Column, label: Column, vector: Column, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, first: int = FIRST, cells: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score is between low and high hundredths of the positive's. first: cells of the first wave.
    """
    rows = usable(vectors, key, label, vector, anchor, scale)
    total = rows.count()
    centres = fit_centres(rows, "key", "x", cells or cell_count(total), False, total)
    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    blocks = materialize(build_blocks(numbered, "x", ["key", "rid", "label", "anchor"], centres, False), "lists")
    known = summary(blocks, centres, False)
    asked = materialize(_anchors(blocks), "anchors")

    ends = [F.array(F.lit(v)).alias(c) for c, v in (("lo", _NONE + 1), ("hi", np.iinfo(np.int64).max))]
    near = materialize(_searched(asked.select("q", "label", "x", *ends), blocks, known, positives, True, first), "positives")
    # From low to high hundredths, rounded inwards; a negative score has no such window.
    lo, hi = F.expr(f"score div 100 * {low} + (score % 100 * {low} + 99) div 100"), F.expr(f"score div 100 * {high} + (score % 100 * {high}) div 100")
    windows = near.where("score >= 0").select("q", "place", lo.alias("lo"), hi.alias("hi")).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))).alias("w"))
    tasks = asked.select("q", "label", "x").join(windows, "q").select("q", "label", "x", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    far = _searched(tasks, blocks, known, negatives, False, first)
    pairs = near.where("score >= 0").select("q", (F.col("place") - 1).cast("bigint").alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    found = far.select("q", "slot", F.col("place").alias("rank"), F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(found, ["q", "slot"]).join(asked.select("q", "anchor_id"), "q").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id"), label, F.col("embedding"), F.col("vec_id") % 50 == 0)
