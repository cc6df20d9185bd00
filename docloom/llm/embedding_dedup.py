"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are rotated at random (into more dimensions, so codes are longer) and each keeps the signs of its
coordinates and one correction factor: the inner product of the vector with its code. For a code and another
rotated vector, the inner product of the two over that factor is an unbiased estimate of the cosine, with a
known error bound. A candidate pair whose estimate plus the bound is below the threshold is dropped; all
others are recomputed exactly, in double precision, from the stored vectors. No link is ever taken from an
estimate.

Candidates share all bits of some table: the sides of random hyperplanes that are drawn afresh for each table,
so tables are independent. The number of bits grows with the logarithm of the number of vectors, so chance
collisions stay in proportion to it, and the number of tables is chosen so that a pair exactly at the threshold
is missed by all of them with probability ``miss`` at most (closer pairs: far less).

Large groups. Equal vectors are one class. A table entry of more than GROUP classes pairs each only with the
group's first. A class within half of the linking angle of such a leader joins its ball (the least leader's);
two members of a ball are linked by the triangle inequality, so a ball counts its links without listing
them. Only pairs of such groups that lie in different balls are then listed.

Scale: keys and class ids are packed by bucket before the shuffle; vectors are joined to candidate pairs.
Intermediate tables are in the shared folder; every task makes the rotation and the hyperplanes anew
(dimension x bits, the latter for each table).

Defined results: a vector that is null, zero, or has null or non-finite components links with nothing; so do
vectors of different lengths. Very large and very small vectors are scaled by a power of two, so their norms are finite and not zero. Rows with equal keys count as different vectors of one id. A null key takes
part like others and is never the least; if alone its component is null and kept is null. Extra
columns are ignored: the result has the key and the result columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import drop_table, materialize, read
from docloom.llm.components import connected_components
from docloom.llm.textblocks import M1, U, mix

BITS, GROUP, EPSILON, MISS = 256, 32, 6.0, 1e-4
SEED = 20240


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """bits x dim with orthonormal columns."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def code_bits(dim: int) -> int:
    return max(BITS, -(-dim // 64) * 64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (bool) and correction factors of the vectors' directions."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ turn.T
    return turned > 0, np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[0])


def estimate(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased cosine estimates of pairs, row by row, from one side's code and the other's rotated direction, and their error bounds."""
    bits = signs.shape[1]
    got = ((2.0 * signs - 1) * turned).sum(axis=1) / math.sqrt(bits)
    return got / factor, epsilon * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (bits - 1))


def tables_for(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(6, round(math.log2(max(n, 2)) + 3))
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def _vectors(column: pa.Array, dtype: str) -> list[bytes | None]:
    """The raw bytes of each usable vector, else None."""
    out: list[bytes | None] = [None] * len(column)
    for i, v in enumerate(column):
        if v.is_valid:
            values = v.values
            if len(values) and not values.null_count:
                x = values.to_numpy(zero_copy_only=False).astype(dtype)
                most = float(np.abs(x.astype(float)).max())
                if np.isfinite(most) and most > 0:  # a power of two that keeps norms within range and changes no cosine
                    out[i] = np.ldexp(x, -math.frexp(most)[1]).astype(dtype).tobytes() if not 1e-15 < most < 1e15 else x.tobytes()
    return out


def _tables(batches: Iterator[pa.RecordBatch], bits: int, tables: int, buckets: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Table entries of the classes (cid, x), packed by bucket."""
    planes: dict[int, np.ndarray] = {}
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        cids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_dim: dict[int, list[int]] = {}
        for i, x in enumerate(raw):
            by_dim.setdefault(len(x), []).append(i)
        keys, of = [], []
        for size, members in by_dim.items():
            x = np.stack([np.frombuffer(raw[i], dtype) for i in members]).astype(float)
            dim = x.shape[1]
            if dim not in planes:
                planes[dim] = np.random.default_rng([SEED, dim, bits]).standard_normal((tables, dim, bits))
            for t in range(tables):
                word = (x @ planes[dim][t] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                keys.append(mix(word.astype(np.uint64) ^ mix(np.array([t * 1_000_003 + dim], np.uint64) + M1)))
                of.append(np.array(members))
        if not keys:
            continue
        key, node = np.concatenate(keys), np.concatenate(of)
        bucket = ((key >> U(32)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, node, bucket = (key[order] & U(0xFFFFFFFF)).astype(np.uint32), node[order], bucket[order]
        ids = np.frombuffer(b"".join(cids), "V16")
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        blobs = [pack.compress(key[a:b].tobytes() + ids[node[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _pairs_of(table: pa.Table, group: int) -> pa.Table:
    """Of one bucket: all pairs of small entries, pairs with the first of large ones, and the rows of large ones (key)."""
    unpack = zstandard.ZstdDecompressor()
    bucket = table.column("bucket")[0].as_py()
    keys, ids = [], []
    for blob in table.column("blob").to_pylist():
        raw = unpack.decompress(blob)
        n = len(raw) // 20
        keys.append(np.frombuffer(raw, np.uint32, n))
        ids.append(np.frombuffer(raw, np.uint8, 16 * n, 4 * n).reshape(n, 16))
    key, cid = np.concatenate(keys), np.concatenate(ids)
    halves = cid.view(">u8")
    order = np.lexsort((halves[:, 1], halves[:, 0], key))
    key, cid = key[order], cid[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    first, count = np.repeat(start, size), np.repeat(size, size)
    place = np.arange(len(key)) - first
    left, right = [], []
    for back in range(1, group):
        at = np.flatnonzero((place >= back) & (count <= group))
        left.append(at - back)
        right.append(at)
    large = np.flatnonzero((place >= 1) & (count > group))
    a, b = np.concatenate([*left, first[large]]), np.concatenate([*right, large])
    rows = np.flatnonzero(count > group)
    text = cid.tobytes()
    at = lambda i: text[16 * i : 16 * i + 16]
    pairs = sorted({(at(x), at(y)) for x, y in zip(a.tolist(), b.tolist())})
    none = [None] * len(rows)
    return pa.table({"a": pa.array([p[0] for p in pairs] + [at(i) for i in rows.tolist()], pa.binary()), "b": pa.array([p[1] for p in pairs] + none, pa.binary()), "key": pa.array([None] * len(pairs) + ((bucket << 32) | key[rows].astype(np.int64)).tolist(), pa.int64())})


def _decided(pairs: DataFrame, classes: DataFrame, threshold: float, dtype: str) -> DataFrame:
    """a, b and the exact cosine of the pairs whose estimate leaves them open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            raw_a, raw_b, keep, cosines = batch.column(2).to_pylist(), batch.column(3).to_pylist(), [], []
            signs_of, factors = batch.column(4).to_pylist(), batch.column(5).to_numpy()
            by_size: dict[int, list[int]] = {}
            for i, (x, y) in enumerate(zip(raw_a, raw_b)):
                if len(x) == len(y):
                    by_size.setdefault(len(x), []).append(i)
            for rows in by_size.values():
                rows = np.array(rows)
                y = np.stack([np.frombuffer(raw_b[i], dtype) for i in rows]).astype(float)
                dim = y.shape[1]
                turn = turns.setdefault(dim, rotation(dim, code_bits(dim)))
                signs = np.unpackbits(np.frombuffer(b"".join(signs_of[i] for i in rows), np.uint8).reshape(len(rows), -1), axis=1, count=turn.shape[0])
                guess, error = estimate(signs, factors[rows], (y / np.linalg.norm(y, axis=1, keepdims=True)) @ turn.T)
                rows, y = rows[guess + error >= threshold], y[guess + error >= threshold]
                if len(rows):
                    x = np.stack([np.frombuffer(raw_a[i], dtype) for i in rows]).astype(float)
                    cosines.append((x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)))
                    keep.append(rows)
            at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(cosines) if cosines else np.zeros(0))], names=["a", "b", "cosine"])

    left = classes.select(F.col("cid").alias("a"), F.col("x").alias("xa"), "signs", "factor")
    right = classes.select(F.col("cid").alias("b"), F.col("x").alias("xb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "xa", "xb", "signs", "factor").mapInArrow(run, "a binary, b binary, cosine double")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, miss: float = MISS, group: int = GROUP) -> DataFrame:
    """key, n_links, component_id and kept of every row of vectors."""
    spark = vectors.sparkSession
    dtype = "<f4" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    kind = vectors.schema[key].dataType

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = _vectors(batch.column(1), dtype)
            signs: list[bytes | None] = [None] * len(raw)
            factor = np.zeros(len(raw))
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(raw):
                if x:
                    by_size.setdefault(len(x), []).append(i)
            for rows in by_size.values():
                x = np.stack([np.frombuffer(raw[i], dtype) for i in rows]).astype(float)
                turn = turns.setdefault(x.shape[1], rotation(x.shape[1], code_bits(x.shape[1])))
                s, f = encode(x, turn)
                for i, word, c in zip(rows, np.packbits(s, axis=1), f):
                    signs[i], factor[i] = word.tobytes(), c
            cids = [hashlib.md5(x, usedforsecurity=False).digest() if x else None for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cids, pa.binary()), pa.array(raw, pa.binary()), pa.array(signs, pa.binary()), pa.array(factor)], names=["key", "cid", "x", "signs", "factor"])

    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("cid binary, x binary, signs binary, factor double").fields])
    coded = materialize(vectors.select(key, vector).mapInArrow(classify, schema), "coded")
    classes = materialize(coded.where("cid is not null").groupBy("cid").agg(F.min("key").alias("rep"), F.count("*").alias("size"), F.first("x").alias("x"), F.first("signs").alias("signs"), F.first("factor").alias("factor")), "classes")
    n = classes.count()
    bits, tables = tables_for(n, threshold, miss)
    buckets = max(64, 4 * coded.rdd.getNumPartitions(), n * tables >> 18)
    packed = classes.select("cid", "x").mapInArrow(lambda it: _tables(it, bits, tables, buckets, dtype), "bucket long, blob binary")
    met = materialize(packed.groupBy("bucket").applyInArrow(lambda t: _pairs_of(t, group), "a binary, b binary, key long"), "met")
    exact = materialize(_decided(met.where("key is null").select("a", "b").distinct(), classes, threshold, dtype), "pairs")
    linked = exact.where(F.col("cosine") >= threshold).select("a", "b", "cosine")

    # Balls: the least leader of a large entry within half of the angle (a little less, for rounding).
    rows = met.where("key is not null").select("key", F.col("a").alias("cid"))
    half = math.cos(math.acos(threshold) / 2) + 1e-6
    leaders = rows.groupBy("key").agg(F.min("cid").alias("a")).select("a").distinct()
    ball = linked.where(F.col("cosine") >= half).join(leaders, "a", "left_semi").groupBy("b").agg(F.min("a").alias("ball")).withColumnRenamed("b", "cid")
    balls = materialize(classes.select("cid", "size").join(ball, "cid", "left").select("cid", "size", F.coalesce("ball", "cid").alias("ball")), "balls")
    # Pairs of large entries across balls that were not decided yet.
    placed = rows.join(balls, "cid").select("key", "cid", "ball")
    mixed = placed.groupBy("key").agg(F.min("ball").alias("lo"), F.max("ball").alias("hi")).where("lo < hi").select("key")
    open_rows = placed.join(mixed, "key", "left_semi")
    x, y = (open_rows.select("key", F.col("cid").alias(c), F.col("ball").alias(f"ball_{c}")) for c in "ab")
    across = x.join(y, "key").where("a < b and ball_a <> ball_b").select("a", "b").distinct().join(exact.select("a", "b"), ["a", "b"], "left_anti")
    more = _decided(across, classes, threshold, dtype).where(F.col("cosine") >= threshold).select("a", "b")
    to = lambda side: balls.select(F.col("cid").alias(side), F.col("ball").alias(f"ball_{side}"), F.col("size").alias(f"size_{side}"))
    links = materialize(linked.select("a", "b").unionByName(more).join(to("a"), "a").join(to("b"), "b").where("ball_a <> ball_b"), "links")

    for done in (met, exact):
        drop_table(done)

    # Links: the ball's other vectors, and those of linked classes in other balls.
    inside = balls.groupBy("ball").agg(F.sum("size").alias("inside"))
    outside = links.select(F.col("a").alias("cid"), F.col("size_b").alias("s")).unionByName(links.select(F.col("b").alias("cid"), F.col("size_a").alias("s"))).groupBy("cid").agg(F.sum("s").alias("outside"))
    edges = links.select("ball_a", "ball_b").distinct()
    component = connected_components(edges, "ball_a", "ball_b")
    whole = balls.join(inside, "ball").join(outside, "cid", "left").join(component, F.col("ball") == F.col("node"), "left").select("cid", (F.col("inside") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", "ball").alias("comp"))
    named = whole.join(classes.select("cid", "rep"), "cid")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = named.join(least, "comp").select("cid", "n_links", "component_id")
    result = coded.select("key", "cid").join(final, "cid", "left")
    own = F.when(F.col("cid").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return result.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("key") == own).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
