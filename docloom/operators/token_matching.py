"""Similarity of an answer and its reference by matching their tokens' vectors.

Every token of one side is matched with the most similar token of the other (greedy matching). Recall is the weighted
mean over the reference's tokens, precision over the answer's, and F1 their harmonic mean. A token's weight is its
inverse document frequency over the references, ln((n + 1) / (df + 1)).

Weights are counted and joined in Spark; pairs are matched in Arrow batches of a few MB. Each distinct token of a batch gets its vector
once, and distinct tokens are compared in blocks of BLOCK, so a pair of very long texts holds no whole matrix.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import word_tokens
from docloom.io import small_batches
from docloom.operators.cells import directions

BLOCK = 1024
#: Vectors that a worker remembers.
KNOWN = 50_000
TokenVectors = Callable[[list[str]], np.ndarray]


class GramVectors:
    """A deterministic local model: a token is the sum of hashed directions of its character n-grams (marked at both ends)."""

    def __init__(self, dim: int = 64, grams: tuple[int, ...] = (2, 3)) -> None:
        self.dim, self.grams = dim, grams

    def __call__(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), self.dim))
        for i, token in enumerate(tokens):
            marked = f"<{token}>"
            for n in self.grams:
                for at in range(len(marked) - n + 1):
                    h = zlib.crc32(marked[at : at + n].encode())
                    out[i, h % self.dim] += 1.0 if h & 0x80000000 else -1.0
        return out


def token_weights(references: DataFrame, tokens: Column) -> DataFrame:
    """token and weight of the tokens of references; tokens that no reference has weigh ln(n + 1)."""
    own = references.select(F.array_distinct(tokens).alias("t"))
    n = own.agg(F.count("t").alias("__n"))
    df = own.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).selectExpr("token", "ln((__n + 1) / (df + 1)) as weight")  # n is one row


def best_matches(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Of unit rows: each row's greatest product with a row of the other side, for both sides."""
    left, right = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), block):
        for j in range(0, len(b), block):
            s = a[i : i + block] @ b[j : j + block].T
            left[i : i + block] = np.maximum(left[i : i + block], s.max(axis=1))
            right[j : j + block] = np.maximum(right[j : j + block], s.max(axis=0))
    return left, right


def match_tokens(pairs: DataFrame, keys: list[str], answer: str, reference: str, vectors: TokenVectors, weights: DataFrame | None = None, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """keys, precision, recall and f1 of each pair of texts. keys tell pairs apart.

    weights: token and weight (of token_weights; unknown tokens get the greatest weight); without it all weigh 1. A side
    without tokens, or whose tokens all weigh 0, makes the pair null. f1 is 0 if precision and recall are not positive.
    """
    each = pairs.select(*keys, *[F.transform(tokens(F.col(c)), lambda t: F.struct(t.alias("token"), F.lit(side).alias("side"))).alias(c) for side, c in ((0, answer), (1, reference))])
    counted = each.select(*keys, F.explode(F.concat(F.coalesce(answer, F.array()), F.coalesce(reference, F.array()))).alias("x")).groupBy(*keys, "x").count()
    rows = counted.selectExpr(*[f"`{k}`" for k in keys], "x.token", "x.side", "count")
    if weights is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        most = weights.agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("__most"))
        rows = rows.join(weights, "token", "left").crossJoin(F.broadcast(most)).withColumn("weight", F.coalesce("weight", "__most"))  # most is one row
    sides = rows.groupBy(*keys).agg(*[F.expr(f"array_sort(collect_list(if(side = {s}, struct(token, count * weight as w), null))) as s{s}") for s in (0, 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def unit(names: list[str]) -> np.ndarray:
            new = [t for t in dict.fromkeys(names) if t not in known]
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list(dict.fromkeys(names))
            known.update(zip(new, directions(np.asarray(vectors(new), float)) if new else []))
            return np.stack([known[t] for t in names])

        for batch in batches:
            out: list[tuple] = []
            for a, b in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                (ta, wa), (tb, wb) = ((x.values.field("token"), x.values.field("w").to_numpy(zero_copy_only=False)) for x in (a, b))
                if not (wa.sum() > 0 and wb.sum() > 0):
                    out.append((None, None, None))
                    continue
                left, right = best_matches(unit(ta.to_pylist()), unit(tb.to_pylist()))
                p, r = float(left @ wa / wa.sum()), float(right @ wb / wb.sum())
                out.append((p, r, 2 * p * r / (p + r) if p > 0 and r > 0 else 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array([o[i] for o in out], pa.float64()) for i in range(3))], names=[*batch.schema.names[:-2], "precision", "recall", "f1"])

    small_batches(pairs.sparkSession)
    found = sides.mapInArrow(run, T.StructType([*[f for f in sides.schema.fields[:-2]], *T._parse_datatype_string("precision double, recall double, f1 double").fields]))
    return pairs.select(*keys).join(found, keys, "left")
