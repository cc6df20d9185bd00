"""Whitening of embeddings: covariance by generated column aggregates, components by LAPACK.

Every entry c of a usable vector becomes the integer x = floor(SCALE * c) + SHIFT, so counts and sums are exact. Of
each dimension a column holds x less the integer part of its mean; from it the fraction of the mean is taken, so a
centred column has full precision however large the shift is. One aggregation then sums the products of every pair of
centred columns of the upper triangle (expressions are generated; over PAIRS of them are summed in several passes, as a
generated class has a limit). The driver gets that triangle, dimension x dimension numbers, and decomposes it with
LAPACK. Rows are projected as matrices; the covariance of the result is summed in the same way, so identity_error is
measured and not derived.

Scale: no shuffle but of partial sums; a few scans of one column. Only sums reach the driver.

Defined results. Usable are vectors without null and non-finite entries, of the length that most such vectors have
(ties: the longest; not empty), whose entries become integers below 2^62; all others give no row. A component whose
eigenvalue is not above the rounding error (dimension x 2^-48 x the largest) can't be scaled to one and is not
returned, so equal vectors, one vector and an empty table give no row. A null key, repeated keys and repeated rows are
vectors like others. deviation is null where it needs more than 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.io import settings
from docloom.llm.common import read

SCALE, SHIFT, COMPONENTS, PAIRS = 64, 1_000_000, 32, 4096
_LIMIT = float(1 << 62)
#: Thousands of sums in small methods need a caller that is too long for the JVM to compile; longer methods halve the time.
_CODE = {"spark__sql__codegen__methodSplitThreshold": "12000"}


@dataclass(frozen=True)
class Whitening:
    """Of the fit list: number of vectors, exact sums, components (rows), their variances, and the whole variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float


def usable(vectors: DataFrame, key: str, vector: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """key and the integers x0, x1, ... of the usable vectors, and their width (0 if there are none)."""
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < _LIMIT - shift)
    whole = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fits))
    most = whole.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = most.width if most else 0
    return whole.where(F.size("v") == width).selectExpr("key", *[f"try_add(floor(cast(v[{i}] as double) * {scale}), {shift}L) as x{i}" for i in range(width)]), width


def _sums(rows: DataFrame, terms: list[str], at_once: int) -> list:
    """The sums of SQL expressions over all rows, at most at_once in an aggregation."""
    own, found = iter(terms), []
    with settings(rows.sparkSession, **_CODE):
        while part := list(islice(own, at_once)):
            found += rows.selectExpr(*[f"sum({t}) as s{i}" for i, t in enumerate(part)]).first()
    return found


def _triangle(names: list[str]) -> list[str]:
    return [f"{a} * {b}" for i, a in enumerate(names) for b in names[i:]]


def _matrix(upper: list[float], width: int) -> np.ndarray:
    whole = np.zeros((width, width))
    whole[np.triu_indices(width)] = upper
    return whole + np.triu(whole, 1).T


def centred(rows: DataFrame, n: int, sums: tuple[int, ...]) -> DataFrame:
    """The centred columns c0, c1, ...: x less the integer part of its mean, then less the fraction."""
    whole = rows.selectExpr(*[f"x{i} - ({s // n}L) as y{i}" for i, s in enumerate(sums)])
    return whole.selectExpr(*[f"cast(y{i} as double) - {(s % n) / n!r}D as c{i}" for i, s in enumerate(sums)])


def fit(rows: DataFrame, width: int, components: int = COMPONENTS, at_once: int = PAIRS) -> Whitening | None:
    """Sums, covariance (divisor n, centred before multiplying) and its first components over all rows of usable()."""
    n, *sums = rows.selectExpr("count(*)", *[f"sum(cast(x{i} as decimal(19,0)))" for i in range(width)]).first()
    if not n:
        return None
    sums = tuple(map(int, sums))
    covariance = _matrix(_sums(centred(rows, n, sums), _triangle([f"c{i}" for i in range(width)]), at_once), width) / n
    values, turned = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > width * 2.0**-48 * max(values.max(), 0)]
    return Whitening(n, sums, turned.T[order], values[order], float(np.trace(covariance)))


def _squares(off: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Of each row the sum of (n * off - rest)^2, exact; None where it needs more than 64 bits."""
    most = float(np.abs(off.astype(float)).max(initial=0)) + 1
    if (n * most) ** 2 * off.shape[1] < 2.0**62:
        return ((n * off - rest) ** 2).sum(axis=1).tolist()
    found = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest)) for row in off]
    return [v if v < 1 << 63 else None for v in found]


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """key, deviation and whitened (array<double>, not rounded) of rows."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % model.n for s in model.sums], np.int64)
    weights = (model.components / np.sqrt(model.variances)[:, None]).T
    n = model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = np.column_stack([c.to_numpy() for c in batch.columns[1:]]).reshape(batch.num_rows, -1) - whole
            found = (off - rest / n) @ weights
            ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_squares(off, n, rest), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=["key", "deviation", "whitened"])

    return rows.mapInArrow(run, T.StructType([rows.schema["key"], *T._parse_datatype_string("deviation bigint, whitened array<double>").fields]))


def identity_error(whitened: DataFrame, n: int, components: int, at_once: int = PAIRS) -> float:
    """The largest absolute entry of the covariance of the whitened columns minus the identity; they are centred as they are."""
    own = whitened.selectExpr(*[f"whitened[{k}] as w{k}" for k in range(components)])
    covariance = _matrix(_sums(own, _triangle([f"w{k}" for k in range(components)]), at_once), components) / n
    return float(np.abs(covariance - np.eye(components)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, at_once: int = PAIRS) -> DataFrame:
    """key, n, deviation, whitened (array of the components' values), explained (array) and identity_error of each usable vector."""
    rows, width = usable(vectors, key, vector, scale, shift)
    model = fit(rows, width, components, at_once) if width else None
    if model is None or not len(model.variances):
        model, error = Whitening(1, (0,) * width, np.zeros((0, width)), np.zeros(0), 1.0), 0.0
        found = rows.limit(0).selectExpr("key", "0L as deviation", "cast(array() as array<double>) as whitened")
    else:
        found = project(rows, model)
        error = identity_error(found, model.n, len(model.variances), at_once)
    share = F.array(*[F.lit(float(e / model.total)) for e in model.variances]).cast("array<double>")
    return found.select(F.col("key").alias(key), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(read(spark, sf_dir, "embeddings"))
    each = F.inline(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), "whitened", "explained"))
    return rows.where(F.size("whitened") > 0).select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
