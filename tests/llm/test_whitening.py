"""Whitening against numpy over exact integers, and the defined cases."""

import math

import numpy as np
import pytest

from docloom.llm import whitening
from docloom.llm.queries import QUERIES


def plain(vectors, components=32):
    """Integers x, their covariance and the sums of squares, over all rows at once."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    centred = off / n
    covariance = centred.T @ centred / n
    values, turned = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    return n, [sum(int(v) ** 2 for v in row) for row in off], centred, covariance, values[order], turned[:, order]


def compare(rows, ids, vectors, components=32):
    n, deviation, centred, covariance, values, turned = plain(vectors, components)
    want = centred @ turned / np.sqrt(values)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * len(values)
    for k in range(len(values)):
        mine = np.array([got[i, k + 1].whitened for i in ids])
        sign = np.sign(mine @ want[:, k])
        assert np.allclose(mine * sign, want[:, k], atol=1e-7)
        assert {got[i, k + 1].explained for i in ids} == {got[ids[0], k + 1].explained}
        assert got[ids[0], k + 1].explained == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)
    assert {r.n for r in rows} == {n}
    assert [got[i, 1].deviation for i in ids] == deviation
    (error,) = {r.identity_error for r in rows}
    whole = np.array([[got[i, k + 1].whitened for k in range(len(values))] for i in ids])
    centre = whole - whole.mean(axis=0)
    assert error <= 1e-9 and error == pytest.approx(np.abs(centre.T @ centre / n - np.eye(len(values))).max(), abs=1e-9)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    kept = [r for r in rows if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding)]
    compare(QUERIES["op12_whitening"](spark, sf).collect(), [r.vec_id for r in kept], [r.embedding for r in kept])


def vectors_of(spark, rows, schema="vec_id long, embedding array<double>, n string, key string"):
    return spark.createDataFrame(rows, schema)


def flat(df):
    return [r for r in df.selectExpr("vec_id", "n", "deviation", "identity_error", "posexplode(whitened) as (at, whitened)", "explained as all").selectExpr("vec_id", "at + 1 as component", "n", "deviation", "whitened", "all[at] as explained", "identity_error").collect()]


def test_nulls_widths_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).tolist(), "x", "y") for i in range(60)]
    bad = [(100, None, "x", "y"), (101, [1.0, None, 2.0, 3.0, 4.0], "x", "y"), (102, [float("nan")] * 5, "x", "y"), (103, [float("inf")] * 5, "x", "y"), (104, [1.0], "x", "y"), (105, [], "x", "y"), (106, [1e300] * 5, "x", "y")]
    rows = flat(whitening.whiten(vectors_of(spark, good + bad), components=3))
    compare(rows, list(range(60)), [r[1] for r in good], components=3)
    twice = flat(whitening.whiten(vectors_of(spark, good + bad + good), components=3))
    assert len(twice) == 2 * len(rows) and {r.n for r in twice} == {120}
    assert flat(whitening.whiten(vectors_of(spark, [(None, r[1], "", "") for r in good]), components=2))[0].vec_id is None


def test_several_passes_give_the_same(spark):
    rng = np.random.default_rng(4)
    df = vectors_of(spark, [(i, rng.normal(size=6).tolist(), "", "") for i in range(50)]).repartition(3).cache()
    one, many = (sorted(flat(whitening.whiten(df, components=4, at_once=n)), key=lambda r: (r.vec_id, r.component)) for n in (4096, 2))
    assert np.allclose([abs(r.whitened) for r in one], [abs(r.whitened) for r in many], atol=1e-9)


def test_large_entries_are_exact_or_null(spark):
    rows = [(i, [1e12 * i, float(i % 3)], "", "") for i in range(40)] + [(99, [5e15, 1.0], "", "")]
    got = {r.vec_id: r.deviation for r in flat(whitening.whiten(vectors_of(spark, rows), components=1))}
    x = [[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {r[0]: sum((41 * v - s) ** 2 for v, s in zip(own, sums)) for r, own in zip(rows, x)}
    assert got == {k: v if v < 1 << 63 else None for k, v in want.items()}


def test_nothing_to_scale(spark):
    for rows in ([], [(1, [1.0, 2.0], "", "")], [(i, [0.5, 0.5], "", "") for i in range(9)], [(1, None, "", "")]):
        assert whitening.whiten(vectors_of(spark, rows)).collect() == []
    rank_one = [(i, [float(i), 2.0 * i, 7.0], "", "") for i in range(30)]
    assert {r.component for r in flat(whitening.whiten(vectors_of(spark, rank_one)))} == {1}
