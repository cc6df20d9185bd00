"""Hard negatives against all pairs, and the defined cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import hard_negatives as hn
from docloom.llm.queries import QUERIES


def plain(rows, positives=5, negatives=3, scale=256):
    """rows: (key, label, is anchor, vector), all taking part. All pairs, with Python integers."""
    x = [[math.floor(scale * float(v)) for v in r[3]] for r in rows]
    exact = np.array(x, dtype=object)
    out = []
    for a, (key, label, anchor, _) in enumerate(rows):
        if not anchor:
            continue
        score = exact @ exact[a]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-score[i], rows[i][0]))
        for p in [i for i in order if rows[i][1] == label][:positives]:
            own = [i for i in order if rows[i][1] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out += [(key, rows[p][0], r, rows[i][0], score[p], score[i]) for r, i in enumerate(own, 1)]
    return sorted(out)


def mined(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def mine(df, every=5, **options):
    return mined(hn.mine(df, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("vec_id") % every == 0, **options))


def df_of(spark, rows, parts=4):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, key string, x string, cell string").repartition(parts)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    kept = [r for r in rows if r.label is not None and r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding)]
    labels = [(r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label for r in kept]
    want = plain([(r.vec_id, label, r.vec_id % 50 == 0, r.embedding) for r, label in zip(kept, labels)])
    assert want and mined(QUERIES["op13_hard_negatives"](spark, sf)) == want


def test_groups_ties_and_hot_copies(spark):
    """Groups that bounds tell apart, many equal vectors (ties by key), several cells and block sizes."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(9, 6))
    x = middle[rng.integers(9, size=400)] + 0.2 * rng.normal(size=(400, 6))
    x[100:240] = x[100]
    rows = [(i, int(rng.integers(3)), v.tolist(), "a", "b", "c") for i, v in enumerate(x)]
    want = plain([(r[0], r[1], r[0] % 5 == 0, r[2]) for r in rows])
    for options in ({}, {"cells": 1}, {"cells": 40, "first": 1}):
        assert mine(df_of(spark, rows), **options) == want


def test_cells_are_skipped(spark, monkeypatch):
    """Far groups: an anchor's packs go to few of the cells."""
    rng = np.random.default_rng(6)
    middle = 20 * rng.normal(size=(30, 16))
    x = middle[np.arange(900) % 30] + rng.normal(size=(900, 16))
    rows = [(i, i % 2, v.tolist(), "a", "b", "c") for i, v in enumerate(x)]
    visited = []
    real = hn.visit
    monkeypatch.setattr(hn, "visit", lambda packs, *rest: visited.append(packs.select(F.sum(F.size("q"))).first()[0] or 0) or real(packs, *rest))
    got = mine(df_of(spark, rows), every=10, cells=30)
    assert got == plain([(r[0], r[1], r[0] % 10 == 0, r[2]) for r in rows])
    assert sum(visited) < 0.5 * 2 * 90 * 30  # of two searches of 90 anchors over 30 cells


def test_large_integers_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, [float(v) for v in rng.integers(-(10**6), 10**6, size=3)], "", "", "") for i in range(60)]
    assert mine(df_of(spark, rows)) == plain([(r[0], r[1], r[0] % 5 == 0, r[2]) for r in rows])


def test_defined_cases(spark):
    rng = np.random.default_rng(8)
    good = [(i, i % 3, rng.normal(size=4).tolist(), "", "", "") for i in range(40)]
    bad = [(500, None, [9.0] * 4, "", "", ""), (505, 1, None, "", "", ""), (510, 1, [9.0, None, 9.0, 9.0], "", "", ""), (515, 1, [float("nan")] * 4, "", "", ""), (520, 1, [9.0], "", "", ""), (525, 1, [], "", "", ""), (530, 1, [1e200] * 4, "", "", ""), (None, 1, [9.0] * 4, "", "", "")]
    want = plain([(r[0], r[1], r[0] % 5 == 0, r[2]) for r in good])
    assert mine(df_of(spark, good + bad)) == want
    twice = sorted(good + good)
    assert mine(df_of(spark, twice)) == plain([(r[0], r[1], r[0] % 5 == 0, r[2]) for r in twice])
    for rows in ([], good[:1], [r for r in good if r[1] == 0]):
        assert mine(df_of(spark, rows)) == []
