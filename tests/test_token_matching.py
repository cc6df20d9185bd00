"""Token matching against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.text import word_tokens
from docloom.operators import token_matching as M


def unit(token):
    v = M.GramVectors()([token])[0]
    return v / np.linalg.norm(v)


def plain(a, b, weight):
    best = lambda own, other: sum(weight(t) * max(float(unit(t) @ unit(u)) for u in other) for t in own) / sum(weight(t) for t in own)
    p, r = best(a, b), best(b, a)
    return p, r, 2 * p * r / (p + r) if p > 0 and r > 0 else 0.0


TEXTS = [(1, "The cat sat on the mat", "A cat is sitting on mats"), (2, "alpha beta", "alpha beta"), (3, "retry the login", "the the the"), (4, "x", "completely different words"), (5, None, "a"), (6, "", "a"), (7, "a b", "--")]


@pytest.mark.parametrize("weighted", [False, True])
def test_equal_to_plain_loops(spark, weighted):
    pairs = spark.createDataFrame(TEXTS, "id int, answer string, reference string").repartition(3)
    weights = M.token_weights(pairs, word_tokens(F.col("reference"))) if weighted else None
    got = {r.id: (r.precision, r.recall, r.f1) for r in M.match_tokens(pairs, ["id"], "answer", "reference", M.GramVectors(), weights).collect()}
    own = {i: ((a or "").lower().split(), [t for t in b.lower().split() if t != "--"]) for i, a, b in TEXTS}
    refs = [set(b) for _, b in own.values()]
    df = lambda t: sum(t in r for r in refs)
    weight = (lambda t: math.log((len(refs) + 1) / (df(t) + 1)) if df(t) else max(math.log((len(refs) + 1) / (df(u) + 1)) for r in refs for u in r)) if weighted else lambda t: 1.0
    for i, (a, b) in own.items():
        assert got[i] == (pytest.approx(plain(a, b, weight)) if a and b else (None, None, None))
    assert got[2] == pytest.approx((1, 1, 1))


def test_blocks_hold_no_whole_matrix():
    rng = np.random.default_rng(1)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(50, 8)), rng.normal(size=(37, 8))))
    left, right = M.best_matches(a, b, 7)
    assert np.allclose(left, (a @ b.T).max(axis=1)) and np.allclose(right, (a @ b.T).max(axis=0))
