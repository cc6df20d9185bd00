"""The dense index against the full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import vector_index as vi
from docloom.operators.dense import dense_topk


def vectors_of(spark, x, parts=5):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(parts)


def grouped(n=1500, dim=8, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return middle[rng.integers(groups, size=n)] + 0.1 * rng.normal(size=(n, dim))


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def asked_of(vectors, every=20):
    return vectors.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def test_equal_to_the_scan_with_fewer_cells(spark, tmp_path):
    x = grouped()
    x[300:900] = x[300]  # a hot group of equal vectors: ties by key across blocks
    x[1000] = 0
    vectors = vectors_of(spark, x)
    index = vi.build_vector_index(vectors, str(tmp_path / "index"))
    asked = asked_of(vectors)
    got = vi.index_topk(index, asked, 7, digits=6, visits=True)
    assert rows(got) == rows(dense_topk(vectors, asked, 7, digits=6))
    seen = {r.query_id: (r.cells_visited, r.cells) for r in got.collect()}
    shares = [a / b for q, (a, b) in seen.items() if q != 1000]
    assert np.mean(shares) < 0.7 and seen[1000][0] == seen[1000][1]  # a zero vector ties with all


def test_blocks_are_small_and_hold_every_row_once(spark, tmp_path):
    x = grouped()
    x[:800] = 1.0
    index = vi.build_vector_index(vectors_of(spark, x), str(tmp_path / "index"), cells=5)
    blocks = index.blocks.collect()
    assert sorted(k for b in blocks for k in b.vec_id) == list(range(len(x)))
    assert max(b.n for b in blocks) <= 1024 and all(len(b.v) == b.n * 8 and b.near <= b.far for b in blocks)


def test_probes_miss_little(spark, tmp_path):
    vectors = vectors_of(spark, grouped())
    index = vi.build_vector_index(vectors, str(tmp_path / "index"))
    asked = asked_of(vectors)
    want = {(q, v) for q, _, v, _ in rows(dense_topk(vectors, asked, 10))}
    got = {(q, v) for q, _, v, _ in rows(vi.index_topk(index, asked, 10, probes=6))}
    assert len(want & got) >= 0.9 * len(want)


def test_defined_cases(spark, tmp_path):
    vectors = vectors_of(spark, grouped(30))
    index = vi.build_vector_index(vectors.unionByName(spark.createDataFrame([(99, None)], vectors.schema)), str(tmp_path / "a"), cells=3)
    asked = asked_of(vectors, 10)
    assert rows(vi.index_topk(index, asked, 50, digits=9)) == rows(dense_topk(vectors, asked, 50, digits=9)) and vi.index_topk(index, asked, 50).count() == 90
    assert vi.index_topk(index, asked.limit(0), 5).collect() == []
    nothing = vi.build_vector_index(vectors.limit(0), str(tmp_path / "b"))
    assert vi.index_topk(nothing, asked.limit(0), 5).collect() == []
    for bad in ({"k": 0}, {"k": 1, "probes": 0}, {"k": 1, "first": 0}):
        with pytest.raises(ValueError):
            vi.index_topk(index, asked, **bad)
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "vec_id string, embedding array<float>")
    index = vi.build_vector_index(named, str(tmp_path / "c"), cells=2)
    got = vi.index_topk(index, named.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 2)
    assert [(r.query_id, r.vec_id) for r in got.orderBy("query_id", "rank").collect()] == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c"), ("c", "a")]
