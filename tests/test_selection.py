"""Exact quantiles of large groups against numpy and against percentile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators.selection import exact_quantile


def values(spark):
    rng = np.random.default_rng(3)
    rows = [("wide", float(v)) for v in 10.0 ** rng.uniform(-200, 200, 3000)] + [("ties", float(v)) for v in rng.integers(0, 3, 2001)]
    rows += [("one", 5.0), ("equal", 1.5), ("equal", 1.5), ("none", None), (None, 2.0), (None, 4.0), (None, None), ("even", -3.0), ("even", 8.0)]
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_equal_to_percentile(spark, q):
    df = values(spark)
    want = {r.k: r.m for r in df.groupBy("k").agg(F.expr(f"percentile(v, {q}D) as m")).collect()}
    got = {r.k: r.m for r in exact_quantile(df, ["k"], "v", q, "m", few=20, splits=4).collect()}
    assert got == pytest.approx(want)


def test_whole_table_and_bad_arguments(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as v")
    assert exact_quantile(df, [], "v", few=10, splits=3).first().median == 500
    assert exact_quantile(df.limit(0), [], "v").collect()[0].median is None
    for bad in ({"q": 2.0}, {"few": 0}, {"splits": 0}):
        with pytest.raises(ValueError):
            exact_quantile(df, [], "v", **bad)
