"""Connected components of a distributed edge list by alternating large and small stars.

Each round is an aggregation (map-side first) and a join; every round is written to the shared folder, which cuts the
lineage. The driver sees two
numbers a round. The number of rounds grows with the logarithm of the longest chain. Once no more than FEW edges are
left (a fixed bound of some hundred megabytes), one task finishes them by union and find; rounds shrink no
graph below the number of its nodes, so large graphs go on in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import drop_table, materialize, tidy

FEW = 1 << 19


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of all edges (a, b) of a task."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    a, b = (c.combine_chunks() for c in table.columns)
    nodes = pa.concat_arrays([a, b]).unique()
    nodes = nodes.take(pc.sort_indices(nodes))  # so that the least number is the least node
    up = list(range(len(nodes)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(pc.index_in(a, nodes).to_pylist(), pc.index_in(b, nodes).to_pylist()):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    least = pa.array([find(x) for x in range(len(nodes))], pa.int32())
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(least)], names=["node", "component"])


def _starred(edges: DataFrame, both: bool) -> DataFrame:
    """Larger (or, small star, smaller) neighbours are tied to the least of a node's neighbourhood."""
    if both:
        own = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = own.groupBy("a").agg(F.min("b").alias("__m")).withColumn("__m", F.least("a", "__m"))
        out = own.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("__m").alias("b"))
    else:
        own = edges  # a > b
        least = own.groupBy("a").agg(F.min("b").alias("__m"))
        out = own.join(least, "a").where("b <> __m").select(F.col("b").alias("a"), F.col("__m").alias("b")).unionByName(least.select("a", F.col("__m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """node and component (the least node it can reach) for every node that has an edge to another one."""
    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        if now.count() <= few:
            kind = now.schema["a"].dataType
            found = materialize(now.repartition(1).mapInArrow(tidy(_united), T.StructType([T.StructField("node", kind), T.StructField("component", kind)])), "components")
            drop_table(now)
            return found
        after = materialize(_starred(_starred(now, True), False), "edges")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        drop_table(now)
        now = after
        if state == last or state[0] == 0:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
