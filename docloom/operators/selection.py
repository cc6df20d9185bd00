"""Exact medians and quantiles of groups of any size, without a group in one task.

A group's value at a rank is found by narrowing: mergeable sketches (approx_percentile, aggregated before the shuffle)
cut the values that are still in question into some SPLITS cells, the cells' exact counts tell which one holds the rank,
and only its values stay in question (in the first round there are two cuts, close to the rank). When no more than FEW of them are left, they are ordered. Each round shrinks a group
by about SPLITS times, whatever its distribution; equal values end in a cell of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.io import drop_written, written

SPLITS, FEW, ACCURACY = 64, 4096, 2000
#: A sketch errs by a share of 1 / ACCURACY at most, so a rank lies between marks so far from it (else a round shrinks less).
NEAR = 2 / ACCURACY


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, name: str = "median", few: int = FEW, splits: int = SPLITS) -> DataFrame:
    """keys and name: the q-quantile of the values that are not null, between neighbours in proportion (as percentile does).

    Groups without a value get null; null keys are a group. NaN counts as the largest value. q outside of 0 .. 1 and few or
    splits below 1 are an error.
    """
    if not 0 <= q <= 1 or min(few, splits) < 1:
        raise ValueError("q must be in 0 .. 1, few and splits positive")
    names = [f"g{i}" for i in range(len(keys))]
    own = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("v"))
    same = lambda a, b: " and ".join([f"{a}.{n} <=> {b}.{n}" for n in names] or ["true"])
    groups = written(own.groupBy(*names).agg(F.expr("count(v) as n"), F.expr("min(v) as lo"), F.expr("max(v) as hi")), "groups")
    # Two ranks, from 0, around the place of the quantile; `of` counts the values in question, `rank` is among them.
    place = f"({q}D * (n - 1))"
    ranks = f"inline(array(struct(0 as t, cast(floor{place} as bigint) as rank), struct(1 as t, cast(ceil{place} as bigint) as rank)))"
    todo = groups.where("n > 0").selectExpr(*names, "n as of", "lo", "hi", ranks)
    solved, tables = [], [groups]
    while True:
        todo = written(todo, "ranks")
        tables.append(todo)
        solved.append(todo.where("lo <=> hi").selectExpr(*names, "t", "lo as v"))
        open_ranks = todo.where("not lo <=> hi")
        near = own.alias("o").join(open_ranks.where(f"of <= {few}").alias("r"), F.expr(f"{same('o', 'r')} and o.v between r.lo and r.hi")).selectExpr(*[f"r.{n}" for n in names], "r.t", "r.rank", "o.v")
        order = Window.partitionBy(*names, "t").orderBy("v")
        solved.append(near.withColumn("at", F.row_number().over(order) - 1).where("at = rank").select(*names, "t", "v"))
        far = open_ranks.where(f"of > {few}")
        if far.isEmpty():
            break
        live = own.alias("o").join(far.alias("r"), F.expr(f"{same('o', 'r')} and o.v between r.lo and r.hi")).selectExpr(*[f"r.{n}" for n in names], "r.t", "r.rank", "o.v")
        # At first all groups are whole, so the rank is known as a share: two marks on both sides of it leave some thousandth.
        shares = [i / (splits + 1) for i in range(1, splits + 1)] if len(tables) > 2 else sorted({max(q - NEAR, 0.0), min(q + NEAR, 1.0)})
        cuts = ", ".join(f"{s}D" for s in shares)
        marks = live.groupBy(*names, "t").agg(F.expr(f"array_distinct(approx_percentile(v, array({cuts}), {ACCURACY})) as marks"))
        # A mark has a cell of its own, between the cells of the values beside it.
        cell = "2 * size(filter(m.marks, x -> x < l.v)) + if(array_contains(m.marks, l.v), 1, 0) as cell"
        dealt = live.alias("l").join(marks.alias("m"), F.expr(f"{same('l', 'm')} and l.t = m.t")).selectExpr(*[f"l.{n}" for n in names], "l.t", "l.rank", "l.v", cell)
        cells = dealt.groupBy(*names, "t", "rank", "cell").agg(F.expr("count(*) as c"), F.expr("min(v) as lo"), F.expr("max(v) as hi"))
        before = Window.partitionBy(*names, "t").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0)))
        todo = placed.where("rank >= below and rank < below + c").selectExpr(*names, "c as of", "lo", "hi", "t", "rank - below as rank")
    found = solved[0]
    for part in solved[1:]:
        found = found.unionByName(part)
    ends = found.groupBy(*names).agg(F.expr("max(if(t = 0, v, null)) as a"), F.expr("max(if(t = 1, v, null)) as b"))
    share = f"({q}D * (g.n - 1) - floor({q}D * (g.n - 1)))"
    out = groups.alias("g").join(ends.alias("e"), F.expr(same("g", "e")), "left").selectExpr(*[f"g.{n} as `{k}`" for n, k in zip(names, keys)], f"if(e.a <=> e.b, e.a, e.a + (e.b - e.a) * {share}) as `{name}`")
    result = written(out, "quantile")
    drop_written(*tables)
    return result
