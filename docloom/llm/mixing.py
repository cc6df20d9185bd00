"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells (one per combination of the margin columns, e.g. source, language and
topic) by tokens. Raking scales the cells' wanted tokens margin by margin until every margin has its target
share of the budget, for a fixed number of rounds. A document can be drawn ``most`` times at most, so a cell's wanted
tokens stop at that many times its own; the other cells of its margins take up the rest in the rounds that follow.
A document's expected number of draws is its cell's wanted tokens over the cell's own: the whole part is certain, and
the fraction is a probability that a hash of its key is compared with, so a rerun draws the same
ones. ``shortfalls`` tells, margin by margin, the target share, the reached one and the drawn one.

Scale: one aggregation (map-side first) over the documents and one join with the cells. The cells are
counted first: up to ``max_cells`` (a bound of a few megabytes) they are raked on the driver; beyond it each
round is an aggregation per margin in Spark over the cells alone, and each round is written to the shared
folder, which cuts the lineage. Both ways give the same weights.

Defined results: null margin values are a value of their own; a margin value without a target keeps its
present share; a target for a value that no document has is dropped, and targets are normalised over the
others. Null keys count as the empty string; rows with equal keys are drawn alike. A text that is null
or empty has no tokens and is never drawn. Targets that ``most`` makes impossible are met as far as it allows. An empty table gives an empty one. Extra columns stay;
result columns replace columns of the same name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, read

ROUNDS = 20
MAX_CELLS = 100_000
MARGINS = ["source", "lang", "topic"]
ALPHA, BUDGET, MOST = 0.7, 0.8, 4


def tokens_of(text: Column) -> Column:
    """Tokens of a text, estimated as a quarter of its characters, rounded up; ``mix`` takes any other count as a column."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 48 bits of a key's MD5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def topic_of(text: Column) -> Column:
    """A stand-in for a topic model: the kind of page, from the characters that mark tables and lists."""
    return F.when(text.contains(" | "), "table").when(text.contains("@"), "contact").otherwise("prose")


def tempered(cells: DataFrame, margin: str, alpha: float) -> DataFrame:
    """Targets proportional to the present shares to the power alpha: (value, share)."""
    sizes = cells.groupBy(margin).agg(F.sum("__tokens").alias("__n"))
    return sizes.select(F.col(margin).alias("value"), F.pow(F.col("__n").cast("double"), F.lit(alpha)).alias("share"))


def rake_local(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], rounds: int, budget: float, most: float) -> np.ndarray:
    """Wanted tokens of the cells. codes: the margin value of each cell; shares: its target, NaN without one."""
    total = tokens.sum()
    goals = []
    for code, share in zip(codes, shares):
        present, has = np.bincount(code, tokens, len(share)) / total, ~np.isnan(share)
        goal = present.copy()
        goal[has] = share[has] / share[has].sum() * present[has].sum()
        goals.append(goal * total * budget)
    w = tokens * budget
    for _ in range(rounds):
        for code, goal in zip(codes, goals):
            w = np.minimum(w * (goal / np.bincount(code, w, len(goal)))[code], tokens * most)
    return w


def _rake_on_driver(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, budget: float, most: float) -> DataFrame:
    spark, schema, table = cells.sparkSession, cells.schema, cells.toArrow()
    codes, shares = [], []
    for margin, target in targets.items():
        column = table.column(margin).to_pylist()
        values = {v: i for i, v in enumerate(dict.fromkeys(column))}
        share = np.full(len(values), np.nan)
        for r in target.groupBy("value").agg(F.max("share").alias("share")).join(cells.select(F.col(margin).alias("value")).distinct(), "value", "left_semi").collect():
            share[values[r["value"]]] = r["share"]
        for r in target.where("value is null").agg(F.max("share").alias("share")).collect():
            if None in values and r["share"] is not None:
                share[values[None]] = r["share"]
        codes.append(np.array([values[v] for v in column], np.int64))
        shares.append(share)
    w = rake_local(table.column("__tokens").to_numpy().astype(float), codes, shares, rounds, budget, most)
    return spark.createDataFrame(table.append_column("__w", pa.array(w))).select(*[F.col(f.name).cast(f.dataType) for f in schema], "__w")


def _rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, budget: float, most: float) -> DataFrame:
    """cells with __w, the wanted tokens."""
    own = cells.withColumn("__w", F.col("__tokens") * F.lit(float(budget)))
    goals = {}
    for margin, target in targets.items():
        present = own.groupBy(margin).agg(F.sum("__w").alias("__p"))
        wanted = target.groupBy("value").agg(F.max("share").alias("__s"))
        both = present.join(wanted, F.col(margin).eqNullSafe(F.col("value")), "left")
        sums = both.agg(F.sum(F.when(F.col("__s").isNotNull(), F.col("__p"))).alias("__with"), F.sum("__s").alias("__all"))
        goal = F.when(F.col("__s").isNull(), F.col("__p")).otherwise(F.col("__s") / F.col("__all") * F.col("__with"))
        goals[margin] = both.crossJoin(F.broadcast(sums)).select(F.col(margin).alias("__v"), goal.alias("__goal"))
    goals = {m: materialize(g, "goal") for m, g in goals.items()}
    for k in range(rounds):
        for margin, goal in goals.items():
            now = own.groupBy(F.col(margin).alias("__m")).agg(F.sum("__w").alias("__now"))
            factor = now.join(goal, F.col("__m").eqNullSafe(F.col("__v"))).select("__m", (F.col("__goal") / F.col("__now")).alias("__f"))
            own = own.join(factor, F.col(margin).eqNullSafe(F.col("__m"))).withColumn("__w", F.least(F.col("__w") * F.col("__f"), F.col("__tokens") * F.lit(float(most)))).drop("__m", "__f")
        own = materialize(own, "rake")
    return own


def mix_weights(docs: DataFrame, margins: list[str], alpha: float | None = None, targets: dict[str, DataFrame] | None = None, budget: float = 1.0, most: float = 1, text: str = "text", tokens: Column | None = None, rounds: int = ROUNDS, max_cells: int = MAX_CELLS) -> DataFrame:
    """The cells: margins, tokens, wanted (tokens, raked) and expected (draws per document); targets or, with alpha, tempered shares.

    budget: wanted tokens over present tokens; most: how often a document may be drawn; tokens: a document's tokens.
    """
    size = tokens_of(F.col(text)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    cells = materialize(docs.groupBy(*margins).agg(F.sum(size).alias("__tokens")).where("__tokens > 0"), "cells")
    wanted = targets or {m: tempered(cells, m, 1.0 if alpha is None else alpha) for m in margins}
    n = cells.count()
    if not n:
        raked = cells.withColumn("__w", F.lit(0.0))
    else:
        raked = _rake_on_driver(cells, wanted, rounds, budget, most) if n <= max_cells else _rake(cells, wanted, rounds, budget, most)
    return raked.select(*margins, F.col("__tokens").alias("tokens"), F.col("__w").alias("wanted"), (F.col("__w") / F.col("__tokens")).alias("expected"))


def mix(docs: DataFrame, margins: list[str], key: str = "doc_id", text: str = "text", seed: str = ":mix", tokens: Column | None = None, **options) -> DataFrame:
    """docs with expected, draws and kept (drawn at least once) for every document."""
    keep = [c for c in docs.columns if c not in ("expected", "draws", "kept")]
    weights = mix_weights(docs, margins, text=text, tokens=tokens, **options)
    if weights.count() <= MAX_CELLS:  # a few megabytes
        weights = F.broadcast(weights)
    cells = weights.select(*[F.col(m).alias(f"__cell_{m}") for m in margins], F.col("expected").alias("__e"))
    on = [F.col(m).eqNullSafe(F.col(f"__cell_{m}")) for m in margins]
    size = F.length(text) if tokens is None else tokens
    rows = docs.select(*keep).join(cells, on, "left").withColumn("__e", F.when(F.coalesce(size, F.lit(0)) > 0, F.coalesce("__e", F.lit(0.0))).otherwise(0.0))
    whole = F.floor("__e")
    draws = (whole + (unit_hash(F.col(key), seed) < F.col("__e") - whole).cast("long")).cast("long")
    return rows.select(*keep, F.col("__e").alias("expected"), draws.alias("draws"), (draws > 0).alias("kept"))


def shortfalls(mixed: DataFrame, margins: list[str], targets: dict[str, DataFrame], text: str = "text", tokens: Column | None = None) -> DataFrame:
    """margin, value, target (share), expected and drawn (shares of the tokens that are expected and were drawn) of what ``mix`` returned."""
    size = tokens_of(F.col(text)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    own = mixed.select(*margins, (size * F.col("expected")).alias("__e"), (size * F.col("draws")).alias("__d"))
    parts = []
    for m in margins:
        sums = own.groupBy(F.col(m).alias("__v")).agg(F.sum("__e").alias("__e"), F.sum("__d").alias("__d"))
        everything = sums.agg(F.sum("__e").alias("__all_e"), F.sum("__d").alias("__all_d"))
        goal = targets[m].groupBy("value").agg(F.max("share").alias("share"))
        total = goal.agg(F.sum("share").alias("__all_s"))
        rows = sums.join(goal, F.col("__v").eqNullSafe(F.col("value")), "left").crossJoin(F.broadcast(everything)).crossJoin(F.broadcast(total))  # one row each
        parts.append(rows.select(F.lit(m).alias("margin"), F.col("__v").cast("string").alias("value"), (F.col("share") / F.col("__all_s")).alias("target"), (F.col("__e") / F.col("__all_e")).alias("expected"), (F.col("__d") / F.col("__all_d")).alias("drawn")))
    return reduce(DataFrame.unionByName, parts)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").withColumn("topic", topic_of(F.col("text")))
    mixed = mix(docs, MARGINS, alpha=ALPHA, budget=BUDGET, most=MOST)
    return mixed.select("doc_id", *MARGINS, tokens_of(F.col("text")).alias("n_tokens"), F.round("expected", 6).alias("expected"), "draws", "kept")


def op6_sql() -> str:
    names = ", ".join(MARGINS)
    parts = [
        f"""d as materialized (select doc_id, source, lang, text, case when contains(text, ' | ') then 'table' when contains(text, '@') then 'contact' else 'prose' end as topic,
  coalesce(ceil(length(text) / 4), 0)::bigint as n_tokens from documents)""",
        f"c as materialized (select {names}, sum(n_tokens)::double as t from d group by {names} having sum(n_tokens) > 0)",
        *[f"goal_{m} as materialized (select {m} as v, pow(sum(t), {ALPHA}) / sum(pow(sum(t), {ALPHA})) over () as goal from c group by {m})" for m in MARGINS],
        f"w_0 as materialized (select {names}, t, t * {BUDGET} as w, {BUDGET} * (select sum(t) from c) as all_t from c)",
    ]
    k = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            k += 1
            parts.append(f"w_{k} as materialized (select x.source, x.lang, x.topic, t, all_t, least(w * (goal * all_t / sum(w) over (partition by x.{m})), t * {float(MOST)}) as w from w_{k - 1} x join goal_{m} on x.{m} is not distinct from v)")
    on = " and ".join(f"d.{m} is not distinct from x.{m}" for m in MARGINS)
    return f"""with {", ".join(parts)},
e as (select doc_id, {", ".join("d." + m for m in MARGINS)}, n_tokens, case when n_tokens > 0 then coalesce(w / t, 0) else 0 end as e from d left join w_{k} x on {on}),
n as (select *, (floor(e) + (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix'), 1, 12))::bigint / 281474976710656.0 < e - floor(e))::int)::bigint as draws from e)
select doc_id, {names}, n_tokens, round(e, 6) as expected, draws, draws > 0 as kept from n"""
