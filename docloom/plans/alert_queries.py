"""Alert queries over events: the event type gives the priority, and two derived models give ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.io import table
from docloom.operators import alerts as A


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    priority = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return e.select(F.col("event_id").alias("alert_id"), "event_type", "user_id", "value", "props", priority.alias("priority"))


def rankings(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    """Model a ranks by the user, model b by the event; each seventh event of model b is not parsed."""
    e = _events(spark, d)
    a = e.select(F.lit("a").alias("model"), "alert_id", "event_type", "priority", ((F.col("user_id") + shift) % 5 + 1).cast("int").alias("rank"))
    b = e.select(F.lit("b").alias("model"), "alert_id", "event_type", "priority", F.when((F.col("alert_id") + shift) % 7 != 0, (F.col("alert_id") % 5 + 1).cast("int")).alias("rank"))
    return a.unionByName(b)


def judged(spark: SparkSession, d: str) -> DataFrame:
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 50))
    return _events(spark, d).select(F.lit("a").alias("model"), "alert_id", score.alias("score"), F.col("event_type").alias("reasoning"))


def q_anchor(spark: SparkSession, d: str) -> DataFrame:
    return rankings(spark, d).select("model", "alert_id", A.anchored_rank(F.col("priority")).alias("anchor"), A.is_mismatch(F.col("rank"), F.col("priority")).alias("mismatch"))


def q_agreement(spark: SparkSession, d: str) -> DataFrame:
    return A.agreement(rankings(spark, d)).withColumn("mismatch_rate", F.round("mismatch_rate", 6))


def q_judge(spark: SparkSession, d: str) -> DataFrame:
    s = A.judge_summary(judged(spark, d), rankings(spark, d))
    return s.select("model", "n", "exact", "close", *[F.round(c, 6).alias(c) for c in ("mean", "median", "mismatch_mean", "other_mean")])


def q_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies made from events: valid ones, and ones with a wrong type, rank, key or form."""
    e = _events(spark, d)
    rank = F.when(F.col("alert_id") % 11 == 0, F.lit('"3"')).when(F.col("alert_id") % 13 == 0, F.lit("2.0")).when(F.col("alert_id") % 17 == 0, F.lit("true")).otherwise((F.col("user_id") % 7).cast("string"))
    extra = F.when(F.col("alert_id") % 19 == 0, F.lit(', "other": 1')).when(F.col("alert_id") % 5 == 0, F.lit(', "matched_sid": null')).otherwise(F.lit(""))
    end = F.when(F.col("alert_id") % 23 == 0, F.lit("\n{}")).otherwise(F.lit(""))
    text = F.concat(F.lit('{"model_rank": '), rank, F.lit(', "justification": "'), F.col("event_type"), F.lit('", "metrics_used": ["priority"]'), extra, F.lit("}"), end)
    return e.select("alert_id", A.parse_reply(text).alias("p")).select("alert_id", F.col("p.model_rank").alias("model_rank"), F.col("p.justification").alias("justification"))


QUERIES = {
    "severity_anchor": q_anchor,
    "rank_agreement": q_agreement,
    "confusion": lambda s, d: A.confusion(rankings(s, d)),
    "mismatch_by_priority": lambda s, d: A.mismatch_by_priority(rankings(s, d)),
    "judge_summary": q_judge,
    "judge_bands": lambda s, d: A.judge_bands(judged(s, d)),
    "lowest_scored": lambda s, d: A.lowest_scored(judged(s, d)).select("alert_id", F.round("score", 6).alias("score"), "reasoning", "place"),
    "pair_agreement": lambda s, d: A.pair_agreement(rankings(s, d)),
    "run_comparison": lambda s, d: A.run_comparison(rankings(s, d), rankings(s, d, 1))[0],
    "moved_ranks": lambda s, d: A.run_comparison(rankings(s, d), rankings(s, d, 1))[1],
    "top_labels": lambda s, d: A.top_labels(_events(s, d), "user_id", "alert_id"),
    "strict_replies": q_replies,
    "document_by_priority": lambda s, d: A.document_by_priority(_events(s, d).withColumnRenamed("event_type", "document")),
}

_E = "e as (select event_id as alert_id, event_type, user_id, value, case event_type when 'error' then 1 when 'click' then 2 else 3 end as priority from events)"


def _ranks(name: str, shift: int = 0) -> str:
    return f"""{name} as (select 'a' as model, alert_id, event_type, priority, ((user_id + {shift}) % 5 + 1)::int as rank from e
union all select 'b', alert_id, event_type, priority, case when (alert_id + {shift}) % 7 <> 0 then (alert_id % 5 + 1)::int end from e)"""


_R = f"with {_E}, {_ranks('r')}, x as (select *, priority * 2 - 1 as anchor from r)"
_J = "j as (select 'a' as model, alert_id, least(1.0, greatest(0.0, value / 50)) as score, event_type as reasoning from e)"
ORACLES = {
    "severity_anchor": f"{_R} select model, alert_id, anchor::int as anchor, abs(rank - anchor) > 1 as mismatch from x",
    "rank_agreement": f"""{_R} select model, count(*) as alerts, count(rank) as parsed, count(*) filter (rank = anchor) as exact, count(*) filter (abs(rank - anchor) = 2) as two_off,
count(*) filter (abs(rank - anchor) > 1) as mismatches, round(count(*) filter (abs(rank - anchor) > 1) / count(rank), 6) as mismatch_rate, count(distinct rank) as ranks_used, count(distinct rank) = 1 as collapsed from x group by model""",
    "confusion": f"{_R} select model, priority, {', '.join(f'count(*) filter (rank = {i}) as rank_{i}' for i in range(1, 6))}, count(rank) as total from x where rank is not null group by all",
    "mismatch_by_priority": f"""{_R}, p as (select model, priority::int as priority, (count(*) filter (abs(rank - anchor) > 1))::bigint as mismatches, count(*)::bigint as parsed from x where rank is not null group by model, rollup (priority)) select * from p""",
    "judge_summary": f"""{_R}, {_J}, b as (select j.model, score, coalesce(abs(rank - anchor) > 1, false) as wrong from j left join x using (model, alert_id))
select model, count(score) as n, count(*) filter (score = 1.0) as exact, count(*) filter (score >= 0.5) as close, round(avg(score), 6) as mean, round(median(score), 6) as median,
round(avg(score) filter (wrong), 6) as mismatch_mean, round(avg(score) filter (not wrong), 6) as other_mean from b group by model""",
    "judge_bands": f"""with {_E}, {_J} select model, count(*) filter (score < 0.2) as band_0, count(*) filter (score >= 0.2 and score < 0.4) as band_1, count(*) filter (score >= 0.4 and score < 0.6) as band_2,
count(*) filter (score >= 0.6 and score < 0.8) as band_3, count(*) filter (score >= 0.8) as band_4 from j where score is not null group by model""",
    "lowest_scored": f"with {_E}, {_J}, o as (select *, row_number() over (partition by model order by score, reasoning, alert_id) as place from j) select alert_id, round(score, 6) as score, reasoning, place from o where place <= 3",
    "pair_agreement": f"{_R} select a.model as model_a, b.model as model_b, count(*) as common, count(*) filter (a.rank = b.rank) as agree from x a join x b using (alert_id) where a.model < b.model and a.rank is not null and b.rank is not null group by 1, 2",
    "run_comparison": f"""with {_E}, {_ranks('r')}, {_ranks('p', 1)}, c as (select model, r.rank as now, p.rank as before from r join p using (model, alert_id) where r.rank is not null and p.rank is not null)
select c.model, count(*) as common, count(*) filter (now <> before) as changed, (select count(distinct rank) from p where p.model = c.model) as used_before, (select count(distinct rank) from r where r.model = c.model) as used_now from c group by c.model""",
    "moved_ranks": f"with {_E}, {_ranks('r')}, {_ranks('p', 1)} select model, alert_id, r.rank as after, p.rank as before from r join p using (model, alert_id) where r.rank <> p.rank",
    "top_labels": "select user_id, n from (select user_id, count(*) as n, min(event_id) as f from events where user_id is not null group by 1 order by n desc, f limit 12)",
    "strict_replies": f"""with {_E} select alert_id, case when ok then user_id % 7 end as model_rank, case when ok then event_type end as justification
from (select *, alert_id % 11 <> 0 and alert_id % 13 <> 0 and alert_id % 17 <> 0 and alert_id % 19 <> 0 and alert_id % 23 <> 0 and user_id % 7 between 1 and 5 as ok from e)""",
    "document_by_priority": f"with {_E} select event_type as document, {', '.join(f'count(*) filter (priority = {p}) as priority_{p}' for p in (1, 2, 3))}, count(*) as total from e group by 1",
}
