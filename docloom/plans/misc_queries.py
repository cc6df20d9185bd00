"""Store, source, conversation, rate and window queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.providers import lexical_scorer
from docloom.functions.text import display_width, estimate_tokens, is_refusal, question_key, word_tokens
from docloom.io import settings, shared_dir, small_batches, table
from docloom.operators import conversations as C
from docloom.operators import store as S
from docloom.operators.lexical import signature
from docloom.operators.selection import exact_quantile
from docloom.operators.token_matching import GramVectors, match_tokens, token_weights
from docloom.sources.html import html_lines
from docloom.streaming.ingest import sessions, windowed_counts
from docloom.streaming.limits import STORE, usage_stream
from docloom.streaming.rate import daily_usage, minute_windows


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files: all documents but each fifth; manifest: all but each seventh, and each eleventh with another hash."""
    docs = table(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("identity"), "doc_id", F.sha2("text", 256).alias("hash"))
    manifest = docs.where("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 11 == 0, F.lit("old")).otherwise(F.col("hash")))
    return docs.where("doc_id % 5 <> 0"), manifest


def q_diff(spark: SparkSession, d: str) -> DataFrame:
    return S.manifest_states(*_states(spark, d))


def q_guard(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df: df.groupBy(F.substring_index("identity", "/", 1).alias("doc_name")).agg(F.count("*").alias("chunk_count"))
    files, manifest = _states(spark, d)
    return S.count_differences(count(manifest), count(files))


def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    new = labels.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), "toxic")
    return S.keyed_upsert(labels, new, "doc_id")


def q_pending(spark: SparkSession, d: str) -> DataFrame:
    models = spark.sql("select * from values ('a'), ('b'), ('c') as t(model)")
    items = table(spark, d, "benchmark").select("item_id")
    done = models.crossJoin(items).where("(item_id + ascii(model)) % 4 = 0")
    return S.pending(models, items, done, "model", "item_id")


def q_page(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("id"), "doc_id")
    rows, total = S.page_of(ids, "id", 50, 100)
    return rows.withColumn("total", F.lit(total).cast("long"))


def q_usage_stream(spark: SparkSession, d: str) -> DataFrame:
    """A replay of all events through the stateful stream: three runs of one checkpoint, each over the next stretch of time."""
    folder = f"{shared_dir(spark)}/docloom-replay-{uuid.uuid4().hex}"
    events = table(spark, d, "events").selectExpr("event_id", "event_type", "ts", "event_id % 7 as amount").where("ts is not null")
    cuts = events.selectExpr("approx_percentile(unix_micros(cast(ts as timestamp)), array(0.33D, 0.66D), 1000) as c").first().c or [0, 0]
    for part, (after, until) in enumerate(zip((-(1 << 62), *cuts), (*cuts, 1 << 62))):
        events.where(f"unix_micros(cast(ts as timestamp)) > {after}L and unix_micros(cast(ts as timestamp)) <= {until}L").write.parquet(f"{folder}/in/{part}")
        with settings(spark, **STORE):
            stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
            run = usage_stream(stream, "event_type", "ts", "amount", "event_id", 3600).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema("key string, id bigint, requests bigint, tokens bigint, day_requests bigint, day_tokens bigint").parquet(f"{folder}/out")


def q_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians and ninth deciles of large groups, by narrowing."""
    prices, sizes = table(spark, d, "lineitem"), table(spark, d, "documents")
    found = [exact_quantile(prices, ["l_returnflag"], "l_extendedprice", q, "value").selectExpr("'price' as what", "l_returnflag as k", f"{q}D as q", "round(value, 4) as value") for q in (0.5, 0.9)]
    found.append(exact_quantile(sizes, ["source"], "n_chars", 0.5, "value").selectExpr("'size' as what", "source as k", "0.5D as q", "round(value, 4) as value"))
    return reduce(DataFrame.unionByName, found)


def q_token_matching(spark: SparkSession, d: str) -> DataFrame:
    """Answers of conversations matched with their questions, token by token."""
    turns = C.completed_turns(table(spark, d, "conversations"))
    weights = token_weights(turns, word_tokens(F.col("question")))
    found = match_tokens(turns, ["conv_id", "turn"], "answer", "question", GramVectors(), weights)
    return found.selectExpr("conv_id", "turn", "round(precision, 6) as precision", "round(recall, 6) as recall", "round(f1, 6) as f1")


def q_indexed_page(spark: SparkSession, d: str) -> DataFrame:
    """The same ids by a page index: three deep pages, of which each reads few ranges."""
    ids = table(spark, d, "documents").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("id"), "doc_id")
    path = f"{shared_dir(spark)}/docloom-pages-{uuid.uuid4().hex}"
    S.build_page_index(ids, "id", path, 64)
    pages = [S.indexed_page(spark, path, "id", 40, offset) for offset in (0, 60, 150)]
    return reduce(DataFrame.unionByName, [rows.selectExpr("id", "doc_id", f"{total}L as total", f"{n} as page") for n, (rows, total, _) in enumerate(pages)])


def q_signature(spark: SparkSession, d: str) -> DataFrame:
    return signature(table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("h")), "item_id", "h")


def q_turns(spark: SparkSession, d: str) -> DataFrame:
    return C.last_turns(table(spark, d, "conversations"))


def q_titles(spark: SparkSession, d: str) -> DataFrame:
    return C.titles(table(spark, d, "conversations"))


def q_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.lit(1).alias("amount"))
    return minute_windows(e, "user_id", "ts", "amount", 3600).select("event_id", "requests", "tokens")


def q_usage(spark: SparkSession, d: str) -> DataFrame:
    return daily_usage(table(spark, d, "events").withColumn("amount", F.lit(2)), "user_id", "ts", "amount")


def q_hours(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return w.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    w = sessions(table(spark, d, "events"), "ts", "user_id")
    return w.select(F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "user_id", "n")


def q_html(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)  # rows hold whole pages
    own = table(spark, d, "pages").select("page_id", html_lines("html").alias("l"))
    return own.select("page_id", F.size("l").alias("n_lines"), F.sha2(F.array_join("l", "\n"), 256).alias("text_hash"))


def q_json(spark: SparkSession, d: str) -> DataFrame:
    """The integer k of each event's properties, strictly typed."""
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    return table(spark, d, "events").select("event_id", F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")).alias("k"))


def q_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    rows = table(spark, d, "benchmark")
    return rows.select("item_id", question_key(t).alias("key"), estimate_tokens(t).alias("tokens"), is_refusal(t).alias("refused"), F.round(display_width(F.length(t) / 1000), 6).alias("width"), F.round(lexical_scorer(t, F.lit("the and of")), 6).alias("overlap"))


QUERIES = {
    "incremental_diff": q_diff, "count_guard": q_guard, "keyed_upsert": q_upsert, "resume_pending": q_pending, "numeric_id_page": q_page, "indexed_page": q_indexed_page, "usage_stream": q_usage_stream, "exact_medians": q_medians, "token_matching": q_token_matching, "signature": q_signature, "last_turns": q_turns, "conversation_titles": q_titles,
    "recent_conversations": lambda s, d: C.recent(table(s, d, "conversations")), "rate_window": q_rate, "daily_usage": q_usage, "hourly_windows": q_hours, "event_sessions": q_sessions, "html_lines": q_html, "json_reply_parse": q_json,
    "scalar_functions": q_scalars, "chunk_counts": lambda s, d: S.counts(table(s, d, "documents"), "source"),
}

_ST = """docs as (select source || '/' || doc_id || '.txt' as identity, source, doc_id, sha256(text) as hash from documents), f as (select * from docs where doc_id % 5 <> 0),
m as (select identity, source, case when doc_id % 11 = 0 then 'old' else hash end as hash from docs where doc_id % 7 <> 0)"""
_TURNS = "t as (select *, lead(role) over o as nr, lead(text) over o as answer from conversations window o as (partition by conv_id order by turn)), c as (select conv_id, turn, text as question, answer from t where role = 'user' and nr = 'assistant')"
ORACLES = {
    "incremental_diff": f"with {_ST} select coalesce(f.identity, m.identity) as identity, case when f.identity is null then 'removed' when m.identity is null then 'added' when f.hash = m.hash then 'skipped' else 'updated' end as state from f full join m on f.identity = m.identity",
    "count_guard": f"""with {_ST}, a as (select source, count(*) as n from m group by 1), b as (select source, count(*) as n from f group by 1)
select coalesce(a.source, b.source) as doc_name, a.n as expected, b.n as stored from a full join b on a.source = b.source where a.n is distinct from b.n""",
    "keyed_upsert": "select doc_id, case when doc_id % 3 = 0 then 1 - quality else quality end as quality, toxic from labels",
    "resume_pending": "select model, item_id from (values ('a'), ('b'), ('c')) t(model), benchmark where (item_id + ascii(model)) % 4 <> 0",
    "usage_stream": """with e as (select event_type as key, event_id as id, event_id % 7 as amount, epoch_us(ts) as us from events where ts is not null)
select key, id, count(*) over w as requests, (sum(amount) over w)::bigint as tokens, count(*) over t as day_requests, (sum(amount) over t)::bigint as day_tokens from e
window w as (partition by key order by us range between 3599999999 preceding and current row), t as (partition by key, us // 86400000000 order by us range between unbounded preceding and current row)""",
    "exact_medians": """select 'price' as what, l_returnflag as k, 0.5::double as q, round(quantile_cont(l_extendedprice::double, 0.5), 4) as value from lineitem group by l_returnflag
union all select 'price', l_returnflag, 0.9::double, round(quantile_cont(l_extendedprice::double, 0.9), 4) from lineitem group by l_returnflag union all select 'size', source, 0.5::double, round(quantile_cont(n_chars::double, 0.5), 4) from documents group by source""",
    "indexed_page": "select source || ':' || doc_id as id, doc_id, (select count(*) from documents) as total, page from (select *, row_number() over (order by doc_id, source) - 1 as n from documents) join (values (0, 0), (1, 60), (2, 150)) p(page, start) on n >= start and n < start + 40",
    "numeric_id_page": "select source || ':' || doc_id as id, doc_id, (select count(*) from documents) as total from documents order by doc_id, 1 limit 50 offset 100",
    "signature": """with p as (select item_id::varchar as id, sha256(text) as hash from benchmark), g as (select substr(md5(id), 1, 3) as part, sha256(to_json(list({'id': id, 'hash': hash} order by id, hash))::varchar) as h, count(*) as n from p group by 1)
select sha256(string_agg(h, chr(10) order by part, h)) as signature, sum(n)::bigint as count from g""",
    "last_turns": f"with {_TURNS} select * from (select *, (row_number() over (partition by conv_id order by turn desc))::int as place from c) where place <= 2",
    "conversation_titles": """with q as (select conv_id, trim(regexp_replace(min_by(text, turn), '\\s+', ' ', 'g')) as q from conversations where role = 'user' group by 1)
select conv_id, case when length(q) > 60 then rtrim(substr(q, 1, 57)) || '...' else q end as title from q""",
    "recent_conversations": "select conv_id, count(*) as messages, max(turn) as last_turn from conversations group by 1 order by last_turn desc, conv_id desc limit 20",
    "rate_window": "select event_id, count(*) over w as requests, (sum(1) over w)::bigint as tokens from (select *, epoch_us(ts) as us from events) window w as (partition by user_id order by us range between 3599999999 preceding and current row)",
    "daily_usage": "select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as requests, (2 * count(*))::bigint as tokens from events group by 1, 2",
    "hourly_windows": "select epoch(date_trunc('hour', ts))::bigint as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": """with o as (select user_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts) as before from events),
g as (select *, sum((before is null or us - before > 1800000000)::int) over (partition by user_id order by us rows unbounded preceding) as g from o)
select min(us) as start, max(us) + 1800000000 as stop, user_id, count(*) as n from g group by user_id, g""",
    "json_reply_parse": "select event_id, case when json_type(props::json, '$.k') in ('UBIGINT', 'BIGINT') then (props::json ->> '$.k')::bigint end as k from events",
    "scalar_functions": """with t as (select item_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark)
select item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as key, greatest(1, length(text) // 4)::int as tokens, false as refused, round(least(1, greatest(0, (length(text) / 1000 - 0.4) / (0.95 - 0.4))), 6) as width,
round(len(list_intersect(w, ['the', 'and', 'of'])) / greatest(len(w), 1), 6) as overlap from t""",
    "chunk_counts": "select source, count(*) as chunk_count from documents group by 1",
}
