"""Queries over the incremental index, the saved lexical index, retrieval modes, prompts, answers and histories."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import REFUSAL
from docloom.functions.providers import HashEmbedder, embed, extractive_generator, lexical_scorer
from docloom.functions.stemmer import STOP_WORDS
from docloom.io import shared_dir, table
from docloom.operators import conversations as C
from docloom.operators import signature as G
from docloom.operators import store as S
from docloom.operators.fusion import retrieve
from docloom.operators.lexical import bm25_search
from docloom.plans import answer as A
from docloom.plans import retrieval_queries as R
from docloom.plans.items import items, over_items
from docloom.streaming.rate import add_usage, daily_usage, over_quota


def _nation_files(spark: SparkSession, d: str, second: bool) -> DataFrame:
    """Files of a first and of a second run: some are gone, some are new, some have one more line."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    kept = n.where(k % 5 != 0) if second else n.where(k % 7 != 0)
    more = F.when((k % 3 == 0) & F.lit(second), F.lit("\nadded")).otherwise(F.lit(""))
    rows = kept.select(F.concat_ws("/", F.col("n_regionkey").cast("string"), F.concat("n_name", F.lit(".txt"))).alias("identity"), F.concat("n_name", F.lit(".txt")).alias("name"), F.concat(F.lit("first\n"), "n_name", more).alias("text"))
    return rows.withColumn("hash", F.sha2("text", 256))


def _one_chunk_a_line(files: DataFrame, embedder: HashEmbedder = HashEmbedder(8)) -> DataFrame:
    rows = files.select(F.col("name").alias("doc_name"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return rows.select(F.concat_ws(":", "doc_name", F.col("n").cast("string")).alias("id"), "doc_name", "text", F.lit(1).alias("page"), F.sha2("text", 256).alias("content_hash"), embed(F.col("text"), embedder).alias("embedding"))


def _document_files(spark: SparkSession, d: str, second: bool) -> DataFrame:
    """Documents as the files of a first and of a second run: some are gone, some are new, some have one more line."""
    kept = table(spark, d, "documents").where("doc_id % 5 <> 0" if second else "doc_id % 7 <> 0")
    text = "coalesce(text, '')" + (" || if(doc_id % 3 = 0, '\nadded', '')" if second else "")
    return kept.selectExpr("coalesce(source, 'none') || '/' || doc_id || '.txt' as identity", "doc_id || '.txt' as name", f"{text} as text", f"sha2({text}, 256) as hash")


def q_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the incremental index: the second parses new and changed files only; chunks, and what the run did."""
    store = S.ChunkStore(spark, f"{shared_dir(spark)}/docloom-store-{uuid.uuid4().hex}")
    store.index(_document_files(spark, d, False), _one_chunk_a_line)
    done = store.index(_document_files(spark, d, True), _one_chunk_a_line)
    lines = "sha2(array_join(transform(array_sort(collect_list(struct(cast(element_at(split(id, ':'), -1) as int) as n, text))), x -> x.text), '|'), 256) as lines"
    counters = [f"{getattr(done, c)}L as {c}" for c in ("documents", "chunks", "added", "updated", "skipped", "removed")]
    return store.chunks().groupBy("doc_name").agg(F.count("*").alias("chunk_count"), F.expr(lines)).selectExpr("*", *counters)


def q_versions(spark: SparkSession, d: str) -> DataFrame:
    """Every version of a store that was written, changed, cut down and compacted, read afterwards."""
    store = S.ChunkStore(spark, f"{shared_dir(spark)}/docloom-store-{uuid.uuid4().hex}")
    lines = lambda second: _document_files(spark, d, second).selectExpr("name as doc_name", "posexplode(split(text, '\n')) as (n, text)").selectExpr("doc_name || ':' || n as id", "doc_name", "text")
    names = lambda where: table(spark, d, "documents").where(where).selectExpr("doc_id || '.txt' as doc_name")
    store.write_documents(lines(False))
    changed = names("doc_id % 5 <> 0 and doc_id % 3 = 0")
    store.replace_documents(changed, lines(True).join(changed, "doc_name", "left_semi"))
    store.delete_documents(names("doc_id % 5 = 0"))
    store.compact()
    found = [(1, 1), (2, 2), (3, 3), (4, store.version())]
    each = [store.chunks(v).selectExpr(f"{n} as step", "count(distinct doc_name) as documents", "count(*) as chunks", "sum(cast(length(text) as bigint)) as chars") for n, v in found]
    return reduce(DataFrame.unionByName, each)


def q_signature(spark: SparkSession, d: str) -> DataFrame:
    """The signature of documents after some came, went and changed, from the rows that did so alone."""
    docs = table(spark, d, "documents")
    before = "doc_id % 7 <> 0"
    rows = lambda where, text: docs.where(where).selectExpr("doc_id", f"sha2({text}, 256) as h")
    new = rows("doc_id % 5 <> 0 and (doc_id % 7 = 0 or doc_id % 3 = 0)", "text || if(doc_id % 3 = 0, '+', '')")
    old = rows(f"{before} and (doc_id % 5 = 0 or doc_id % 3 = 0)", "text")
    parts = [G.signature_parts(x, "doc_id", "h") for x in (rows(before, "text"), new, old)]
    return G.follow(*parts).selectExpr("part", "cast(n as bigint) as n", *[f"cast({s} as string) as {s}" for s in G.LANES])


def q_stop_words(spark: SparkSession, d: str) -> DataFrame:
    """Search without the index's stop words, in postings that were saved and loaded."""
    index = R.saved_index(spark, d, STOP_WORDS)
    return bm25_search(index, R._asked_text(spark, d), R.K, stop_words=STOP_WORDS, stemmed=False, digits=R.DIGITS).withColumnRenamed("vec_id", "doc_id")


def q_dense_mode(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve(table(spark, d, "embeddings"), R._queries(spark, d), 5, "vec_id", "embedding", mode="dense")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def q_reranked(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval of a larger pool, ordered anew by the share of the question's words that a text has."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    chunks = table(spark, d, "embeddings").select("vec_id", "embedding").join(texts.select("vec_id"), "vec_id", "left_semi")
    found = retrieve(chunks, R._queries(spark, d), 5, "vec_id", "embedding", mode="hybrid", index=R.saved_index(spark, d), reranker=lexical_scorer, texts=texts, stemmed=False, stop_words=(), digits=R.DIGITS)
    return found.select("query_id", F.col("vec_id").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), "rank")


def q_refused(spark: SparkSession, d: str) -> DataFrame:
    """Questions to an empty store: every answer is the refusal, and no model is called."""

    def never(prompt: str, model: str) -> str:
        raise AssertionError("a model was called")

    empty = _one_chunk_a_line(_nation_files(spark, d, False)).where("false")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    found = A.ask(asked, empty, None, HashEmbedder(8), never, settings=R.Settings(retrieval_mode="dense"))
    return found.select("question_id", "answer", "refused", "model", F.size("sources").alias("n_sources"))


def q_grounded(spark: SparkSession, d: str) -> DataFrame:
    """Questions that are lines of the store: the best source is the line itself, and the answer cites it."""
    chunks = _one_chunk_a_line(_nation_files(spark, d, False), _Letters(512)).where("text <> 'first'")
    asked = table(spark, d, "nation").where("n_nationkey % 7 <> 0").select(F.col("n_nationkey").cast("long").alias("question_id"), F.lower("n_name").alias("question"))
    found = A.ask(asked, chunks, None, _Letters(512), extractive_generator, limit=1, settings=R.Settings(retrieval_mode="dense"))
    return found.select("question_id", "answer", "refused", F.size("sources").alias("n_sources"))


class _Letters(HashEmbedder):
    """Words without their prefix, so that a line and a question of the same word have one direction."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return super().__call__([t.split(": ")[-1] for t in texts])


def q_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of answers and of rewriting, from every completed turn."""
    turns = C.completed_turns(table(spark, d, "conversations"))
    history = F.array(*[F.struct(F.concat(F.lit(str(i)), "question").alias("question"), F.col("answer")) for i in range(3)])
    prompt = A.prompt_of(F.col("question"), A.blocks_of(F.array("answer", "question")))
    return turns.select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt"), F.sha2(A.rewrite_prompt(F.col("question"), history), 256).alias("rewrite"))


def q_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of a model's rewriting: quotes go, the first line stays, and bad replies give the question back."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    reply = F.when(k % 6 == 0, F.concat(F.lit(' "'), name, F.lit('" \nmore'))).when(k % 6 == 1, F.concat(F.lit("\n\n  "), name)).when(k % 6 == 2, F.repeat(name, 99)).when(k % 6 == 3, F.lit("  ")).when(k % 6 == 4, F.concat(F.lit("'"), name, F.lit('"')))
    return items(spark, d).select("n_nationkey", A.rewritten(F.lit("asked"), reply).alias("search"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    """Stored conversations; some are invalid and some ids are stored twice."""
    c = table(spark, d, "conversations")
    own = c.groupBy("conv_id").agg(F.max("turn").alias("last"), F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("messages"))
    k = F.col("conv_id")
    rows = own.select(F.when(k % 9 == 0, F.lit("")).otherwise((k - k % 2).cast("string")).alias("id"), F.lit("t").alias("title"), k.alias("created_at"), F.when(k % 11 != 0, F.col("last") * 100000 + k).alias("updated_at"), F.when(k % 5 == 0, F.slice("messages", 1, 0)).otherwise(F.col("messages")).alias("messages"), k.alias("place"))
    return rows


def q_history(spark: SparkSession, d: str) -> DataFrame:
    """The history that is loaded: valid conversations, the first of an id, the latest ones."""
    return C.load_history(_history(spark, d)).select("id", "updated_at", F.size("messages").alias("n_messages"))


def q_history_saved(spark: SparkSession, d: str) -> DataFrame:
    """What is kept after one conversation was changed and others deleted."""
    h = C.load_history(_history(spark, d), None)
    new = h.where("try_cast(id as long) % 4 = 0").withColumn("updated_at", F.lit(10**12) + F.col("place"))
    left = C.delete(C.upsert_front(h, new, None), h.where("try_cast(id as long) % 6 = 0").select("id"))
    return C.save_history(left).select("id", "updated_at")


def q_over_quota(spark: SparkSession, d: str) -> DataFrame:
    """Users and days whose next request would pass a daily limit."""
    usage = daily_usage(table(spark, d, "events").withColumn("amount", F.lit(3)), "user_id", "ts", "amount")
    return over_quota(usage, 5, 12, 6).where("stop").select("user_id", "day", "requests", "tokens")


def q_usage_table(spark: SparkSession, d: str) -> DataFrame:
    """A usage table that two batches of events were added to."""
    e = table(spark, d, "events").withColumn("amount", F.lit(1))
    path = f"{shared_dir(spark)}/docloom-usage-{uuid.uuid4().hex}"
    add_usage(e.where("event_id % 2 = 0"), path, "event_type", "ts", "amount")
    return add_usage(e.where("event_id % 2 = 1"), path, "event_type", "ts", "amount")


def q_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a list of ids (some unknown), in the order of the list."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    ids = docs.selectExpr("doc_id * 3 - 7 as doc_id", "-doc_id as place")
    return S.in_order(S.by_ids(docs, ids, "doc_id"), ids, "doc_id")


QUERIES = {
    "index_refresh": q_refresh, "store_versions": q_versions, "followed_signature": q_signature, "stop_word_search": q_stop_words, "dense_mode": q_dense_mode, "reranked_search": q_reranked, "refused_answers": q_refused, "grounded_answers": q_grounded, "answer_prompts": q_prompts, "rewritten_questions": q_rewritten,
    "history_loaded": q_history, "history_saved": q_history_saved, "over_quota": q_over_quota, "usage_table": q_usage_table, "rows_by_ids": q_by_ids,
}

_STOPPED = R._BM25.replace("select doc_id, unnest(regexp_extract_all(lower(text), '" + R.TOKENS + "')) as term from documents", "select * from (select doc_id, unnest(regexp_extract_all(lower(text), '" + R.TOKENS + f"')) as term from documents) where term not in {STOP_WORDS}").replace(
    "coalesce(len(regexp_extract_all(lower(text), '" + R.TOKENS + "')), 0) as dl", "coalesce(len(list_filter(regexp_extract_all(lower(text), '" + R.TOKENS + f"'), lambda w: w not in {STOP_WORDS})), 0) as dl"
)  # the query's stop words have no postings, so they need not go
_TURNS = "t as (select *, lead(role) over o as nr, lead(text) over o as answer from conversations window o as (partition by conv_id order by turn)), c as (select conv_id, turn, text as question, answer from t where role = 'user' and nr = 'assistant')"
_HIST = """s as (select conv_id as k, max(turn) as last, count(*) as n, bool_and(coalesce(role in ('user', 'assistant'), false)) as good from conversations group by 1),
v as (select (k - k % 2)::varchar as id, last * 100000 + k as updated_at, case when k % 5 = 0 then 0 else n end as n, k from s where k % 9 <> 0 and k % 11 <> 0 and (good or k % 5 = 0)),
f as (select * from (select *, row_number() over (partition by id order by k) as p from v) where p = 1)"""
ORACLES = {
    "index_refresh": """with o as (select doc_id as k, coalesce(text, '') || case when doc_id % 3 = 0 then chr(10) || 'added' else '' end as t from documents),
s as (select count(*) filter (k % 5 <> 0) as documents, sum(case when k % 5 <> 0 then len(string_split(t, chr(10))) end)::bigint as chunks, count(*) filter (k % 5 <> 0 and k % 7 = 0) as added,
  count(*) filter (k % 5 <> 0 and k % 7 <> 0 and k % 3 = 0) as updated, count(*) filter (k % 5 <> 0 and k % 7 <> 0 and k % 3 <> 0) as skipped, count(*) filter (k % 5 = 0 and k % 7 <> 0) as removed from o)
select k || '.txt' as doc_name, len(string_split(t, chr(10)))::bigint as chunk_count, sha256(replace(t, chr(10), '|')) as lines, s.* from o, s where k % 5 <> 0""",
    "store_versions": """with o as (select doc_id as k, coalesce(text, '') as t, coalesce(text, '') || case when doc_id % 3 = 0 then chr(10) || 'added' else '' end as u from documents),
v as (select 1 as step, k, t from o where k % 7 <> 0
  union all select s.step, k, case when k % 5 <> 0 and k % 3 = 0 then u else t end from o, (values (2), (3), (4)) s(step) where (k % 7 <> 0 or k % 5 <> 0 and k % 3 = 0) and (s.step = 2 or k % 5 <> 0))
select step, count(*) as documents, sum(len(string_split(t, chr(10))))::bigint as chunks, sum(length(t) - len(string_split(t, chr(10))) + 1)::bigint as chars from v group by step""",
    "followed_signature": f"""with o as (select doc_id as k, sha256(text || case when doc_id % 3 = 0 then '+' else '' end) as h from documents where doc_id % 5 <> 0),
r as (select substr(md5(k::varchar), 1, 2) as part, sha256('k' || k || chr(9) || coalesce('h' || h, 'n')) as r from o)
select part, count(*) as n, {', '.join(f"sum(('0x' || substr(r, {15 * i + 1}, 15))::bigint)::varchar as {s}" for i, s in enumerate(G.LANES))} from r group by part""",
    "stop_word_search": f"with {R._ASKED_TEXT}, {_STOPPED} select query_id, doc_id, score, rank from sparse_ranked where rank < 20",
    "dense_mode": f"with {R._ASKED_BOTH}, {R._DENSE.replace('round(coalesce(list_dot_product(a.e, v.e) / nullif(a.n * v.n, 0), 0), 6)', 'coalesce(list_dot_product(a.e, v.e) / nullif(a.n * v.n, 0), 0)')} select query_id, vec_id, round(score, 6) as score, rank from dense_ranked where rank < 5",
    "reranked_search": f"""with {R._ASKED_BOTH}, {R._DENSE.replace('from embeddings)', 'from embeddings where vec_id in (select doc_id from documents))')}, {R._BM25}, {R._FUSED.format(digits=6)},
kept as (select f.query_id, f.doc_id, f.rank from fused f join dense_all x on x.query_id = f.query_id and x.vec_id = f.doc_id where f.rank < 40),
w as (select k.*, list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]+')) as q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) as t from kept k join asked a using (query_id) join documents d using (doc_id)),
s as (select *, len(list_intersect(q, t)) / greatest(len(q), 1) as score from w)
select query_id, doc_id, round(score, 6) as rerank_score, p as rank from (select *, row_number() over (partition by query_id order by score desc, rank) - 1 as p from s) where p < 5""",
    "refused_answers": f"select item_id as question_id, '{REFUSAL}' as answer, true as refused, 'llama3.2' as model, 0 as n_sources from benchmark",
    "grounded_answers": "select n_nationkey::bigint as question_id, n_name || ' [S1]' as answer, false as refused, 1 as n_sources from nation where n_nationkey % 7 <> 0",
    "answer_prompts": f"""with {_TURNS} select conv_id, turn, sha256('CONTEXT' || chr(10) || '[S1]' || chr(10) || answer || chr(10) || '[/S1]' || chr(10) || chr(10) || '[S2]' || chr(10) || question || chr(10) || '[/S2]' || chr(10) || chr(10) || 'QUESTION' || chr(10) || question || chr(10) || chr(10) || 'INSTRUCTION' || chr(10) || '{A.GROUNDING}{REFUSAL}') as prompt,
sha256('CONTEXT' || chr(10) || 'QUESTION' || chr(10) || '1' || question || chr(10) || chr(10) || 'ANSWER' || chr(10) || answer || chr(10) || chr(10) || 'QUESTION' || chr(10) || '2' || question || chr(10) || chr(10) || 'ANSWER' || chr(10) || answer || chr(10) || chr(10) || 'QUESTION' || chr(10) || question || chr(10) || chr(10) || 'INSTRUCTION' || chr(10) || '{A.REWRITE}') as rewrite from c""",
    "rewritten_questions": """select n_nationkey, case n_nationkey % 6 when 0 then n_name when 1 then n_name when 4 then '''' || n_name || '"' else 'asked' end as search from nation""",
    "history_loaded": f"with {_HIST} select id, updated_at, n::int as n_messages from f order by updated_at desc, k limit 20",
    "history_saved": f"""with {_HIST}, l as (select id, case when id::bigint % 4 = 0 then 1000000000000 + k else updated_at end as u, case when id::bigint % 4 = 0 then n else n end as n from f) select id, u as updated_at from l where n > 0 and id::bigint % 6 <> 0 order by u desc limit 20""",
    "over_quota": "select * from (select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as requests, (3 * count(*))::bigint as tokens from events group by 1, 2) where tokens + 5 >= 12 or requests >= 6",
    "usage_table": "select event_type, strftime(ts, '%Y-%m-%d') as day, count(*)::bigint as requests, count(*)::bigint as tokens from events group by 1, 2",
    "rows_by_ids": "select d.doc_id, d.lang, -a.doc_id as place from documents a join documents d on d.doc_id = a.doc_id * 3 - 7",
}
ORACLES["rewritten_questions"] = over_items(ORACLES["rewritten_questions"])
