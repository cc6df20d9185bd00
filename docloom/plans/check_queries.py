"""Queries over dataset checks, judgments, run files and alert reports, on rows made from the given tables by fixed rules."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import judge as J
from docloom.io import shared_dir, table
from docloom.operators import alerts as A
from docloom.operators import evaluation as V
from docloom.operators import store as S
from docloom.plans import evaluate as E
from docloom.plans.items import items, over_items
from docloom.plans import reports as P
from docloom.plans.alert_queries import _events, judged, rankings
from docloom.plans.evaluation_queries import results


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """One page a benchmark item: its text, with a printed page number on some."""
    b, k = table(spark, d, "benchmark"), F.col("item_id")
    return b.select(F.concat(F.lit("d"), k % 5).alias("document"), k.cast("int").alias("page_index"), F.concat("text", F.when(k % 3 == 0, F.concat(F.lit(" p. "), k)).otherwise(F.lit(""))).alias("text"), k.alias("item_id"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for each item: its page's text, with another word at the end of some, another page for others."""
    k = F.col("item_id")
    text = F.concat("text", F.when(k % 7 == 0, " zzunknownword").otherwise(F.lit("")))
    return _pages(spark, d).select(F.concat(F.lit("q"), F.floor(k / 2)).alias("question_id"), (k % 2).cast("int").alias("evidence_index"), k.alias("key"), "document", F.when(k % 11 == 0, F.lit(-5)).otherwise(F.col("page_index")).alias("page_index"), F.when(k % 2 == 0, k.cast("string")).alias("printed_page"), text.alias("text"))


def q_evidence_match(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved chunks that hold a piece of evidence: same document, page if known, and nearly all its words."""
    k = F.col("item_id")
    own = _pages(spark, d).select(F.concat(F.lit("q"), F.floor(k / 2)).alias("question_id"), F.concat(F.lit("c"), k).alias("chunk_id"), "document", F.when(k % 4 != 0, F.col("page_index") + 1).alias("page"), F.when(k % 5 == 1, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("text"))
    return V.match_evidence(_evidence(spark, d), own).withColumn("recall", F.round("recall", 6))


def q_evidence_pages(spark: SparkSession, d: str) -> DataFrame:
    return V.verify_evidence(_evidence(spark, d), _pages(spark, d).drop("item_id")).select("key", "reason")


def q_evidence_index(spark: SparkSession, d: str) -> DataFrame:
    """Evidence whose indexed page lacks some of its words, or is absent."""
    p = _pages(spark, d)
    half = F.floor(F.length("text") / 2).cast("int")
    chunks = p.select("document", (F.col("page_index") + 1).alias("page"), F.explode(F.array(F.struct(F.lit(1).alias("number"), F.col("text").substr(F.lit(1), half).alias("text")), F.struct(F.lit(2).alias("number"), F.col("text").substr(half + 1, F.length("text")).alias("text")))).alias("c")).select("document", "page", "c.*")
    return V.verify_index(_evidence(spark, d), chunks).select("key", F.coalesce(F.array_join("missing", " "), F.lit("no page")).alias("missing"))


def _manifests(n: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    manifest = n.select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("hash"), k.alias("page_count"))
    files = n.where(k % 5 != 0).select(F.col("n_name").alias("path"), F.when(k % 4 == 0, F.lit("old")).otherwise(F.sha2("n_name", 256)).alias("hash"), F.when(k % 3 == 0, k + 1).otherwise(k).alias("page_count"))
    return manifest, files, n.where(k % 7 != 0).select(F.col("n_name").alias("path"))


def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    return V.verify_manifest(*_manifests(items(spark, d)))


def q_identity(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which a corpus manifest and the live index differ."""
    n, k = items(spark, d), F.col("n_nationkey")
    live = n.where(k % 6 != 0).select(F.col("n_name").alias("doc_name"), (k + (k % 4 == 0).cast("int")).alias("chunk_count"))
    return E.corpus_identity(n.where(k % 5 != 0).select(F.col("n_name").alias("doc_name"), k.alias("chunk_count")), live)


def q_dataset(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a dataset at once: how many findings each check has."""
    k = F.col("n_nationkey")
    questions = table(spark, d, "nation").select(k.cast("string").alias("id"), F.concat(F.lit("Which of the chapters tells of the country number "), F.when(k % 8 == 0, F.lit("0?")).otherwise(F.concat(k, F.lit("?")))).alias("question"))
    p = _pages(spark, d)
    chunks = p.select("document", (F.col("page_index") + 1).alias("page"), F.lit(1).alias("number"), "text")
    manifest, files, _ = _manifests(table(spark, d, "nation"))
    found = E.validate_dataset(questions.where("cast(id as int) % 8 = 0"), _evidence(spark, d), p.drop("item_id"), chunks, manifest, files)
    return found.groupBy("check").agg(F.count("*").alias("n"))


def q_unique(spark: SparkSession, d: str) -> DataFrame:
    """Rules that questions break: repeated answers, claims or evidence, wrong numbers of claims."""
    k = F.col("n_nationkey")
    claim = lambda i, t: F.struct(F.lit(i).alias("id"), t.alias("text"))
    place = lambda i: F.struct(F.col("n_name").alias("document_path"), i.alias("pdf_page_index"), F.lit("t").alias("text"))
    second = F.when(k % 3 == 0, claim("a", F.lit("two"))).otherwise(claim("b", F.when(k % 5 == 0, F.lit(" ONE!")).otherwise(F.lit("two"))))
    q = F.struct(F.lit("x").alias("answer"), F.when(k % 2 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("acceptable_answers"), F.when(k % 7 == 0, F.array(claim("a", F.lit("one")))).otherwise(F.array(claim("a", F.lit("one")), second)).alias("claims"), F.array(place(k), place(k - k % 4)).alias("evidence"), F.when(k % 2 == 1, "direct").otherwise("list").alias("question_type"))
    return items(spark, d).select("n_nationkey", q.alias("q")).select("n_nationkey", F.array_join(V.unique_content("q"), ",").alias("broken"))


def q_sources(spark: SparkSession, d: str) -> DataFrame:
    return V.questions_per_source(_evidence(spark, d))


def q_near(spark: SparkSession, d: str) -> DataFrame:
    """Questions of conversations, each third again with other words and marks in it: pairs that are nearly the same."""
    k = F.col("n_nationkey")
    base = F.concat_ws(" ", F.lit("Which chapter tells of the rules for"), F.reverse(F.md5(k.cast("string"))), F.lit("and who checks them"))
    n = table(spark, d, "nation").select(k.alias("id"), base.alias("text"))
    again = n.where("id % 3 = 0").select((F.col("id") + 100).alias("id"), F.concat(F.upper("text"), F.lit("!?")).alias("text"))
    close = n.where("id % 4 = 1").select((F.col("id") + 200).alias("id"), F.regexp_replace("text", "who checks", "who then checks").alias("text"))
    return V.near_questions(n.unionByName(again).unionByName(close), "id", "text").select("key_a", "key_b", (F.col("ratio") == 1.0).alias("same"))


def q_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The best of several references' scores (the first of equal ones), for both kinds of similarity."""
    k = F.col("doc_id")
    scores = F.array((k % 7) / 10, (k % 5) / 10, (k % 7) / 10)
    names = F.array(*map(F.lit, "abc"))
    parts = F.transform(scores, lambda s: F.struct((s / 2).alias("precision"), (s / 3).alias("recall"), s.alias("f1")))
    own = table(spark, d, "documents").select("doc_id", V.answer_similarity(scores, names, 0.4).alias("a"), E.bert_similarity(parts, names, 0.5).alias("b"))
    return own.select("doc_id", F.round("a.score", 6).alias("score"), F.col("a.passed").alias("passed"), F.col("a.selected_reference").alias("reference"), F.round("b.precision", 6).alias("precision"), F.col("b.passed").alias("bert_passed"), F.col("b.selected_reference_index").alias("bert_index"))


def q_configs(spark: SparkSession, d: str) -> DataFrame:
    """Saved settings against asked ones, ids and times aside; and a row's total time after its judge ran again."""
    k = F.col("n_nationkey")
    saved = F.create_map(F.lit("model"), F.col("n_name"), F.lit("run_id"), F.lit("1"), F.lit("k"), F.lit("5"))
    asked = F.create_map(F.lit("k"), F.when(k % 3 == 0, "6").otherwise("5"), F.lit("created_at"), F.lit("now"), F.lit("model"), F.col("n_name"))
    return items(spark, d).select("n_nationkey", V.configs_match(saved, asked).alias("same"), V.retried_latency(k * 2.0, F.when(k % 2 == 0, k * 3.0), F.lit(1.5)).alias("total"))


def q_serialized(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved chunks as results hold them: ranks from 1, the first five used, matched evidence."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    found = n.select(F.col("n_regionkey").cast("string").alias("query_id"), F.col("n_name").alias("id"), F.floor(k / 3).cast("int").alias("rank"), (k / 10).alias("score"))
    chunks = n.select(F.col("n_name").alias("id"), F.lit("doc").alias("doc_name"), F.lit(None).cast("string").alias("section"), k.alias("page"), F.lit(None).cast("string").alias("control_id"), F.col("n_name").alias("text"))
    matched = n.where(k % 4 == 0).select(F.col("n_regionkey").cast("string").alias("question_id"), F.col("n_name").alias("chunk_id"), F.explode(F.array(k, k - 1)).alias("evidence_index"))
    own = E.serialize_chunks(found, chunks, matched)
    return own.select("question_id", F.explode("retrieved_chunks").alias("c")).select("question_id", "c.rank", "c.id", "c.used_for_generation", F.array_join(F.transform("c.matched_evidence_indices", lambda x: x.cast("string")), ",").alias("matched"))


def _judgment(score: str, verdict: str, extra: str = "") -> str:
    part = lambda lists="": '{"score": ' + score + ', "justification": "j"' + lists + "}"
    return '{"verdict": "' + verdict + '", "relevance": ' + part() + ', "correctness": ' + part() + ', "completeness": ' + part(', "missing_claim_ids": ["c1"]') + ', "faithfulness": ' + part(', "unsupported_claims": [], "contradicted_claims": []') + extra + "}"


REPLIES = (_judgment("3", "pass"), _judgment('"2"', "fail"), _judgment("1.0", "partial"), _judgment("5", "pass"), _judgment("3", "maybe"), _judgment("3", "pass", ', "more": 1'), "no json", _judgment("true", "pass"), "[]", _judgment("2.5", "pass"))


def q_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Judgments of replies of every kind: numbers in strings and whole floats count, other keys and ranges do not."""
    reply = F.get(F.array(*map(F.lit, REPLIES)), F.col("n_nationkey") % len(REPLIES))
    own = items(spark, d).select("n_nationkey", J.judgment_json(reply).alias("j"))
    return own.select("n_nationkey", F.get_json_object("j", "$.verdict").alias("verdict"), F.get_json_object("j", "$.correctness.score").cast("int").alias("score"), F.sha2("j", 256).alias("json_hash"))


def q_judged(spark: SparkSession, d: str) -> DataFrame:
    """Rows judged with a cache: known payloads are not sent, each other one once; failures are told."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    rows = n.select("n_nationkey", F.concat(F.lit("p"), k % 10).alias("payload"))
    cache = n.where(k < 3).select(F.sha2(F.concat(F.lit("p"), k), 256).alias("cache_key"), F.lit(REPLIES[0]).alias("raw_response"))

    def request(payload: str) -> str:
        if payload.startswith("p9"):
            raise ValueError("no")
        return REPLIES[0] if "REPAIR" in payload or payload < "p6" else "?"

    found = J.judge_rows(rows, cache, request)
    fresh = J.new_cache_rows(found).count()
    return found.select("n_nationkey", "cache_hit", F.col("judgment.verdict").alias("verdict"), "error", F.lit(fresh).alias("new_rows"))


def q_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Severity verdicts of replies made from events."""
    k = F.col("alert_id")
    score = F.when(k % 5 == 0, F.lit('"0.25"')).when(k % 7 == 0, F.lit("1.5")).otherwise(F.lit("0.5"))
    text = F.concat(F.lit('{"score": '), score, F.lit(', "reasoning": "'), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("event_type")), F.lit('"'), F.when(k % 11 == 0, F.lit(', "x": 1')).otherwise(F.lit("")), F.lit("}"))
    return _events(spark, d).select("alert_id", A.parse_verdict(text).alias("v")).select("alert_id", "v.score", "v.reasoning")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("alert_id")
    return _events(spark, d).select("alert_id", F.struct(k.alias("alert_id"), F.col("event_type").alias("alert_message"), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("class")).alias("classification"), F.when(k % 5 != 0, F.lit("TCP")).alias("protocol"), F.lit("http").alias("service"), k.alias("sid"), F.lit(1).alias("gid"), F.lit(2).alias("rev"), F.lit("r").alias("rule_id")).alias("alert"), "event_type", "user_id", "priority")


def q_alert_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Queries, redacted records and evidence blocks of alerts."""
    chunk = F.struct(F.col("event_type").alias("document"), F.col("user_id").cast("string").alias("text"))
    return _alerts(spark, d).select("alert_id", A.alert_query(F.col("alert")).alias("query"), F.sha2(A.redacted(F.col("alert")), 256).alias("record"), A.evidence_blocks(F.array(chunk, chunk)).alias("blocks"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a ranking session: attempts, reasons why a reply ended, parsed fields, chunks."""
    k = F.col("alert_id")
    return _events(spark, d).select(
        F.when(k % 2 == 0, "a").otherwise("b").alias("model"), "alert_id", "event_type", "priority", F.when(k % 9 == 0, "failed").otherwise("ok").alias("status"), F.array_repeat(F.lit(1), (k % 3).cast("int")).alias("attempts"), F.array_repeat(F.when(k % 4 == 0, "length").otherwise("stop"), (1 + k % 2).cast("int")).alias("done_reasons"),
        F.when(k % 9 != 0, F.struct(F.array(F.lit("Priority"), F.when(k % 6 == 1, F.lit("sev-erity")).otherwise(F.lit("source_ip"))).alias("metrics_used"))).alias("parsed"), F.array_repeat(F.lit("c"), F.when(k % 13 == 0, 2).otherwise(3)).alias("chunks"), F.when(k % 3 != 0, k).alias("matched_sid"),
    )


def _chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("alert_id")
    e = _events(spark, d)
    return e.select(F.when(k % 2 == 0, "a").otherwise("b").alias("model"), "alert_id", F.explode(F.sequence(F.lit(0), k % 4)).alias("i")).select("model", "alert_id", F.when((k + F.col("i")) % 3 == 0, "ISO 1").when((k + F.col("i")) % 3 == 1, "NIST").otherwise("CIS").alias("document"), F.when(F.col("i") > 0, F.col("i") / 4).alias("score"), F.when(F.col("i") == 2, "AC-1").alias("control_id"))


def q_spot(spark: SparkSession, d: str) -> DataFrame:
    rows = rankings(spark, d).withColumn("text", F.concat(F.col("event_type"), F.lit(" score "), F.col("alert_id") % 10, F.lit(".0")))
    return A.spot_check(rows, "text", "error score 1", 1)


def q_sid(spark: SparkSession, d: str) -> DataFrame:
    rows = _sessions(spark, d).select("model", A.sid_match(F.col("matched_sid"), F.col("alert_id") - F.col("alert_id") % 2).alias("hit"))
    return rows.groupBy("model").agg(F.count_if("hit").alias("matched"), F.count("hit").alias("attempted"))


def q_merged(spark: SparkSession, d: str) -> DataFrame:
    """Rankings with their alerts and judgments; what is doubled is told."""
    rows = rankings(spark, d).select("model", "alert_id", "rank")
    sample = _events(spark, d).where("alert_id % 3 = 0").select("alert_id", "event_type")
    return P.merged_alerts(rows, sample, judged(spark, d)).select("model", "alert_id", "rank", "event_type", F.round("judge_score", 6).alias("judge_score"), "judge_reasoning")


def q_session_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as one JSON folder a model and read back."""
    path = _folder(spark, "models")
    P.per_model_json(rankings(spark, d).select("model", "alert_id", "rank"), path)
    return spark.read.schema("alert_id long, rank int, model string").json(path).groupBy("model").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))


def q_result_files(spark: SparkSession, d: str) -> DataFrame:
    """A run's files: rows appended as JSON lines, replaced as a whole, and the summary and detail tables as CSV, all read back."""
    path = _folder(spark, "run")
    rows = results(spark, d)
    for part in (0, 1):
        P.append_jsonl(rows.where(F.col("question_id").cast("long") % 2 == part), f"{path}/rows")
    P.write_snapshot(rows.where("false"), f"{path}/snapshot")
    P.write_snapshot(rows.select("question_id", "candidate_model"), f"{path}/snapshot")
    P.write_csv(V.summarize(rows).select("candidate_model", "evaluated_questions"), f"{path}/summary")
    P.write_csv(V.flatten_results(rows), f"{path}/detail")
    read = lambda name: spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/{name}")
    found = [
        spark.read.schema(rows.schema).json(f"{path}/rows").selectExpr("'rows' as kind", "question_id as key", "concat_ws('|', question, candidate_model, generated_answer, retrieved_chunks[0].rank, metrics.llm_judge.judgment.verdict, size(errors)) as value"),
        spark.read.parquet(f"{path}/snapshot").selectExpr("'snapshot' as kind", "question_id as key", "candidate_model as value"),
        read("summary").selectExpr("'summary' as kind", "candidate_model as key", "evaluated_questions as value"),
        read("detail").selectExpr("'detail' as kind", "question_id as key", "concat_ws('|', question, candidate_model, judge_verdict, gold_claims, generation_config) as value"),
    ]
    return reduce(DataFrame.unionByName, found)


def q_one_run(spark: SparkSession, d: str) -> DataFrame:
    """The questions that stand twice in a run that some rows were appended to again, under the one run of all rows."""
    rows = results(spark, d)
    both = rows.unionByName(rows.where("cast(question_id as bigint) % 4 = 0"))
    return A.duplicate_keys(both, "run_id", "question_id").withColumn("run", F.lit(A.single_value(both, "run_id")))


QUERIES = {
    "evidence_match": q_evidence_match, "evidence_pages": q_evidence_pages, "evidence_index": q_evidence_index, "manifest_check": q_manifest, "corpus_identity": q_identity, "dataset_check": q_dataset, "question_rules": q_unique, "questions_per_source": q_sources, "near_questions": q_near,
    "reference_scores": q_similarity, "saved_settings": q_configs, "result_chunks": q_serialized, "judgment_replies": q_judgments, "judged_rows": q_judged, "severity_verdicts": q_verdicts, "alert_prompts": q_alert_prompts,
    "done_reasons": lambda s, d: A.done_reasons(_sessions(s, d)), "failed_and_retried": lambda s, d: A.failed_and_retried(_sessions(s, d)), "unknown_fields": lambda s, d: A.unknown_metrics(_sessions(s, d)), "short_evidence": lambda s, d: A.short_evidence(_sessions(s, d)).select("alert_id", F.size("chunks").alias("n")),
    "documents_per_alert": lambda s, d: A.documents_per_alert(_chunk_rows(s, d)), "evidence_scores": lambda s, d: A.evidence_scores(_chunk_rows(s, d)).withColumn("mean", F.round("mean", 6)), "spot_check": q_spot, "sid_matches": q_sid, "merged_alerts": q_merged,
    "session_files": q_session_files, "result_files": q_result_files, "one_run": q_one_run, "known_documents": lambda s, d: S.by_ids(items(s, d).selectExpr("n_name as doc", "n_regionkey"), items(s, d).selectExpr("'NATION_' || (n_nationkey * 2) as doc"), "doc"),
}

_P = "p as (select item_id as k, 'd' || (item_id % 5) as document, item_id::int as page_index, text || case when item_id % 3 = 0 then ' p. ' || item_id else '' end as text from benchmark)"
_EV = f"{_P}, e as (select 'q' || (k // 2) as question_id, (k % 2)::int as evidence_index, k, document, case when k % 11 = 0 then -5 else page_index end as page_index, case when k % 2 = 0 then k::varchar end as printed, text || case when k % 7 = 0 then ' zzunknownword' else '' end as text from p)"
_LEX = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_EK = "e as (select event_id as k, event_type, user_id, case event_type when 'error' then 1 when 'click' then 2 else 3 end as priority from events)"
_GOOD = '{"completeness":{"justification":"j","missing_claim_ids":["c1"],"score":#},"correctness":{"justification":"j","score":#},"faithfulness":{"contradicted_claims":[],"justification":"j","score":#,"unsupported_claims":[]},"relevance":{"justification":"j","score":#},"verdict":"@"}'
_RECORD = "'{' || chr(10) || '  \"alert_id\" : ' || k || ',' || chr(10) || '  \"alert_message\" : \"' || event_type || '\",' || chr(10) || '  \"classification\" : \"' || case when k % 3 = 0 then '' else 'class' end || '\",' || chr(10) || case when k % 5 <> 0 then '  \"protocol\" : \"TCP\",' || chr(10) else '' end || '  \"service\" : \"http\"' || chr(10) || '}'"
ORACLES = {
    "evidence_match": f"""with {_EV}, c as (select 'q' || (k // 2) as question_id, 'c' || k as chunk_id, document, case when k % 4 <> 0 then page_index + 1 end as page, case when k % 5 = 1 then substr(text, 1, 20) else text end as text from p),
m as (select e.question_id, evidence_index, chunk_id, list_distinct({_LEX.format("e.text")}) as t, {_LEX.format("c.text")} as u from e join c on e.question_id = c.question_id and e.document = c.document and (page is null or page = page_index + 1))
select question_id, evidence_index, chunk_id, round(len(list_intersect(t, u)) / len(t), 6) as recall from m where len(list_intersect(t, u)) / len(t) >= 0.9""",
    "evidence_pages": f"""with {_EV}, m as (select e.k as key, case when p.k is null then 'no such page' when not contains({_FLAT.format("p.text")}, {_FLAT.format("e.text")}) then 'text is not on the page'
  when printed is not null and not regexp_matches(' ' || p.text || ' ', '[^A-Za-z0-9_]' || printed || '[^A-Za-z0-9_]') then 'printed page is not on the page' end as reason from e left join p on p.document = e.document and p.page_index = e.page_index)
select key, reason from m where reason is not null""",
    "evidence_index": f"with {_EV} select e.k as key, case when p.k is null then 'no page' else 'zzunknownword' end as missing from e left join p on p.document = e.document and p.page_index = e.page_index where p.k is null or e.k % 7 = 0",
    "manifest_check": """select n_name as path, case when n_nationkey % 5 = 0 then 'no file' when n_nationkey % 4 = 0 then 'hash differs' when n_nationkey % 3 = 0 then 'page count differs' else 'not indexed' end as reason from nation
where n_nationkey % 5 = 0 or n_nationkey % 4 = 0 or n_nationkey % 3 = 0 or n_nationkey % 7 = 0""",
    "corpus_identity": """with a as (select n_name, n_nationkey as n from nation where n_nationkey % 5 <> 0), b as (select n_name, n_nationkey + (n_nationkey % 4 = 0)::int as n from nation where n_nationkey % 6 <> 0)
select coalesce(a.n_name, b.n_name) as doc_name, a.n as expected, b.n as stored from a full join b using (n_name) where a.n is distinct from b.n""",
    "dataset_check": f"""with {_EV}, pages as (select e.k, p.k as page, p.text as pt, e.text as et, printed from e left join p on p.document = e.document and p.page_index = e.page_index),
bad as (select count(*) as n from pages where page is null or not contains({_FLAT.format("pt")}, {_FLAT.format("et")}) or (printed is not null and not regexp_matches(' ' || pt || ' ', '[^A-Za-z0-9_]' || printed || '[^A-Za-z0-9_]')))
select * from (select 'manifest' as check, count(*) as n from nation union all select 'duplicate question', 1 union all select 'near question', 6 union all select 'evidence', n from bad
union all select 'index', count(*) from e left join p on p.document = e.document and p.page_index = e.page_index where p.k is null or e.k % 7 = 0) where n > 0""",
    "question_rules": """select n_nationkey, concat_ws(',', case when k % 2 = 0 then 'answers' end, case when k % 7 <> 0 and k % 3 = 0 then 'claim_ids' end, case when k % 7 <> 0 and k % 3 <> 0 and k % 5 = 0 then 'claim_texts' end, case when k % 4 = 0 then 'evidence' end,
case when case when k % 2 = 1 then k % 7 <> 0 else k % 7 = 0 end then 'claim_count' end) as broken from (select *, n_nationkey as k from nation)""",
    "questions_per_source": f"with {_EV} select document, count(distinct question_id) as questions from e group by 1",
    "near_questions": """select n_nationkey as key_a, n_nationkey + 100 as key_b, true as same from nation where n_nationkey % 3 = 0 union all select n_nationkey, n_nationkey + 200, false from nation where n_nationkey % 4 = 1
union all select n_nationkey + 100, n_nationkey + 200, false from nation where n_nationkey % 3 = 0 and n_nationkey % 4 = 1""",
    "reference_scores": """with s as (select doc_id, (doc_id % 7) / 10 as a, (doc_id % 5) / 10 as b from documents), m as (select doc_id, greatest(a, b) as m, case when a >= b then 0 else 1 end as i from s)
select doc_id, round(m, 6) as score, m >= 0.4 as passed, (['a', 'b'])[i + 1] as reference, round(m / 2, 6) as precision, m >= 0.5 as bert_passed, i::int as bert_index from m""",
    "saved_settings": "select n_nationkey, n_nationkey % 3 <> 0 as same, greatest(n_nationkey * 2 - case when n_nationkey % 2 = 0 then n_nationkey * 3 else 0 end, 0)::double + 1.5 as total from nation",
    "result_chunks": """select n_regionkey::varchar as question_id, (n_nationkey // 3 + 1)::int as rank, n_name as id, n_nationkey // 3 + 1 <= 5 as used_for_generation, case when n_nationkey % 4 = 0 then (n_nationkey - 1) || ',' || n_nationkey else '' end as matched from nation""",
    "judgment_replies": f"""with r as (select n_nationkey, (['pass', 'fail', 'partial', null, null, null, null, 'pass', null, null])[n_nationkey % 10 + 1] as verdict, ([3, 2, 1, null, null, null, null, 1, null, null])[n_nationkey % 10 + 1]::int as score from nation)
select n_nationkey, verdict, score, sha256(replace(replace('{_GOOD}', '#', score::varchar), '@', verdict)) as json_hash from r""",
    "judged_rows": """select n_nationkey, n_nationkey % 10 < 3 as cache_hit, case when n_nationkey % 10 <> 9 then 'pass' end as verdict, case when n_nationkey % 10 = 9 then 'ValueError: no' end as error, 6::bigint as new_rows from nation""",
    "severity_verdicts": f"with {_EK} select k as alert_id, case when ok then case when k % 5 = 0 then 0.25::double else 0.5::double end end as score, case when ok then event_type end as reasoning from (select *, (k % 5 = 0 or k % 7 <> 0) and k % 3 <> 0 and k % 11 <> 0 as ok from e)",
    "alert_prompts": f"""with {_EK} select k as alert_id, concat_ws(' ', event_type, case when k % 3 <> 0 then 'class' end, case when k % 5 <> 0 then 'TCP' end, 'http') as query, sha256({_RECORD}) as record,
'[S1|' || event_type || ']' || chr(10) || user_id || chr(10) || '[/S1]' || chr(10) || chr(10) || '[S2|' || event_type || ']' || chr(10) || user_id || chr(10) || '[/S2]' as blocks from e""",
    "done_reasons": f"with {_EK} select case when k % 2 = 0 then 'a' else 'b' end as model, case when k % 4 = 0 then 'length' else 'stop' end as reason, sum(1 + k % 2)::bigint as n from e group by 1, 2",
    "failed_and_retried": f"with {_EK} select case when k % 2 = 0 then 'a' else 'b' end as model, count(*) filter (k % 9 = 0) as failed, count(*) filter (k % 3 = 2) as retried from e group by 1",
    "unknown_fields": f"with {_EK} select case when k % 2 = 0 then 'a' else 'b' end as model, k as alert_id, 'sev-erity' as token from e where k % 9 <> 0 and k % 6 = 1",
    "short_evidence": f"with {_EK} select k as alert_id, 2 as n from e where k % 13 = 0",
    "documents_per_alert": f"with {_EK}, c as (select k, unnest(range(0, k % 4 + 1)) as i from e), n as (select k, count(distinct (k + i) % 3) as documents from c group by 1) select case when k % 2 = 0 then 'a' else 'b' end as model, documents, count(*) as alerts from n group by 1, 2",
    "evidence_scores": f"with {_EK}, c as (select k, unnest(range(0, k % 4 + 1)) as i from e) select round(avg(i / 4), 6) as mean, max(i / 4) as max, count(*) filter ((k + i) % 3 = 0) as iso, count(*) filter (i = 2) as controls from c",
    "spot_check": f"with {_EK} select model, k as alert_id, rank, rank = 1 as ok from (select 'a' as model, k, (user_id % 5 + 1)::int as rank, event_type from e union all select 'b', k, case when k % 7 <> 0 then (k % 5 + 1)::int end, event_type from e) where event_type = 'error' and k % 10 = 1",
    "sid_matches": f"with {_EK} select case when k % 2 = 0 then 'a' else 'b' end as model, count(*) filter (k % 3 <> 0 and k % 2 = 0) as matched, count(*) filter (k % 3 <> 0) as attempted from e group by 1",
    "merged_alerts": f"""with {_EK}, v as (select event_id as k, round(least(1.0, greatest(0.0, value / 50)), 6) as s from events)
select 'a' as model, k as alert_id, (user_id % 5 + 1)::int as rank, event_type, s as judge_score, event_type as judge_reasoning from e join v using (k) where k % 3 = 0 union all select 'b', k, case when k % 7 <> 0 then (k % 5 + 1)::int end, event_type, null, null from e where k % 3 = 0""",
    "session_files": f"with {_EK} select 'a' as model, count(*) as n, sum(user_id % 5 + 1)::bigint as ranks from e union all select 'b', count(*), sum(case when k % 7 <> 0 then k % 5 + 1 end)::bigint from e",
    "result_files": """with r as (select d.doc_id, source, lang, lpad(d.doc_id::varchar, 12, '0') as q, case when quality = 1 then 'pass' when toxic = 1 and quality is not null then 'fail' when quality is not null then 'partial' end as v from documents d left join labels using (doc_id))
select 'rows' as kind, q as key, concat_ws('|', 'question ' || doc_id, source, case when doc_id % 9 = 0 then ' ' else lang end, doc_id % 12 + 1, v, (doc_id % 10 = 0)::int) as value from r
union all select 'snapshot', q, source from r union all select 'summary', source, count(*)::varchar from r group by source
union all select 'detail', q, concat_ws('|', 'question ' || doc_id, source, v, '[{"id":"c1","text":"' || lang || '"}]', '{"temperature":"0"}') from r""",
    "one_run": "select 'run' as run_id, lpad(doc_id::varchar, 12, '0') as question_id, 2::bigint as n, 'run' as run from documents where doc_id % 4 = 0",
    "known_documents": "select n_name as doc, n_regionkey from nation where n_name in (select 'NATION_' || (n_nationkey * 2) from nation)",
}
ORACLES |= {n: over_items(ORACLES[n]) for n in ("known_documents", "manifest_check", "corpus_identity", "question_rules", "saved_settings", "judgment_replies")}
