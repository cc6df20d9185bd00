"""Evaluation queries over documents, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import judge as J
from docloom.io import table
from docloom.operators import evaluation as V
from docloom.schemas import RESULT


def results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows made from documents and labels: source is the model, the labels are the outcomes."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    metrics = """named_struct(
      'cosine_similarity', if(quality is null, null, named_struct('score', n_chars / 20000.0D, 'threshold', 0.1D, 'passed', quality = 1, 'selected_reference', lang, 'selected_reference_index', 0)),
      'bertscore', if(toxic is null, null, named_struct('precision', n_chars / 30000.0D, 'recall', n_chars / 25000.0D, 'f1', n_chars / 27000.0D, 'threshold', 0.5D, 'passed', toxic = 0, 'selected_reference', lang, 'selected_reference_index', 0)),
      'llm_judge', if(quality is null, null, named_struct('provider', 'local', 'model', 'rule', 'prompt_version', '1', 'prompt_hash', sha2(lang, 256), 'cache_key', sha2(cast(doc_id as string), 256), 'cache_hit', false,
        'judgment', named_struct('correctness', named_struct('score', cast(n_chars % 5 as int), 'justification', lang), 'completeness', named_struct('score', cast(n_chars % 4 as int), 'justification', lang, 'missing_claim_ids', if(toxic = 1, array('c1'), array())),
          'faithfulness', named_struct('score', cast(n_chars % 3 as int), 'justification', lang, 'unsupported_claims', if(quality = 0, array('u'), array()), 'contradicted_claims', array()),
          'relevance', named_struct('score', 2, 'justification', lang), 'verdict', case when quality = 1 then 'pass' when toxic = 1 then 'fail' else 'partial' end))))"""
    rows = docs.selectExpr(
        "2 as schema_version", "'run' as run_id", "'1' as dataset_version", "lpad(cast(doc_id as string), 12, '0') as question_id", "concat('question ', doc_id) as question", "source as candidate_model", "sha2(source, 256) as candidate_model_digest",
        "map('temperature', '0') as generation_config", "cast(null as string) as rewritten_query", "if(doc_id % 9 = 0, ' ', lang) as generated_answer", "lang as reference_answer", "array(lang) as reference_answers",
        "array(named_struct('id', 'c1', 'text', lang)) as gold_claims", "array(named_struct('document_path', source, 'section', cast(null as string), 'printed_page', cast(null as string), 'pdf_page_index', 0, 'text', lang)) as gold_evidence",
        "array(named_struct('id', concat(source, ':0'), 'rank', cast(doc_id % 12 + 1 as int), 'document', source, 'section', cast(null as string), 'physical_page', 1, 'text', lang, 'used_for_generation', true, 'matched_evidence_indices', if(quality = 1, array(0), array()))) as retrieved_chunks",
        f"{metrics} as metrics", "named_struct('rewrite', 0.0D, 'retrieval', n_chars / 10.0D, 'generation', n_chars / 2.0D, 'judge', cast(null as double), 'total', n_chars * 0.6D) as latency_ms",
        "if(doc_id % 10 = 0, array(named_struct('stage', 'judge', 'type', 'JudgeQuotaError', 'message', lang)), array()) as errors",
    )
    import pyspark.sql.types as T

    return rows.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(RESULT)])


def q_summary(spark: SparkSession, d: str) -> DataFrame:
    s = V.summarize(results(spark, d))
    return s.select("candidate_model", "candidate_model_digest", *[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in s.schema if f.name not in ("candidate_model", "candidate_model_digest")])


def q_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose judge failed have no judgment; if they lack nothing else, their judge can run again."""
    judge = F.expr("if(size(errors) > 0, null, metrics.llm_judge)")
    own = results(spark, d).withColumn("metrics", F.col("metrics").withField("llm_judge", judge))
    return own.select("question_id", V.is_complete().alias("complete"), V.can_retry_judge().alias("retry"), V.has_quota_error().alias("quota"), F.array_join(V.error_labels(), ", ").alias("labels"))


def q_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys of all answers, over all inputs of a judgment."""
    return J.judge_keys(results(spark, d))


def q_hits(spark: SparkSession, d: str) -> DataFrame:
    return V.retrieval_hits(results(spark, d))


def q_flat(spark: SparkSession, d: str) -> DataFrame:
    flat = V.clean_cells(V.flatten_results(results(spark, d)))
    return flat.select("question_id", "candidate_model", "cosine_score", "bertscore_f1", "judge_verdict", "judge_missing_claim_ids", "errors", "gold_claims", "generation_config")


def q_recall(spark: SparkSession, d: str) -> DataFrame:
    return V.passage_recall(table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id").withColumn("recall", F.round("recall", 6))


def q_missing(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item against the item after it."""
    b = table(spark, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", F.array_join(F.array_sort(V.missing_tokens(F.col("text"), F.col("other"))), " ").alias("missing"))


def q_quota(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.sql("select * from values ('en', 600L), ('de', 150L), ('fr', 150L), ('it', 100L) as t(value, wanted)")
    return V.quota_differences(table(spark, d, "documents"), "lang", expected)


def q_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.median("n_chars").alias("median_chars"), F.round(V.rate(F.col("quality") == 1), 6).alias("quality_rate"), F.round(V.rate(F.col("toxic") == 1), 6).alias("toxic_rate"))


QUERIES = {
    "model_summary": q_summary, "result_predicates": q_predicates, "judge_keys": q_keys, "retrieval_hits": q_hits, "flat_results": q_flat, "evidence_recall": q_recall, "missing_tokens": q_missing,
    "quota_check": q_quota, "pass_rates": q_rates, "exact_duplicates": lambda s, d: V.exact_duplicates(table(s, d, "documents"), "doc_id", "text"),
    "review_sample": lambda s, d: V.review_sample(table(s, d, "documents").select("doc_id", "source"), ["doc_id"]),
}

_RES = "r as (select d.doc_id, source, lang, n_chars, quality, toxic, lpad(d.doc_id::varchar, 12, '0') as question_id from documents d left join labels using (doc_id))"
_QK = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_LEX = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
#: The canonical JSON of a judgment's inputs, with marks in the place of what a row brings.
_KEY = "'" + J.canonical_json(
    J.REQUEST | {"question_id": "@id", "question": "question @k", "candidate_answer": "@lang", "reference_answer": "@lang", "reference_answers": ["@lang"], "gold_claims": [{"id": "c1", "text": "@lang"}],
    "gold_evidence": [{"document_path": "@source", "section": None, "printed_page": None, "pdf_page_index": 0, "text": "@lang"}],
    "retrieved_context": [{"id": "@source:0", "rank": 0, "document": "@source", "section": None, "physical_page": 1, "text": "@lang", "used_for_generation": True, "matched_evidence_indices": []}]}
) + "'"
for _mark, _sql in (("@id", "question_id"), ("@k", "doc_id"), ("@lang", "lang"), ("@source", "source"), ('"rank":0', """'"rank":' || (doc_id % 12 + 1)"""), ('"matched_evidence_indices":[]', """'"matched_evidence_indices":' || case when quality = 1 then '[0]' else '[]' end""")):
    _KEY = _KEY.replace(_mark, f"' || {_sql} || '")
ORACLES = {
    "model_summary": f"""with {_RES}, m as (select *, n_chars / 20000 as cs, n_chars / 30000 as bp, n_chars / 25000 as br, n_chars / 27000 as bf, case when quality = 1 then 'pass' when toxic = 1 then 'fail' when quality is not null then 'partial' end as v from r)
select source as candidate_model, sha256(source) as candidate_model_digest, count(*) as evaluated_questions, count(*) filter (doc_id % 9 <> 0) as successful_answers, count(*) filter (doc_id % 10 = 0 or doc_id % 9 = 0) as failed_or_skipped,
count(quality) as cosine_count, round(avg(cs) filter (quality is not null), 6) as cosine_mean, round(median(cs) filter (quality is not null), 6) as cosine_median, round(avg((quality = 1)::int), 6) as cosine_pass_rate,
count(toxic) as bertscore_count, round(avg(bp) filter (toxic is not null), 6) as bertscore_precision_mean, round(avg(br) filter (toxic is not null), 6) as bertscore_recall_mean, round(avg(bf) filter (toxic is not null), 6) as bertscore_f1_mean,
round(median(bf) filter (toxic is not null), 6) as bertscore_f1_median, round(avg((toxic = 0)::int), 6) as bertscore_pass_rate, count(quality) as judge_count,
round(avg(n_chars % 5) filter (quality is not null), 6) as judge_correctness_mean, round(avg(n_chars % 4) filter (quality is not null), 6) as judge_completeness_mean, round(avg(n_chars % 3) filter (quality is not null), 6) as judge_faithfulness_mean,
avg(2.0::double) filter (quality is not null) as judge_relevance_mean, {", ".join(f"round(count(*) filter (v = '{x}') / nullif(count(v), 0), 6) as judge_{x}_rate" for x in ("pass", "partial", "fail"))},
0.0::double as rewrite_latency_mean_ms, 0.0::double as rewrite_latency_median_ms, {", ".join(f"round(avg(n_chars * {f}), 6) as {s}_latency_mean_ms, round(median(n_chars * {f}), 6) as {s}_latency_median_ms" for s, f in (("retrieval", "0.1::double"), ("generation", "0.5::double"), ("total", "0.6::double")))},
null::double as judge_latency_mean_ms, null::double as judge_latency_median_ms from m group by source""",
    "result_predicates": f"""with {_RES}, s as (select *, doc_id % 10 = 0 as failed, doc_id % 9 <> 0 and quality is not null and toxic is not null as scored from r)
select question_id, scored and not failed as complete, scored and failed as retry, failed as quota,
concat_ws(', ', case when toxic = 1 and quality is not null and not failed then 'missing gold claim' end, case when quality = 0 and not failed then 'unsupported claim' end, case when failed then 'judge failure' end) as labels from s""",
    "judge_keys": f"""with {_RES} select question_id, source as candidate_model, sha256({_KEY}) as cache_key from r where doc_id % 9 <> 0""",
    "flat_results": f"""with {_RES} select question_id, source as candidate_model, case when quality is not null then n_chars / 20000 end as cosine_score, case when toxic is not null then n_chars / 27000 end as bertscore_f1,
case when quality = 1 then 'pass' when toxic = 1 then 'fail' when quality is not null then 'partial' end as judge_verdict, case when quality is null then '' when toxic = 1 then '["c1"]' else '[]' end as judge_missing_claim_ids,
case when doc_id % 10 = 0 then '[{{"message":"' || lang || '","stage":"judge","type":"JudgeQuotaError"}}]' else '[]' end as errors, '[{{"id":"c1","text":"' || lang || '"}}]' as gold_claims, '{{"temperature":"0"}}' as generation_config from r""",
    "retrieval_hits": f"""with {_RES} select question_id, source as candidate_model, doc_id % 12 + 1 <= 5 and coalesce(quality = 1, false) as hit_5, doc_id % 12 + 1 <= 10 and coalesce(quality = 1, false) as hit_10,
case when doc_id % 12 + 1 <= 5 and quality = 1 then 1.0::double else 0.0::double end as recall_5 from r""",
    "evidence_recall": f"""with p as (select item_id, list_distinct({_LEX.format("text")}) as t from benchmark), pt as (select item_id, unnest(t) as token from p), dt as (select distinct doc_id, token from (select doc_id, unnest({_LEX.format("text")}) as token from documents)),
c as (select item_id, doc_id, count(*) as shared from pt join dt using (token) group by all) select item_id, doc_id, round(shared / len(t), 6) as recall from c join p using (item_id) where shared / len(t) >= 0.9""",
    "quota_check": """with e(value, wanted) as (values ('en', 600), ('de', 150), ('fr', 150), ('it', 100)), c as (select lang as value, count(*) as n from documents group by 1)
select coalesce(c.value, e.value) as value, coalesce(n, 0)::bigint as n, coalesce(wanted, 0)::bigint as wanted from c full join e on c.value = e.value where coalesce(n, 0) <> coalesce(wanted, 0)""",
    "pass_rates": f"with {_RES} select source, count(*) as n, round(avg(n_chars), 6) as mean_chars, median(n_chars)::double as median_chars, round(avg((quality = 1)::int), 6) as quality_rate, round(avg((toxic = 1)::int), 6) as toxic_rate from r group by source",
    "exact_duplicates": f"select sha256({_QK}) as text_hash, count(*) as n, min(doc_id) as first_key from documents group by 1 having count(*) > 1",
    "missing_tokens": f"""with b as (select a.item_id, {_LEX.format("a.text")} as e, {_LEX.format("b.text")} as i from benchmark a join benchmark b on b.item_id = a.item_id + 1),
k as (select *, i || list_transform(range(1, len(i)), lambda n: i[n] || i[n + 1]) as known from b)
select item_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(e) + 1), lambda n: not list_contains(known, e[n]) and not (n > 1 and list_contains(i, e[n - 1] || e[n])) and not (n < len(e) and list_contains(i, e[n] || e[n + 1]))), lambda n: e[n]))), ' ') as missing from k""",
}
