"""Evaluation runs: dataset checks, one row per (model, question), resume, judge-only retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import QUERY_PREFIX, Settings
from docloom.functions.judge import judge_rows
from docloom.functions.providers import Embedder, Generator, embed, generate
from docloom.functions.vectors import cosine
from docloom.operators import evaluation as V
from docloom.operators import store as S
from docloom.operators.fusion import retrieve
from docloom.operators.lexical import LexicalIndex
from docloom.plans.answer import blocks_of, prompt_of

RETRIEVED, USED = 10, 5


def validate_dataset(questions: DataFrame, evidence: DataFrame, pages: DataFrame, chunks: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """check, key and detail of everything that is wrong; empty for a valid dataset."""
    part = lambda df, check, key, detail: df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))
    indexed = chunks.select(F.col("document").alias("path")).distinct()
    parts = [
        part(V.verify_manifest(manifest, files, indexed), "manifest", "path", F.col("reason")),
        part(V.exact_duplicates(questions, "id", "question"), "duplicate question", "first_key", F.col("n")),
        part(V.near_questions(questions, "id", "question"), "near question", "key_a", F.col("key_b")),
        part(V.verify_evidence(evidence, pages), "evidence", "key", F.col("reason")),
        part(V.verify_index(evidence, chunks), "index", "key", F.coalesce(F.array_join("missing", " "), F.lit("no page"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corpus_identity(manifest: DataFrame, index_counts: DataFrame) -> DataFrame:
    """Documents in which the corpus manifest (doc_name, chunk_count) and the live index differ; it must be empty for a run."""
    return S.count_differences(manifest, index_counts)


def serialize_chunks(found: DataFrame, chunks: DataFrame, matched: DataFrame | None = None, key: str = "id", used: int = USED) -> DataFrame:
    """question_id and retrieved_chunks: rank from 1, whether it is used for generation, matched evidence indices."""
    rows = found.join(chunks.select(F.col(key), F.col("doc_name").alias("document"), "section", F.col("page").alias("physical_page"), "control_id", "text"), key)
    if matched is not None:
        hits = matched.groupBy(F.col("question_id").alias("query_id"), F.col("chunk_id").alias(key)).agg(F.array_sort(F.collect_set("evidence_index")).alias("__hits"))
        rows = rows.join(hits, ["query_id", key], "left")
    else:
        rows = rows.withColumn("__hits", F.lit(None).cast("array<int>"))
    rank = (F.col("rank") + 1).cast("int")
    item = F.struct(
        rank.alias("rank"), F.col(key).alias("id"), "document", "section", "physical_page", "control_id", "text", F.col("score").alias("dense_cosine_score"),
        (rank <= used).alias("used_for_generation"), F.coalesce("__hits", F.array().cast("array<int>")).alias("matched_evidence_indices"),
    )
    return rows.groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_list(item)).alias("retrieved_chunks"))


def bert_similarity(scores: Column, references: Column, threshold: float) -> Column:
    """Of array<struct(precision, recall, f1)>: the parts of the best f1 (the first of equal ones) and its reference."""
    best = V.best_reference(F.transform(scores, lambda s: s["f1"]))
    at = F.get(scores, best["index"])
    bad = F.exists(scores, lambda s: F.isnan(s["f1"]) | (F.abs(s["f1"]) == float("inf")))
    out = F.struct(at["precision"].alias("precision"), at["recall"].alias("recall"), at["f1"].alias("f1"), F.lit(float(threshold)).alias("threshold"), (at["f1"] >= threshold).alias("passed"), F.get(references, best["index"]).alias("selected_reference"), best["index"].alias("selected_reference_index"))
    return F.when(bad, F.raise_error(F.lit("a score is not finite")).cast("struct<precision:double,recall:double,f1:double,threshold:double,passed:boolean,selected_reference:string,selected_reference_index:int>")).otherwise(out)


def evaluate(work: DataFrame, chunks: DataFrame, index: LexicalIndex | None, embedder: Embedder, generator: Generator, threshold: float, settings: Settings = Settings(), evidence: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Results of work (candidate_model, question_id, question, reference_answers): retrieval once per question, an answer and its similarity per model.

    A stage that fails leaves a null and an entry in errors; later stages that need it are skipped.
    """
    asked = work.select("question_id", "question").distinct()
    queries = asked.select(F.col("question_id").alias("query_id"), F.col("question").alias("query_text"), embed(F.col("question"), embedder, QUERY_PREFIX).alias("query_vector"))
    found = retrieve(chunks, queries, RETRIEVED, key, "embedding", index=index, settings=settings)
    matched = None
    if evidence is not None:
        named = chunks.select(F.col(key).alias("chunk_id"), F.col("doc_name").alias("document"), "page", "text")
        own = found.select(F.col("query_id").alias("question_id"), F.col(key).alias("chunk_id")).join(named, "chunk_id")
        matched = V.match_evidence(evidence, own)
    context = serialize_chunks(found, chunks, matched, key)
    rows = work.join(context, "question_id", "left")
    used = F.transform(F.filter("retrieved_chunks", lambda c: c["used_for_generation"]), lambda c: c["text"])
    answer = generate(F.when(F.size("retrieved_chunks") > 0, prompt_of(F.col("question"), blocks_of(used), settings)), F.col("candidate_model"), generator)
    rows = rows.withColumn("generated_answer", answer)
    refs = rows.select("candidate_model", "question_id", "generated_answer", F.posexplode("reference_answers").alias("__i", "__ref"))
    scored = refs.where("generated_answer is not null").select("candidate_model", "question_id", "__i", cosine(embed(F.col("generated_answer"), embedder), embed(F.col("__ref"), embedder)).alias("s"))
    lists = scored.groupBy("candidate_model", "question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "s"))), lambda x: x["s"]).alias("__scores"))
    out = rows.join(lists, ["candidate_model", "question_id"], "left")
    failed = lambda stage, what: F.struct(F.lit(stage).alias("stage"), F.lit(what).alias("type"), F.lit("").alias("message"))
    errors = F.array_compact(F.array(F.when(F.coalesce(F.size("retrieved_chunks"), F.lit(0)) <= 0, failed("retrieval", "NoChunks")), F.when((F.size("retrieved_chunks") > 0) & F.col("generated_answer").isNull(), failed("generation", "GeneratorError"))))
    similarity = F.when(F.col("__scores").isNotNull(), V.answer_similarity(F.col("__scores"), F.col("reference_answers"), threshold))
    return out.select("candidate_model", "question_id", "question", "generated_answer", "reference_answers", F.col("retrieved_chunks"), similarity.alias("cosine_similarity"), errors.alias("errors"))


def run(models: DataFrame, questions: DataFrame, done: DataFrame, evaluate_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The snapshot after a run: rows that are done stay, all other combinations are evaluated."""
    todo = S.pending(models, questions, done, "candidate_model", "question_id")
    return S.keyed_upsert(done, evaluate_rows(todo), "candidate_model", "question_id")


def retry_judge(results: DataFrame, cache: DataFrame, request: Callable[[str], str]) -> DataFrame:
    """Judgments of the rows that lack nothing else: question_id, candidate_model, judgment, cache_hit, error."""
    rows = results.where(V.can_retry_judge()).select("question_id", "candidate_model", F.to_json(F.struct("question", "generated_answer", "reference_answers", "gold_claims", "retrieved_chunks")).alias("payload"))
    return judge_rows(rows, cache, request)
