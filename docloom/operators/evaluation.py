"""Evaluation: per-model summaries, result predicates, evidence matching, dataset checks, samples.

Result rows have the columns of schemas.RESULT. Missing values are nulls and take no part in means,
medians or rates. Everything is native but the sequence similarity of question pairs, which Spark lacks.
"""

from __future__ import annotations

import difflib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import collapse_space, lexical_tokens, question_key, strip
from docloom.schemas import STAGES

CRITERIA = ("correctness", "completeness", "faithfulness", "relevance")
SAMPLE_SEED, SAMPLE_SIZE = 42, 30
EVIDENCE_RECALL, DUPLICATE_RATIO = 0.90, 0.90


def answered() -> Column:
    return F.coalesce(strip(F.col("generated_answer")) != "", F.lit(False))


def _has(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def rate(flag: Column) -> Column:
    """The share of true among those that are not null; null without any."""
    return F.avg(flag.cast("int"))


def summarize(results: DataFrame, order: str = "question_id") -> DataFrame:
    """One row per candidate model; the digest is that of the first row by ``order``."""
    cosine, bert, judge = F.col("metrics.cosine_similarity"), F.col("metrics.bertscore"), F.col("metrics.llm_judge.judgment")
    verdict = judge["verdict"]
    share = lambda v: F.count_if(verdict == v) / F.nullif(F.count(verdict), F.lit(0))
    stages = [a for s in STAGES for a in (F.avg(f"latency_ms.{s}").alias(f"{s}_latency_mean_ms"), F.median(f"latency_ms.{s}").alias(f"{s}_latency_median_ms"))]
    return results.groupBy("candidate_model").agg(
        F.min_by("candidate_model_digest", order).alias("candidate_model_digest"), F.count("*").alias("evaluated_questions"), F.count_if(answered()).alias("successful_answers"),
        F.count_if(_has(F.col("errors")) | ~answered()).alias("failed_or_skipped"),
        F.count(cosine["score"]).alias("cosine_count"), F.avg(cosine["score"]).alias("cosine_mean"), F.median(cosine["score"]).alias("cosine_median"), rate(cosine["passed"]).alias("cosine_pass_rate"),
        F.count(bert["f1"]).alias("bertscore_count"), F.avg(bert["precision"]).alias("bertscore_precision_mean"), F.avg(bert["recall"]).alias("bertscore_recall_mean"),
        F.avg(bert["f1"]).alias("bertscore_f1_mean"), F.median(bert["f1"]).alias("bertscore_f1_median"), rate(bert["passed"]).alias("bertscore_pass_rate"),
        F.count(judge["correctness"]["score"]).alias("judge_count"), *[F.avg(judge[c]["score"]).alias(f"judge_{c}_mean") for c in CRITERIA],
        *[share(v).alias(f"judge_{v}_rate") for v in ("pass", "partial", "fail")], *stages,
    ).orderBy("candidate_model")


def _sorted_fields(column: Column, kind: T.DataType) -> Column:
    """The value with its structs' fields in name order, so that JSON keys are sorted."""
    if isinstance(kind, T.StructType):
        value = F.struct(*[_sorted_fields(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(column.isNotNull(), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _sorted_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(column)))
    return column


def json_cell(column: Column, kind: T.DataType) -> Column:
    """Compact JSON with sorted keys; empty for null."""
    return F.coalesce(F.to_json(_sorted_fields(column, kind), {"ignoreNullFields": "false"}), F.lit(""))


def flatten_results(results: DataFrame) -> DataFrame:
    """The fixed columns of the detailed report, in their order; nested values as JSON cells."""
    kind = lambda path: results.select(path).schema.fields[0].dataType
    cell = lambda path, name: json_cell(F.col(path), kind(path)).alias(name)
    c, b, j = "metrics.cosine_similarity", "metrics.bertscore", "metrics.llm_judge"
    out = [F.col(n) for n in ("schema_version", "run_id", "dataset_version", "question_id", "question", "candidate_model", "candidate_model_digest")]
    out += [cell("generation_config", "generation_config"), F.col("rewritten_query"), F.col("generated_answer"), F.col("reference_answer")]
    out += [cell(n, n) for n in ("reference_answers", "gold_claims", "gold_evidence")]
    out += [F.col(f"{c}.{n}").alias(f"cosine_{n}") for n in ("score", "threshold", "passed", "selected_reference", "selected_reference_index")]
    out += [F.col(f"{b}.{n}").alias(f"bertscore_{n}") for n in ("precision", "recall", "f1", "threshold", "passed", "selected_reference", "selected_reference_index")]
    out += [F.col(f"{j}.{n}").alias(f"judge_{n}") for n in ("provider", "model", "prompt_version", "prompt_hash", "cache_key", "cache_hit")]
    lists = {"completeness": ("missing_claim_ids",), "faithfulness": ("unsupported_claims", "contradicted_claims")}
    for name in CRITERIA:
        out += [F.col(f"{j}.judgment.{name}.{f}").alias(f"judge_{name}_{f}") for f in ("score", "justification")]
        out += [cell(f"{j}.judgment.{name}.{f}", f"judge_{f}") for f in lists.get(name, ())]
    out += [F.col(f"{j}.judgment.verdict").alias("judge_verdict"), *[F.col(f"latency_ms.{s}").alias(f"{s}_latency_ms") for s in STAGES], cell("errors", "errors")]
    return results.select(*out)


def clean_cells(rows: DataFrame) -> DataFrame:
    """String cells without white space at the end of their lines."""
    trim = lambda c: F.regexp_replace(c, r"[^\S\r\n]+(?=\r\n|\r|\n|$)", "")
    return rows.select(*[trim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema])


def error_labels() -> Column:
    """Distinct diagnostic labels of a result, in order."""
    j = "metrics.llm_judge.judgment"
    own = [F.when(_has(F.col(f"{j}.{path}")), F.lit(label)) for path, label in (("completeness.missing_claim_ids", "missing gold claim"), ("faithfulness.unsupported_claims", "unsupported claim"), ("faithfulness.contradicted_claims", "contradiction"))]
    failures = F.transform(F.coalesce("errors", F.array().cast("array<struct<stage:string,type:string,message:string>>")), lambda e: F.concat(F.coalesce(e["stage"], F.lit("pipeline")), F.lit(" failure")))
    return F.array_distinct(F.concat(F.array_compact(F.array(*own)), failures))


def is_complete(judge_enabled: bool = True) -> Column:
    needed = ["cosine_similarity", "bertscore"] + ["llm_judge"] * judge_enabled
    ok = (F.col("schema_version") == 2) & answered() & ~_has(F.col("errors"))
    for name in needed:
        ok = ok & F.col(f"metrics.{name}").isNotNull()
    return F.coalesce(ok, F.lit(False))


def can_retry_judge() -> Column:
    """Only the judge's stage is missing, and all that it needs is there."""
    full = lambda c: F.coalesce(strip(F.col(c)) != "", F.lit(False))
    chunk_ok = lambda x: ~F.coalesce(x["used_for_generation"], F.lit(False)) | (x["id"].isNotNull() & x["rank"].isNotNull() & x["document"].isNotNull() & x["text"].isNotNull())
    c, b = "metrics.cosine_similarity", "metrics.bertscore"
    known = [F.col(f"{c}.{n}").isNotNull() for n in ("score", "threshold", "passed")] + [F.col(f"{b}.{n}").isNotNull() for n in ("precision", "recall", "f1", "threshold", "passed")]
    ok = (F.col("schema_version") == 2) & full("question_id") & full("question") & full("reference_answer") & answered()
    ok = ok & _has(F.col("reference_answers")) & F.forall("reference_answers", lambda r: F.coalesce(strip(r) != "", F.lit(False)))
    ok = ok & _has(F.col("gold_claims")) & _has(F.col("gold_evidence")) & F.col("retrieved_chunks").isNotNull() & F.forall("retrieved_chunks", chunk_ok)
    for k in known:
        ok = ok & k
    ok = ok & F.col("metrics.llm_judge").isNull() & F.col("errors").isNotNull() & F.forall("errors", lambda e: e["stage"].eqNullSafe("judge"))
    return F.coalesce(ok, F.lit(False))


def has_quota_error() -> Column:
    return F.coalesce(F.exists("errors", lambda e: (e["stage"] == "judge") & (e["type"] == "JudgeQuotaError")), F.lit(False))


def retried_latency(total: Column, judge: Column, new: Column) -> Column:
    """A row's total after its judge stage ran again."""
    return F.greatest(total - F.coalesce(judge, F.lit(0.0)), F.lit(0.0)) + new


def configs_match(saved: Column, requested: Column, ignored: tuple[str, ...] = ("created_at", "run_id")) -> Column:
    """Maps are equal but for the ignored keys."""
    clean = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: ~k.isin(*ignored))))
    return clean(saved) == clean(requested)


def token_recall(evidence: Column, text: Column) -> Column:
    """The share of the evidence's distinct tokens that the text has; an error for evidence without tokens."""
    own, other = F.array_distinct(lexical_tokens(evidence)), lexical_tokens(text)
    value = F.size(F.array_intersect(own, other)) / F.size(own)
    return F.when(F.size(own) == 0, F.raise_error(F.lit("evidence has no tokens")).cast("double")).otherwise(value)


def match_evidence(evidence: DataFrame, chunks: DataFrame, least: float = EVIDENCE_RECALL) -> DataFrame:
    """(question_id, evidence_index, chunk_id, recall) of chunks that hold a piece of evidence.

    evidence: question_id, evidence_index, document, page_index (may be null), text. chunks: question_id,
    chunk_id, document, page, text. The document must be the same, and the page if both are known.
    """
    e = evidence.select("question_id", "evidence_index", "document", "page_index", F.col("text").alias("__e"))
    rows = e.join(chunks.select("question_id", "chunk_id", "document", "page", F.col("text").alias("__c")), ["question_id", "document"])
    on_page = F.col("page").isNull() | F.col("page_index").isNull() | (F.col("page") == F.col("page_index") + 1)
    return rows.where(on_page).withColumn("recall", token_recall(F.col("__e"), F.col("__c"))).where(F.col("recall") >= least).select("question_id", "evidence_index", "chunk_id", "recall")


def passage_recall(passages: DataFrame, docs: DataFrame, passage_key: str, doc_key: str, text: str = "text", least: float = EVIDENCE_RECALL) -> DataFrame:
    """(passage, doc, recall) over all pairs with recall of at least ``least``, without comparing all pairs.

    A document that has so large a share of a passage's tokens misses few of them, so it must have one of any
    (missing + 1) tokens. Each passage looks documents up by its rarest ones; counts are then exact.
    """
    p = passages.select(F.col(passage_key).alias("__p"), F.array_distinct(lexical_tokens(F.col(text))).alias("__t")).where(F.size("__t") > 0)
    tokens = p.select("__p", F.size("__t").alias("__n"), F.explode("__t").alias("token"))
    wanted = tokens.select("token").distinct()
    held = docs.select(F.col(doc_key).alias("__d"), F.explode(F.array_distinct(lexical_tokens(F.col(text)))).alias("token")).join(wanted, "token", "left_semi")
    df = held.groupBy("token").agg(F.count("*").alias("__df"))
    rarity = Window.partitionBy("__p").orderBy(F.coalesce("__df", F.lit(0)), "token")
    ranked = tokens.join(df, "token", "left").withColumn("__place", F.row_number().over(rarity))
    # At least ceil(least * n) tokens are shared, so at most n minus that are missing.
    rare = ranked.where(F.col("__place") <= F.col("__n") - F.ceil(F.col("__n") * least) + 1)
    pairs = rare.select("__p", "token").join(held, "token").select("__p", "__d").distinct()
    whole = docs.select(F.col(doc_key).alias("__d"), lexical_tokens(F.col(text)).alias("__c"))
    checked = pairs.join(p, "__p").join(whole, "__d").withColumn("recall", F.size(F.array_intersect("__t", "__c")) / F.size("__t"))
    return checked.where(F.col("recall") >= least).select(F.col("__p").alias(passage_key), F.col("__d").alias(doc_key), "recall")


def missing_tokens(evidence: Column, indexed: Column) -> Column:
    """Tokens of the evidence that the indexed text lacks, also as one half of an adjacent pair that the other side writes as one."""
    e, i = lexical_tokens(evidence), F.array_distinct(lexical_tokens(indexed))
    sequence = lexical_tokens(indexed)
    pair = lambda a: F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    known = F.array_union(i, pair(sequence))
    has = lambda x, y: F.coalesce(F.array_contains(i, F.concat(x, y)), F.lit(False))
    lost = F.filter(e, lambda t, n: ~F.array_contains(known, t) & ~has(F.get(e, n - 1), t) & ~has(t, F.get(e, n + 1)))
    return F.array_distinct(lost)


def quota_differences(rows: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """value, n, wanted where the counts of a column differ from the expected (value, wanted)."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    e = expected.select(F.col("value").alias("__v"), "wanted")
    both = counts.join(e, F.col("value").eqNullSafe(F.col("__v")), "full_outer")
    return both.select(F.coalesce("value", "__v").alias("value"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wanted", F.lit(0)).alias("wanted")).where("n <> wanted")


def best_reference(scores: Column) -> Column:
    """struct(score, index) of the best of array<double>; the first of equal ones."""
    pairs = F.transform(scores, lambda s, i: F.struct(s.alias("score"), (-i).alias("at")))
    top = F.array_max(pairs)
    return F.when(F.size(scores) > 0, F.struct(top["score"].alias("score"), (-top["at"]).alias("index")))


def answer_similarity(scores: Column, references: Column, threshold: float) -> Column:
    """The cosine metric of an answer: best score, threshold, passed and the reference it belongs to."""
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must be within -1 .. 1")
    best = best_reference(scores)
    return F.struct(best["score"].alias("score"), F.lit(float(threshold)).alias("threshold"), (best["score"] >= threshold).alias("passed"), F.get(references, best["index"]).alias("selected_reference"), best["index"].alias("selected_reference_index"))


def retrieval_hits(results: DataFrame) -> DataFrame:
    """question_id, candidate_model, hit_5, hit_10 and recall_5 of the gold evidence."""
    chunks = F.col("retrieved_chunks")
    hit = lambda k: F.exists(chunks, lambda c: (c["rank"] <= k) & (F.size(c["matched_evidence_indices"]) > 0))
    found = F.size(F.array_distinct(F.flatten(F.transform(F.filter(chunks, lambda c: c["rank"] <= 5), lambda c: c["matched_evidence_indices"]))))
    return results.select("question_id", "candidate_model", hit(5).alias("hit_5"), hit(10).alias("hit_10"), (found / F.nullif(F.size("gold_evidence"), F.lit(0))).alias("recall_5"))


def unique_content(question: str = "question") -> Column:
    """Names of a question's broken rules: repeated answers, claim ids, claims or evidence, or a wrong number of claims."""
    repeated = lambda a: F.size(a) != F.size(F.array_distinct(a))
    q = F.col(question)
    rules = {
        "answers": repeated(F.concat(F.array(q["answer"]), q["acceptable_answers"])),
        "claim_ids": repeated(F.transform(q["claims"], lambda c: c["id"])),
        "claim_texts": repeated(F.transform(q["claims"], lambda c: question_key(c["text"]))),
        "evidence": repeated(F.transform(q["evidence"], lambda e: F.struct(e["document_path"], e["pdf_page_index"], e["text"]))),
        "claim_count": F.when(q["question_type"] == "direct", F.size(q["claims"]) != 1).otherwise(F.size(q["claims"]) < 2),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def exact_duplicates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """normalized text hash, number and least key of questions that are the same after normalisation."""
    return rows.groupBy(F.sha2(question_key(F.col(text)), 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def near_questions(rows: DataFrame, key: str, text: str, least: float = DUPLICATE_RATIO, gram: int = 3) -> DataFrame:
    """Pairs (key_a < key_b) of normalised questions whose matching-block ratio is at least ``least``.

    2 M / (a + b) is at least r only if the shorter length is at least r / (2 - r) of the longer, and then at most
    (1 - r) (a + b) characters are not matched. Each of them breaks ``gram`` grams at most, so a question shares one of any
    so many of its grams and one more with every partner. Questions meet in their rarest grams; only pairs that meet are compared.
    """
    own = rows.select(F.col(key).alias("k"), question_key(F.col(text)).alias("t")).withColumn("n", F.length("t"))
    shrink = least / (2 - least)
    broken = lambda n: F.floor((1 - least) * (n + F.floor(n / shrink)) + 1e-9) * gram
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - gram + 1, F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(gram))))
    each = own.select("k", "n", F.explode(grams).alias("g"))
    rarity = Window.partitionBy("k").orderBy("__df", "g")
    counted = each.join(each.groupBy("g").agg(F.count("*").alias("__df")), "g").where("__df > 1")
    rare = counted.withColumn("__place", F.row_number().over(rarity)).where(F.col("__place") <= broken(F.col("n")) + 1)
    a = rare.select(F.col("k").alias("key_a"), F.col("n").alias("na"), "g")
    b = counted.select(F.col("k").alias("key_b"), F.col("n").alias("nb"), "g")
    near = (F.col("key_a") != F.col("key_b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * shrink)
    met = a.join(b, "g").where(near).select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
    texts = lambda side: own.select(F.col("k").alias(f"key_{side}"), F.col("t").alias(side))
    pairs = met.join(texts("a"), "key_a").join(texts("b"), "key_b")
    return pairs.withColumn("ratio", _ratio("a", "b")).where(F.col("ratio") >= least).select("key_a", "key_b", "ratio")


def verify_evidence(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence (key, document, page_index, printed_page, text) that its source page does not bear out, with the reason."""
    rows = evidence.join(pages.select("document", "page_index", F.col("text").alias("__page")), ["document", "page_index"], "left")
    inside = collapse_space(F.col("__page")).contains(collapse_space(F.col("text")))
    quoted = F.concat(F.lit(r"(?<!\w)\Q"), F.col("printed_page"), F.lit(r"\E(?!\w)"))
    reason = F.when(F.col("__page").isNull(), "no such page").when(~inside, "text is not on the page").when(F.col("printed_page").isNotNull() & ~F.regexp_like("__page", quoted), "printed page is not on the page")
    return rows.withColumn("reason", reason).where("reason is not null").drop("__page")


def verify_index(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence whose indexed page (chunk texts joined) is absent or lacks tokens: key, document, page, missing."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), " ")
    pages = chunks.groupBy("document", "page").agg(joined.alias("__indexed"))
    e = evidence.withColumn("page", F.col("page_index") + 1)
    rows = e.join(pages, ["document", "page"], "left").withColumn("missing", F.when(F.col("__indexed").isNotNull(), missing_tokens(F.col("text"), F.col("__indexed"))))
    return rows.where(F.col("missing").isNull() | (F.size("missing") > 0)).drop("__indexed")


def verify_manifest(manifest: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """Entries (path, hash, page_count) that differ from the files or whose document is not indexed: path, reason."""
    f = files.select("path", F.col("hash").alias("__hash"), F.col("page_count").alias("__pages"))
    i = index.select("path", F.lit(True).alias("__indexed")).distinct()
    rows = manifest.join(f, "path", "left").join(i, "path", "left")
    reason = F.when(F.col("__hash").isNull(), "no file").when(F.col("hash") != F.col("__hash"), "hash differs").when(~F.col("page_count").eqNullSafe(F.col("__pages")), "page count differs").when(F.col("__indexed").isNull(), "not indexed")
    return rows.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def review_sample(results: DataFrame, order: list[str], limit: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED) -> DataFrame:
    """A reproducible sample without replacement: the indices that Python's generator draws, in row order.

    A row's index is its place in its range partition after the rows of the partitions before. At most ``limit`` rows
    reach the driver.
    """
    spark = results.sparkSession
    ordered = results.orderBy(*order).select(F.struct(*results.columns).alias("__r"), F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")).persist()
    sizes = {r["__p"]: r["count"] for r in ordered.groupBy("__p").count().collect()}
    begins, n = {}, 0
    for p in sorted(sizes):
        begins[p] = n
        n += sizes[p]
    drawn = sorted(random.Random(seed).sample(range(n), min(limit, n)))
    wanted = [(p, i - b) for p, b in begins.items() for i in drawn if b <= i < b + sizes[p]]
    picked = spark.createDataFrame(wanted, "__p int, __i long")
    rows = [r["__r"] for r in ordered.join(F.broadcast(picked), ["__p", "__i"], "left_semi").orderBy("__p", "__i").select("__r").collect()]
    ordered.unpersist()
    return spark.createDataFrame(rows, results.schema)


def stratified_sample(rows: DataFrame, stratum: str, sizes: dict, key: str, seed: int = SAMPLE_SEED) -> DataFrame:
    """So many rows of each stratum, the ones with the least hashes of their keys."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    wanted = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(n)) for s, n in sizes.items()], F.lit(0))
    return rows.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= wanted).drop("__place")


def questions_per_source(evidence: DataFrame, document: str = "document", question: str = "question_id") -> DataFrame:
    """document and the number of different questions that it holds evidence for."""
    return evidence.groupBy(document).agg(F.countDistinct(question).alias("questions"))
