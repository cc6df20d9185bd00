"""Report sinks: summary and detailed CSV, Markdown, review sample, per-model JSON, snapshots."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import evaluation as V
from docloom.operators.store import swap_table

TABLES = {
    "Answer similarity": ("cosine_count", "cosine_mean", "cosine_median", "cosine_pass_rate"),
    "BERTScore": ("bertscore_count", "bertscore_precision_mean", "bertscore_recall_mean", "bertscore_f1_mean", "bertscore_pass_rate"),
    "Judge": ("judge_count", "judge_correctness_mean", "judge_completeness_mean", "judge_faithfulness_mean", "judge_relevance_mean", "judge_pass_rate"),
    "Latency (ms)": ("rewrite_latency_mean_ms", "retrieval_latency_mean_ms", "generation_latency_mean_ms", "judge_latency_mean_ms", "total_latency_mean_ms", "total_latency_median_ms"),
}

#: Rows of a file at most: a CSV file with lines in its cells is read whole by a task, and a task sorts a JSON file's rows.
FILE_ROWS = 100_000


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files of at most FILE_ROWS rows, each with a header, in the rows' order; nulls are empty, LF ends."""
    V.clean_cells(df).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("lineSep", "\n").option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """The whole table, in one swap."""
    swap_table(df, path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _cell(value: object) -> str:
    text = "-" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def markdown_table(rows: list[dict], columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(_cell(r.get(c)) for c in columns) + " |" for r in rows)]


def markdown_report(results: DataFrame, config: dict[str, str] | None = None) -> str:
    """Settings, metric tables and diagnostics; a few rows per model reach the driver."""
    summaries = [r.asDict() for r in V.summarize(results).collect()]
    labels = results.select("candidate_model", F.explode(V.error_labels()).alias("label")).groupBy("candidate_model", "label").agg(F.count("*").alias("n")).orderBy("candidate_model", "label")
    out = ["# Evaluation report", "", "## Settings", "", *(f"- {k}: {v}" for k, v in sorted((config or {}).items()))]
    for title, columns in TABLES.items():
        out += ["", f"## {title}", "", *markdown_table(summaries, ["candidate_model", *columns])]
    out += ["", "## Diagnostics", "", *markdown_table([r.asDict() for r in labels.collect()], ["candidate_model", "label", "n"])]
    return "\n".join(out) + "\n"


def review_payload(results: DataFrame, limit: int = V.SAMPLE_SIZE, seed: int = V.SAMPLE_SEED) -> dict:
    """The sample for manual labels; at most limit rows reach the driver."""
    rows = V.review_sample(results, ["candidate_model", "question_id"], limit, seed)
    used = F.filter("retrieved_chunks", lambda c: F.coalesce(c["used_for_generation"], F.lit(False)))
    chosen = rows.select("question_id", "question", F.col("reference_answer").alias("gold_answer"), "gold_claims", "gold_evidence", used.alias("retrieved_context"), "candidate_model", F.col("generated_answer").alias("candidate_answer"))
    blank = {"human_correctness": None, "human_completeness": None, "human_faithfulness": None, "notes": None}
    records = [json.loads(r[0]) | blank for r in chosen.select(F.to_json(F.struct(*chosen.columns), {"ignoreNullFields": "false"})).collect()]
    return {"seed": seed, "sample_size": len(records), "instructions": "Label correctness, completeness and faithfulness as pass, partial or fail.", "records": records}


def write_reports(results: DataFrame, folder: str, config: dict[str, str] | None = None) -> None:
    """All reports of a run under a local folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    write_csv(V.summarize(results), f"{folder}/summary")
    write_csv(V.flatten_results(results), f"{folder}/results")
    Path(f"{folder}/report.md").write_text(markdown_report(results, config), encoding="utf-8")
    Path(f"{folder}/manual_review.json").write_text(json.dumps(review_payload(results), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def per_model_json(rows: DataFrame, path: str) -> None:
    """One JSON folder a model, rows in alert order, in files of some FILE_ROWS rows."""
    files = max(1, -(-rows.count() // FILE_ROWS))
    rows.repartitionByRange(files, "model", "alert_id").sortWithinPartitions("model", "alert_id").write.mode("overwrite").partitionBy("model").json(path)


def merged_alerts(rankings: DataFrame, sample: DataFrame, judged: DataFrame) -> DataFrame:
    """Rankings with their alerts, and their judgments where there are any."""
    own = rankings.join(sample, "alert_id")
    j = judged.select("model", "alert_id", F.col("score").alias("judge_score"), F.col("reasoning").alias("judge_reasoning"))
    return own.join(j, ["model", "alert_id"], "left").orderBy("model", "alert_id")
