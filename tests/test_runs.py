"""Evaluation runs, dataset checks, index freshness and usage files."""

import pytest
from pyspark.sql import functions as F

from docloom.functions.providers import HashEmbedder, embed, extractive_generator
from docloom.operators import lexical
from docloom.operators import store as S
from docloom.plans import evaluate as E
from docloom.streaming.rate import add_usage


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d:0", "d", None, 1, None, "Backups are encrypted every night."), ("d:1", "d", None, 2, "AC-2", "Accounts are reviewed yearly.")]
    df = spark.createDataFrame(rows, "id string, doc_name string, section string, page int, control_id string, text string")
    return df.withColumn("embedding", embed(F.col("text"), HashEmbedder())).withColumn("content_hash", F.sha2("text", 256)).cache()


def test_run_resumes(spark, chunks):
    index = lexical.build_index(chunks, "id", "text")
    models = spark.createDataFrame([("a",), ("broken",)], "candidate_model string")
    questions = spark.createDataFrame([("q1", "Are backups encrypted?", ["Backups are encrypted every night."]), ("q2", "Are accounts reviewed?", ["no", "Accounts are reviewed yearly."])], "question_id string, question string, reference_answers array<string>")
    evidence = spark.createDataFrame([("q1", 0, "d", 0, "backups encrypted")], "question_id string, evidence_index int, document string, page_index int, text string")
    asked = []

    def generator(prompt, model):
        if model == "broken":
            raise RuntimeError("down")
        return extractive_generator(prompt)

    def rows(work):
        asked.append(work.count())
        return E.evaluate(work, chunks, index, HashEmbedder(), generator, 0.5, evidence=evidence)

    empty = rows(models.limit(0).crossJoin(questions))
    first = E.run(models, questions, empty.limit(0), rows)
    found = {(r.candidate_model, r.question_id): r for r in first.collect()}
    assert len(found) == 4 and found["a", "q1"].cosine_similarity.passed and not found["a", "q1"].errors
    assert found["a", "q2"].cosine_similarity.selected_reference_index == 1
    assert found["broken", "q1"].generated_answer is None and found["broken", "q1"].errors[0].stage == "generation"
    assert found["a", "q1"].retrieved_chunks[0].matched_evidence_indices == [0]
    done = spark.createDataFrame(first.where("candidate_model = 'a'").collect(), first.schema)
    assert E.run(models, questions, done, rows).count() == 4 and asked[-1] == 2


def test_bert(spark):
    df = spark.createDataFrame([([(0.1, 0.2, 0.5), (0.3, 0.4, 0.5)], ["x", "y"])], "s array<struct<precision:double,recall:double,f1:double>>, r array<string>")
    m = df.select(E.bert_similarity(F.col("s"), F.col("r"), 0.6).alias("m")).first().m
    assert (m.precision, m.passed, m.selected_reference) == (0.1, False, "x")


def test_dataset_checks(spark):
    q = spark.createDataFrame([("q1", "What is it?"), ("q2", "what is IT"), ("q3", "Something else entirely")], "id string, question string")
    e = spark.createDataFrame([("q1", "d", 0, None, "some words"), ("q3", "d", 1, "9", "other words")], "key string, document string, page_index int, printed_page string, text string")
    pages = spark.createDataFrame([("d", 0, "here are some  words"), ("d", 1, "other words, page 12")], "document string, page_index int, text string")
    c = spark.createDataFrame([("d", 1, 0, "some wo"), ("d", 2, 0, "other words")], "document string, page int, number int, text string")
    m = spark.createDataFrame([("d", "h", 2), ("e", "h", 1)], "path string, hash string, page_count int")
    f = spark.createDataFrame([("d", "h", 2)], "path string, hash string, page_count int")
    found = {(r.check, r.key): r.detail for r in E.validate_dataset(q, e, pages, c, m, f).collect()}
    assert found == {("manifest", "e"): "no file", ("duplicate question", "q1"): "2", ("near question", "q1"): "q2", ("evidence", "q3"): "printed page is not on the page", ("index", "q1"): "words"}


def test_fresh_index(spark, chunks, tmp_path):
    path = str(tmp_path / "i")
    first = lexical.fresh_index(chunks, path, "id", "text", "content_hash")
    files = sorted(p.name for p in (tmp_path / "i" / "postings").iterdir())
    lexical.fresh_index(chunks, path, "id", "text", "content_hash")
    assert files == sorted(p.name for p in (tmp_path / "i" / "postings").iterdir())
    assert first.lengths.count() == 2
    assert lexical.fresh_index(chunks.limit(1), path, "id", "text", "content_hash").lengths.count() == 1


def test_lock_and_requests():
    with S.one_at_a_time(), pytest.raises(S.Busy), S.one_at_a_time():
        pass
    S.check_request("q", "m", ("m",))
    for bad in ((" ", "m", ("m",)), ("q", "x", ("m",)), ("q", "m", ("m",), 3.0), ("q", "m", ("m",), 0.0, 21)):
        with pytest.raises(ValueError):
            S.check_request(*bad)


def test_usage_table(spark, tmp_path):
    path = str(tmp_path / "usage")
    event = lambda day, n: spark.createDataFrame([("m", f"2025-01-0{day} 10:00:00", n)], "model string, ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp"))
    add_usage(event(1, 5), path, "model", "ts", "tokens")
    assert [tuple(r) for r in add_usage(event(1, 7), path, "model", "ts", "tokens").collect()] == [("m", "2025-01-01", 2, 12)]
    assert {tuple(r) for r in add_usage(event(2, 1), path, "model", "ts", "tokens").collect()} == {("m", "2025-01-01", 2, 12), ("m", "2025-01-02", 1, 1)}
