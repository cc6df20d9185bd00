"""Retrieval operators: errors, ties, empty inputs, and the whole answer plan."""

import pytest
from pyspark.sql import functions as F

from docloom.config import Settings, load
from docloom.functions.providers import HashEmbedder, embed, extractive_generator, lexical_scorer
from docloom.functions.vectors import cosine, strict_cosine
from docloom.operators import fusion, lexical
from docloom.operators.dense import dense_topk
from docloom.plans.answer import ask, rewritten, stream_answer


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d:0", "d", "The firewall blocks traffic from the network."), ("d:1", "d", "Accounts are reviewed every year."), ("e:0", "e", "Backups of AC-2 records are encrypted.")]
    return spark.createDataFrame(rows, "id string, doc_name string, text string").withColumn("embedding", embed(F.col("text"), HashEmbedder())).cache()


def test_topk_ties_and_errors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<double>")
    rows = sorted(dense_topk(v, q, 3).collect(), key=lambda r: r["rank"])
    assert [(r.vec_id, round(r.score, 6)) for r in rows] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert dense_topk(v.limit(0), q, 3).count() == 0
    with pytest.raises(ValueError):
        dense_topk(v, q, 0)


def test_cosines(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0.0
    for bad in (strict_cosine(F.col("a"), F.col("b")), cosine(F.col("a"), F.array(F.lit(1.0)))):
        with pytest.raises(Exception):
            df.select(bad).collect()


def test_bm25(spark, chunks, tmp_path):
    index = lexical.build_index(chunks, "id", "text")
    q = spark.createDataFrame([(1, "encrypted backup"), (2, "zzz"), (3, "AC-2")], "query_id long, query_text string")
    rows = lexical.bm25_search(index, q, 2).collect()
    assert {(r.query_id, r.id) for r in rows} == {(1, "e:0"), (3, "e:0")}
    signed = lexical.signature(chunks.withColumn("h", F.sha2("text", 256)), "id", "h")
    path = str(tmp_path / "index")
    with pytest.raises(lexical.IndexMissing):
        lexical.load_index(spark, path)
    lexical.save_index(index, path, signed)
    loaded, mark, n = lexical.load_index(spark, path)
    assert n == 3 and mark == signed.first().signature
    assert loaded.terms.count() == index.terms.count()
    spark.range(1).write.mode("overwrite").parquet(f"{path}/metadata")
    with pytest.raises(lexical.IndexCorrupt):
        lexical.load_index(spark, path)


def test_rrf(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query_id long, id string, rank int")
    b = spark.createDataFrame([(1, "y", 0), (1, "z", 1)], "query_id long, id string, rank int")
    rows = sorted(fusion.rrf_fuse([a, b], "id").collect(), key=lambda r: r["rank"])
    assert [r.id for r in rows] == ["y", "x", "z"] and rows[0].rrf_score == pytest.approx(1 / 61 + 1 / 62)
    with pytest.raises(Exception):
        fusion.rrf_fuse([a.union(a)], "id").collect()
    with pytest.raises(ValueError):
        fusion.rrf_fuse([a], "id", k=0)


def test_retrieve_modes(spark, chunks):
    q = spark.createDataFrame([(1, "reviewed accounts")], "query_id long, query_text string").withColumn("query_vector", embed(F.col("query_text"), HashEmbedder()))
    index = lexical.build_index(chunks, "id", "text")
    assert fusion.retrieve(chunks, q, 1, "id", "embedding", mode="dense").first().id == "d:1"
    assert fusion.retrieve(chunks, q, 1, "id", "embedding", index=index, reranker=lexical_scorer).first().id == "d:1"
    for bad in ({"mode": "hybrid"}, {"mode": "other"}):
        with pytest.raises(ValueError):
            fusion.retrieve(chunks, q, 1, "id", "embedding", **bad)


def test_ask(spark, chunks):
    index = lexical.build_index(chunks, "id", "text")
    history = [("Which accounts?", "All accounts.")]
    q = spark.createDataFrame([(1, "Are backups encrypted?", []), (2, "When are they reviewed?", history)], "question_id long, question string, history array<struct<question:string,answer:string>>")
    generator = lambda prompt, model: '"accounts reviewed"' if "Rewrite" in prompt else extractive_generator(prompt)
    rows = {r.question_id: r for r in ask(q, chunks, index, HashEmbedder(), generator, limit=1).collect()}
    assert rows[1].answer == "Backups of AC-2 records are encrypted. [S1]" and rows[1].rewritten_question is None and not rows[1].refused
    assert rows[2].rewritten_question == "accounts reviewed" and rows[2].sources[0].id == "d:1"
    empty = ask(q, chunks.limit(0), lexical.build_index(chunks.limit(0), "id", "text"), HashEmbedder(), generator, limit=1).collect()
    assert all(r.refused and not r.sources for r in empty)
    assert [e["event"] for e in stream_answer("p", "m", lambda p, m: iter("ab"))] == ["token", "token", "final"]


def test_rewritten(spark):
    cases = {"'good query'": "good query", "": "q", "x" * 301: "q", "\n first \nsecond": "first", '""': "q"}
    df = spark.createDataFrame([("q", k) for k in cases] + [("q", None)], "q string, r string")
    found = {r.r: r.n for r in df.select("r", rewritten(F.col("q"), F.col("r")).alias("n")).collect()}
    assert found == cases | {None: "q"}


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("DOCLOOM_CHUNK_SIZE", "100")
    assert load().chunk_size == 100 and load(chunk_overlap=10).chunk_overlap == 10
    with pytest.raises(ValueError):
        Settings(chunk_size=10, chunk_overlap=10)
