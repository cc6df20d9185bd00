"""Store, sources, evaluation, alerts, conversations and streaming."""

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import judge as J
from docloom.functions import providers as P
from docloom.operators import alerts as A
from docloom.operators import conversations as C
from docloom.operators import evaluation as V
from docloom.operators import store as S
from docloom.operators.segment import chunk_documents
from docloom.plans import reports as R
from docloom.plans.evaluation_queries import results
from docloom.sources import files as FS
from docloom.sources import html, records
from docloom.streaming import ingest, rate


def built(files):
    pages = files.select(F.col("name").alias("doc_name"), F.lit(1).alias("page"), "text")
    return chunk_documents(pages, "doc_name", "page", "text").withColumn("embedding", P.embed(F.col("text"), P.HashEmbedder()))


def test_incremental_index(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / "a.txt").write_bytes(b"alpha\r\nbeta \xff")
    (docs / "sub/b.TXT").write_text("gamma")
    (docs / "c.bin").write_text("no")
    store = S.ChunkStore(spark, str(tmp_path / "store"))
    go = lambda **o: store.index(FS.documents(spark, str(docs)), built, **o)
    first = go()
    assert (first.documents, first.added, first.chunks) == (2, 2, 2)
    assert {r.doc_name: r.text for r in store.chunks().collect()} == {"a.txt": "alpha\nbeta �", "b.TXT": "gamma"}
    again = go()
    assert (again.skipped, again.added, again.updated, again.removed) == (2, 0, 0, 0)
    (docs / "a.txt").write_text("changed")
    (docs / "sub/b.TXT").unlink()
    third = go()
    assert (third.updated, third.removed, third.documents, third.chunks) == (1, 1, 1, 1)
    assert go(force=True).added == 1
    (docs / "sub/a.txt").write_text("same name")
    with pytest.raises(ValueError):
        go()


def test_paging(spark):
    rows = [(f"d:{i}",) for i in (10, 2, 1)] + [("d:x",), ("bad",)]
    page, total = S.page_of(spark.createDataFrame(rows, "id string"), "id", 3, 0)
    assert [r.id for r in page.collect()] == ["d:1", "d:2", "d:10"] and total == 5
    with pytest.raises(ValueError):
        S.page_of(page, "id", 0, 0)
    assert S.filtered(page, "10", "id").count() == 1


def test_paths(tmp_path):
    (tmp_path / "x.txt").write_text("x")
    assert FS.resolve_source(str(tmp_path), "x.txt").name == "x.txt"
    for bad in ("../x.txt", "/x.txt", "", "./x.txt"):
        with pytest.raises(ValueError):
            FS.resolve_source(str(tmp_path), bad)
    with pytest.raises(FileNotFoundError):
        FS.resolve_source(str(tmp_path), "y.txt")
    assert FS.archive_if_exists(str(tmp_path / "x.txt")).endswith("x_v1.txt")


def test_page_files(spark, tmp_path):
    FS.register_page_parser("lines", lambda b: b.decode().split("\f"))
    (tmp_path / "p.pdf").write_text("Head 1\nbody  one\fHead 2\nbody two\fHead 3\nbody three")
    row = FS.documents(spark, str(tmp_path), "lines").first()
    assert row.page_count == 3 and row.text == "body one\n\nbody two\n\nbody three"


def test_jsonl(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(r.a for r in records.read_jsonl_strict(spark, str(path), "a long").collect()) == [1, 2]
    assert records.read_jsonl_strict(spark, str(tmp_path / "none"), "a long").count() == 0
    for bad in ('{"a": 1}\n\n{"a": 2}\n', '{"a": 1}\n[1]\n', "nope\n"):
        path.write_text(bad)
        with pytest.raises(Exception):
            records.read_jsonl_strict(spark, str(path), "a long").collect()


def test_rules_and_urls(spark):
    lines = spark.createDataFrame([(0, "# c"), (1, ""), (2, "alert (sid:5; rev:1)"), (3, "alert (sid:5; rev:2)"), (4, "alert sid:7 ;")], "line_no int, value string")
    assert {r.sid: r.rule for r in records.parse_rules(lines).collect()} == {5: "alert (sid:5; rev:1)", 7: "alert sid:7 ;"}
    e = spark.createDataFrame([({"url": "http://x/1-20/"},), ({"url": None},), (None,), ({"url": "http://x/1-3"},)], "rule_documentation struct<url:string>")
    assert [(r.gid, r.sid) for r in records.rule_sources(e).collect()] == [(1, 3), (1, 20)]


def test_html(spark):
    page = "<head><title>t</title></head><p>a <b>b</b><br>c&amp;d<script>x</script></p><div> e </div>f"
    assert html.visible_lines(page) == ["a b", "c&d", "e", "f"]
    df = spark.createDataFrame([(["x", "Rule 1", "body", "Privacy", "z"],)], "l array<string>")
    cut = lambda a, b: df.select(html.section_between(F.col("l"), F.lit(a), F.lit(b)).alias("r")).first().r
    assert cut("Rule", "Privacy") == ["Rule 1", "body"]
    with pytest.raises(Exception):
        cut("none", "Privacy")


def test_manifest_defects(spark, tmp_path):
    path = str(tmp_path / "m")
    assert records.load_manifest(spark, path).count() == 0
    spark.createDataFrame([("a", "h", None, 1)], records.MANIFEST).write.parquet(path)
    assert records.load_manifest(spark, path).count() == 1
    spark.createDataFrame([("a", "h", None, 1), ("a", "g", None, 1)], records.MANIFEST).write.mode("overwrite").parquet(path)
    assert records.load_manifest(spark, path).count() == 0


def test_replies(spark):
    good = {"model_rank": 3, "justification": "j", "metrics_used": ["priority"]}
    cases = {
        json.dumps(good): 3,
        json.dumps(good | {"matched_sid": 7, "mismatch_explanation": None}): 3,
        json.dumps(good | {"model_rank": 6}): None,
        json.dumps(good | {"model_rank": True}): None,
        json.dumps(good | {"model_rank": "3"}): None,
        json.dumps(good | {"model_rank": 3.0}): None,
        json.dumps(good | {"justification": " "}): None,
        json.dumps(good | {"metrics_used": []}): None,
        json.dumps(good | {"metrics_used": [1]}): None,
        json.dumps(good | {"extra": 1}): None,
        json.dumps({k: v for k, v in good.items() if k != "justification"}): None,
        json.dumps(good) + "\n{}": None,
        "": None,
        "[1]": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.m for r in df.select("t", A.parse_reply(F.col("t"))["model_rank"].alias("m")).collect()} == cases
    v = spark.createDataFrame([('{"score": 0.5, "reasoning": "x"}',), ('{"score": 2, "reasoning": "x"}',), ('{"score": 1}',)], "t string")
    assert [r.s for r in v.select(A.parse_verdict(F.col("t"))["score"].alias("s")).collect()] == [0.5, None, None]


def test_anchor_error(spark):
    with pytest.raises(Exception):
        spark.createDataFrame([(4,)], "p int").select(A.anchored_rank(F.col("p"))).collect()


def test_evidence(spark):
    b = lambda e, i: sorted(spark.createDataFrame([(e, i)], "e string, i string").select(V.missing_tokens(F.col("e"), F.col("i")).alias("m")).first().m)
    assert b("high level text", "highlevel text") == []
    assert b("highlevel text", "high level") == ["text"]
    assert b("alone other", "x y") == ["alone", "other"]
    e = spark.createDataFrame([("q", 0, "d", 0, "a b c d e f g h i j"), ("q", 1, "d", None, "x y")], "question_id string, evidence_index int, document string, page_index int, text string")
    c = spark.createDataFrame([("q", "c1", "d", 1, "a b c d e f g h i"), ("q", "c2", "d", 2, "a b c d e f g h i j x y")], "question_id string, chunk_id string, document string, page int, text string")
    assert {(r.evidence_index, r.chunk_id) for r in V.match_evidence(e, c).collect()} == {(0, "c1"), (1, "c2")}


def test_passage_recall_is_exact(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    ps = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    ds = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    got = {(r.p, r.d) for r in V.passage_recall(spark.createDataFrame(ps, "p int, text string"), spark.createDataFrame(ds, "d int, text string"), "p", "d", least=0.7).collect()}
    assert got == {(p, d) for p, x in ps for d, y in ds if len(set(x.split()) & set(y.split())) / len(set(x.split())) >= 0.7}


def test_near_questions(spark):
    import difflib

    rng = random.Random(4)
    base = ["how often are accounts reviewed by the owner", "what does the firewall block", "who signs the policy"]
    qs = [(i, "".join(c for c in rng.choice(base) if rng.random() > 0.05)) for i in range(30)]
    got = {(r.key_a, r.key_b) for r in V.near_questions(spark.createDataFrame(qs, "k int, t string"), "k", "t").collect()}
    norm = lambda t: " ".join(t.split())
    assert got == {(a, b) for a, x in qs for b, y in qs if a < b and difflib.SequenceMatcher(None, norm(x), norm(y)).ratio() >= 0.9}


def test_best_reference_and_sample(spark):
    df = spark.createDataFrame([([0.2, 0.9, 0.9], ["a", "b", "c"])], "s array<double>, r array<string>")
    m = df.select(V.answer_similarity(F.col("s"), F.col("r"), 0.5).alias("m")).first().m
    assert (m.score, m.passed, m.selected_reference, m.selected_reference_index) == (0.9, True, "b", 1)
    rows = spark.range(100).withColumnRenamed("id", "k")
    assert [r.k for r in V.review_sample(rows, ["k"]).collect()] == sorted(random.Random(42).sample(range(100), 30))


def test_reports(spark, sf, tmp_path):
    rows = results(spark, sf)
    R.write_reports(rows, str(tmp_path / "out"), {"k": 10})
    assert "## Judge" in (tmp_path / "out/report.md").read_text()
    assert json.loads((tmp_path / "out/manual_review.json").read_text())["sample_size"] == 30
    flat = V.flatten_results(rows)
    assert len(flat.columns) == 50 or flat.columns[0] == "schema_version"
    R.write_snapshot(spark.range(3), str(tmp_path / "snap"))
    R.write_snapshot(spark.range(5), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 5


def test_judge(spark):
    part = {"score": 3, "justification": "j"}
    ok = {"correctness": part, "completeness": part | {"missing_claim_ids": []}, "faithfulness": part | {"unsupported_claims": [], "contradicted_claims": []}, "relevance": part | {"score": "2"}, "verdict": "pass"}
    assert J.parse_judgment(json.dumps(ok))["relevance"]["score"] == 2
    for bad in (ok | {"x": 1}, ok | {"verdict": "maybe"}, ok | {"correctness": part | {"score": 5}}, ok | {"correctness": part | {"score": 3.5}}):
        assert J.parse_judgment(json.dumps(bad)) is None
    text = json.dumps(ok)
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "REPAIR me")], "id int, payload string")
    cache = spark.createDataFrame([], "cache_key string, raw_response string")
    out = J.judge_rows(rows, cache, lambda p: text if "REPAIR\n" in p or p == "p" else "broken")
    assert out.where("judgment is not null").count() == 3
    fresh = J.new_cache_rows(out)
    assert fresh.count() == 1 or fresh.count() == 2
    again = J.judge_rows(rows, spark.createDataFrame(fresh.collect(), fresh.schema), lambda p: 1 / 0)
    assert again.where("cache_hit").count() == 3
    with pytest.raises(ValueError):
        J.cache_key({"question_id": " "})


def test_retries(spark):
    class Busy(Exception):
        status_code = 429

    calls = []

    def request():
        calls.append(1)
        if len(calls) < 3:
            raise Busy("slow down")
        return "ok"

    waits = []
    assert P.Attempts(5, waits.append).call(request) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(Busy):
        P.Attempts(5, waits.append).call(lambda: (_ for _ in ()).throw(Busy("tokens per day")))
    kinds = [(429, "slow down", False, "transient"), (429, "Tokens per day used", False, "quota"), (503, "tpd", False, "transient"), (400, "", False, "final"), (None, None, True, "transient"), (None, None, False, "final")]
    rows = spark.createDataFrame(kinds, "status int, told string, connection boolean, kind string")
    assert rows.where(P.failure_class(F.col("status"), F.col("told"), F.col("connection")) != F.col("kind")).count() == 0
    assert all(P.Failure(s, t or "", c, None).kind == k for s, t, c, k in kinds)
    assert P.retry_delay("7", 0) == 7 and P.retry_delay("900", 0) == 60 and P.retry_delay("x", 3) == 8
    assert P.retry_delay("Wed, 01 Jan 2025 00:00:30 GMT", 0, now=datetime(2025, 1, 1, tzinfo=UTC)) == 30


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.question, r.answer) for r in C.last_turns(df).orderBy("place").collect()] == [("d", "e"), ("a", "b")]
    message = "array<struct<id:string,role:string,text:string>>"
    h = [("x", "t", 1, 5, [("m", "user", "q")], 0), ("x", "t", 1, 9, [("m", "user", "q")], 1), ("y", "t", 1, 7, [("m", "robot", "q")], 2), ("z", "t", 1, 6, [], 3)]
    stored = spark.createDataFrame(h, f"id string, title string, created_at long, updated_at long, messages {message}, place int")
    loaded = C.load_history(stored)
    assert [(r.id, r.updated_at) for r in loaded.collect()] == [("z", 6), ("x", 5)]
    assert [r.id for r in C.save_history(loaded).collect()] == ["x"]
    assert C.delete(loaded, spark.createDataFrame([("x",)], "id string")).count() == 1


def test_token_delay():
    assert rate.token_delay([], 0, 5, 10) == 0
    assert rate.token_delay([(0, 6), (10, 3)], 20, 5, 10) == 40
    assert rate.token_delay([(0, 6)], 61, 5, 10) == 0
    assert rate.token_delay([(0, 6)], 1, 50, 10) == 60


def test_streaming_limits(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame([("k", float(t), 4.0) for t in (1000, 1001, 1002, 1070)], "k string, t double, n double").selectExpr("k", "cast(t as timestamp) as ts", "n").write.parquet(str(source / "p"))
    stream = spark.readStream.schema("k string, ts timestamp, n double").parquet(str(source / "p"))
    q = rate.limited(stream, "k", "ts", "n", 2, 100).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r.ts, r.allowed) for r in spark.table("limited").orderBy("ts").collect()] == [(1000.0, True), (1001.0, True), (1002.0, False), (1070.0, True)]


def test_streaming_ingest(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("one")
    store = S.ChunkStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        assert ingest.ingest(ingest.stream_files(spark, str(docs)), store, built, str(tmp_path / "cp")).awaitTermination(120)
        (docs / "b.txt").write_text("two")
    assert {r.text for r in store.chunks().collect()} == {"one", "two"}


def test_progress_of_a_streaming_run(spark, tmp_path):
    import time

    from docloom.streaming.progress import watched

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("one")
    store = S.ChunkStore(spark, str(tmp_path / "store"))
    with watched(spark) as log:
        with pytest.raises(S.Busy), S.one_at_a_time():
            pass
        assert ingest.ingest(ingest.stream_files(spark, str(docs)), store, built, str(tmp_path / "cp")).awaitTermination(120)
        for _ in range(100):  # listeners are told a little later
            if any(e["event"] == "done" for e in log.events):
                break
            time.sleep(0.1)
    rows = log.rows(spark).collect()
    assert [rows[0].event, rows[-1].event] == ["started", "done"] and any(r.text.endswith(" rows") and r.text != "0 rows" for r in rows if r.event == "progress")
    with S.one_at_a_time():
        pass
