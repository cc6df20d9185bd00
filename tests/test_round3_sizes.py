"""What findings F16, F18, F22 to F24 and F26 say of growth, each on a small input: whole results, and work that follows the input."""

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from docloom.functions.providers import lexical_scorer
from docloom.io import settings, shared_dir
from docloom.operators import fusion, lexical, store
from docloom.plans import reports


def test_page_index_of_small_ranges(spark, tmp_path, monkeypatch):
    """F16: files, and so tasks and sampled keys, follow RANGE_ROWS and not the rows of a range; pages over files' ends are whole."""
    rows = spark.createDataFrame([(f"{'x' * (i % 3)}:{i * 7919 % 3001}" if i % 50 else f"bad{i}", i) for i in range(3001)] + [("x:5", -1), ("x:5", -2)], "id string, n int")
    monkeypatch.setattr(store, "RANGE_ROWS", 1000)
    store.build_page_index(rows, "id", str(tmp_path / "p"), 16)
    assert len(list((tmp_path / "p/rows").glob("__file=*"))) <= 4
    total = store.page_of(rows, "id", 200, 0)[1]
    want = [r.id for o in range(0, 3200, 200) for r in store.page_of(rows, "id", 200, o)[0].collect()]
    pages = [store.indexed_page(spark, str(tmp_path / "p"), "id", 200, o) for o in range(0, 3200, 200)]
    got = [r for page, _, _ in pages for r in page.collect()]
    assert [r.id for r in got] == want and Counter(r.n for r in got) == Counter([*range(3001), -1, -2])
    assert total == 3003 and {t for _, t, _ in pages} == {total} and max(n for _, _, n in pages) <= 200 // 16 + 4
    for offset in (5, 990, 1995, 2995, 3002):
        page, _, ranges = store.indexed_page(spark, str(tmp_path / "p"), "id", 9, offset)
        assert [r.id for r in page.collect()] == want[offset : offset + 9] and 1 <= ranges <= 3
    assert store.indexed_page(spark, str(tmp_path / "p"), "id", 9, 3003)[0].count() == 0


def test_csv_files_of_few_rows(spark, tmp_path, monkeypatch):
    """a file whose cells hold lines is one task when it is read, so no file holds all rows."""
    monkeypatch.setattr(reports, "FILE_ROWS", 100)
    rows = spark.range(0, 1000, 1, 3).selectExpr("id", "concat('a, \"b\"\nline ', id) as t")
    reports.write_csv(rows, str(tmp_path / "c"))
    files = sorted((tmp_path / "c").glob("part-*.csv"))
    assert len(files) >= 10 and all(f.read_text().count("line ") <= 100 and f.read_text().startswith("id,t\n") for f in files)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted((int(r.id), r.t) for r in back.collect()) == sorted((r.id, r.t) for r in rows.collect())
    reports.write_csv(rows.where("false"), str(tmp_path / "none"))
    assert [f.read_text() for f in (tmp_path / "none").glob("part-*.csv")] == ["id,t\n"]


def test_json_files_of_few_rows(spark, tmp_path, monkeypatch):
    """a model's rows are sorted by several tasks, and its files one after the other are in order."""
    monkeypatch.setattr(reports, "FILE_ROWS", 100)
    rows = spark.range(0, 1000, 1, 3).selectExpr("'a' as model", "(id * 7919) % 1000 as alert_id")
    reports.per_model_json(rows.unionByName(rows.where("alert_id < 50").selectExpr("'b' as model", "alert_id")), str(tmp_path / "j"))
    lines = {m: [f.read_text().splitlines() for f in sorted((tmp_path / f"j/model={m}").glob("part-*.json"))] for m in "ab"}
    assert len(lines["a"]) >= 8 and max(map(len, lines["a"])) <= 300
    assert [x for part in lines["a"] for x in part] == [f'{{"alert_id":{i}}}' for i in range(1000)]
    assert [x for part in lines["b"] for x in part] == [f'{{"alert_id":{i}}}' for i in range(50)]


def test_stems_counted_within_rows(spark):
    """words of a stem are one term of their document without a shuffle, a distinct list of words or a join."""
    rows = [(i, w.split()) for i, w in enumerate(["running runs run Reviews", "", "reviewed reviewing zz zz", "zz"])] + [(9, None)]
    own = spark.createDataFrame(rows, "k long, __tokens array<string>").selectExpr("k", "coalesce(__tokens, cast(array() as array<string>)) as __tokens")
    counts = lexical.term_counts(own, "k", True)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in counts.collect()) == [(0, "review", 1, 4), (0, "run", 3, 4), (2, "review", 2, 4), (2, "zz", 2, 4), (3, "zz", 1, 1)]
    docs = spark.createDataFrame([(1, "running runs"), (1, "run the reviews"), (2, None)], "k long, t string")
    index = lexical.build_index(docs, "k", "t")
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(tuple(r) for r in index.postings.collect()) == [("review", 1, 1), ("run", 1, 3)] and sorted(tuple(r) for r in index.terms.collect()) == [("review", 1), ("run", 1)]


def test_chunks_are_built_once(spark, tmp_path):
    """what a run of the index parses and embeds is computed once, and leaves no table aside."""
    rows = spark.createDataFrame([(f"s/{i}.txt", f"{i}.txt", f"a {i}\nb", f"h{i}") for i in range(300)], "identity string, name string, text string, hash string").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    def build(files):
        lines = files.select(F.col("name").alias("doc_name"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
        return lines.select(F.concat_ws(":", "doc_name", "n").alias("id"), "doc_name", told("line").alias("text"))

    own = store.ChunkStore(spark, str(tmp_path / "s"))
    own.index(rows, build)
    assert seen.value == 600
    done = own.index(rows.withColumn("hash", F.when(F.col("name") == "7.txt", "new").otherwise(F.col("hash"))), build)
    assert seen.value == 602 and (done.documents, done.chunks, done.updated, done.skipped) == (300, 600, 1, 299)
    assert sorted(r.text for r in own.chunks().collect()) == sorted([f"a {i}" for i in range(300)] + ["b"] * 300)
    assert not list(Path(shared_dir(spark)).glob("docloom-chunks-*"))


def above(df, mark):
    """The operators above the scan that has mark, from it upwards."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: re.search(r"[A-Za-z]", x).start()
    at = next(i for i, x in enumerate(lines) if "Scan" in x and mark in x)
    out, now = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if x.strip() and depth(x) < now:
            now = depth(x)
            out.append(x[now:].split(" ")[0].split("(")[0])
    return [x for x in out if "Join" in x or "Exchange" in x]


def test_searches_shuffle_no_postings_and_no_texts(spark, tmp_path):
    """saved postings and texts are large, what is asked of them is small and of known size."""
    docs = spark.range(0, 2000, 1, 2).selectExpr("id as k", "concat_ws(' ', 'w' || id % 7, 'w' || id % 11, sha2(cast(id as string), 512), sha2(cast(-id as string), 512), sha2(cast(id as string), 384)) as body", "array(cast(id % 3 + 1 as float), cast(id % 5 as float)) as v")
    docs.union(docs.where("k = 0").selectExpr("null", "'w1 w1'", "v")).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    texts, chunks = docs.where("k is not null").select("k", "body"), docs.where("k is not null").select("k", "v")
    asked = spark.createDataFrame([(1, "w1 w3"), (2, "w5 w5 unknown")], "query_id long, query_text string").withColumn("query_vector", F.array(F.lit(1.0), F.lit(0.5)))
    own = lexical.build_index(docs, "k", "body", (), False)
    lexical.save_index(own, str(tmp_path / "i"), lexical.signature(docs, "k", "body"))
    index = lexical.load_index(spark, str(tmp_path / "i"))[0]
    options = {"stemmed": False, "stop_words": (), "digits": 6}
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=20_000):
        found = lexical.bm25_search(index, asked, 5, **options)
        assert set(above(found, "tf#")[:2]) == {"BroadcastHashJoin"} and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        pool = fusion.retrieve(chunks, asked, 3, "k", "v", text="body", index=index, reranker=lexical_scorer, texts=texts, **options)
        assert above(pool, "body#")[0] == "BroadcastHashJoin"
    order = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert order(found, "query_id", "rank", "k", "score") == order(lexical.bm25_search(own, asked, 5, **options), "query_id", "rank", "k", "score") != []
    whole = fusion.retrieve(docs.where("k is not null"), asked, 3, "k", "v", text="body", index=own, reranker=lexical_scorer, **options)
    assert order(pool, "query_id", "rank", "k", "rerank_score") == order(whole, "query_id", "rank", "k", "rerank_score") != []


def test_saved_index_of_repeated_keys(spark, tmp_path):
    """where a key repeats, postings are merged and lengths are looked up as before."""
    docs = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a c c"), (3, None)], "k long, t string")
    own = lexical.build_index(docs, "k", "t", (), False)
    lexical.save_index(own, str(tmp_path / "i"), lexical.signature(docs, "k", "t"))
    index = lexical.load_index(spark, str(tmp_path / "i"))[0]
    assert "dl" not in index.postings.columns
    asked = spark.createDataFrame([(1, "a c")], "query_id long, query_text string")
    found = [sorted(map(tuple, lexical.bm25_search(x, asked, 5, stop_words=(), stemmed=False, digits=6).collect())) for x in (own, index)]
    assert found[0] == found[1] and len(found[0]) == 2
