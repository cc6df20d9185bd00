"""Block-max search against the plain search, and against BM25 in Python with stems."""

import math
import random
from collections import Counter

import pytest

from docloom.functions.stemmer import STOP_WORDS, stem
from docloom.operators import block_index as bi
from docloom.operators import lexical

OPTIONS = {"stop_words": (), "stemmed": False}


def corpus(spark, n=600, seed=2):
    """Many documents of frequent words, a few that hold rare ones."""
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(40)]
    texts = [" ".join(rng.choices(common, k=rng.randint(1, 60)) + (rng.choices(rare, k=3) if i % 50 == 0 else [])) for i in range(n)]
    texts += ["", None, "w1 " * 500]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def saved(spark, docs, path, **options):
    own = lexical.build_index(docs, "doc_id", "text", **(options or OPTIONS))
    lexical.save_index(own, path, lexical.signature(docs.selectExpr("doc_id", "sha2(text, 256) as h"), "doc_id", "h"))
    return lexical.load_index(spark, path)[0]


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_equal_to_the_plain_search_and_reads_less(spark, tmp_path):
    docs = corpus(spark)
    index = saved(spark, docs, str(tmp_path / "index"))
    blocks = bi.build_block_index(index, str(tmp_path / "blocks"), docs=8)
    assert blocks.documents == 603 and blocks.blocks == 76
    asked = spark.createDataFrame([(1, "r1 r2 w1"), (2, "w1 w1 w2"), (3, "r5"), (4, "unknown"), (5, ""), (6, None), (7, "w3 r9 r9 unknown")], "query_id int, query_text string")
    got = bi.block_search(blocks, asked, 5, digits=6, first=2, visits=True, **OPTIONS)
    want = rows(lexical.bm25_search(index, asked, 5, digits=6, **OPTIONS))
    assert want and rows(got) == want
    read = {r.query_id: (r.blocks_read, r.blocks) for r in got.collect()}
    assert read[1][0] < read[1][1] / 2  # rare words rule out blocks without them
    assert rows(bi.block_search(blocks, asked, 1000, digits=6, **OPTIONS)) == rows(lexical.bm25_search(index, asked, 1000, digits=6, **OPTIONS))


def test_ties_at_the_last_rank(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same words here") for i in range(200)] + [(900, "other")], "doc_id long, text string")
    blocks = bi.build_block_index(saved(spark, docs, str(tmp_path / "index")), str(tmp_path / "blocks"), docs=4)
    asked = spark.createDataFrame([(1, "same here")], "query_id int, query_text string")
    assert [r.doc_id for r in bi.block_search(blocks, asked, 6, digits=6, first=1, **OPTIONS).orderBy("rank").collect()] == list(range(6))


def test_stems_and_stop_words(spark, tmp_path):
    texts = ["The runners were running happily", "A runner runs", "Nations and nationalities", "national nation the the", "happiness is relational"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "running the nations"), (2, "happy runner"), (3, "the and")], "query_id int, query_text string")
    index = saved(spark, docs, str(tmp_path / "index"), stop_words=STOP_WORDS, stemmed=True)
    own = [[stem(w) for w in t.lower().split() if w not in STOP_WORDS] for t in texts]
    average, df = sum(map(len, own)) / len(own), Counter(w for t in own for w in set(t))
    want = []
    for q, text in ((1, "running nations"), (2, "happy runner")):
        scores = []
        for key, words in enumerate(own):
            tf = Counter(words)
            s = sum(math.log(1 + (5 - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / average)) for w in map(stem, text.split()))
            scores += [(-round(s, 6), key)] if s else []
        want += [(q, i, key, -s) for i, (s, key) in enumerate(sorted(scores))]
    same = lambda got: [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)
    assert same(rows(lexical.bm25_search(index, asked, 5, digits=6)))
    blocks = bi.build_block_index(index, str(tmp_path / "blocks"), docs=1)
    assert same(rows(bi.block_search(blocks, asked, 5, digits=6)))


def test_defined_cases(spark, tmp_path):
    docs = corpus(spark, 20)
    index = saved(spark, docs, str(tmp_path / "index"))
    blocks = bi.build_block_index(index, str(tmp_path / "blocks"))
    asked = spark.createDataFrame([(1, "w1")], "query_id int, query_text string")
    for bad in ({"k": 0}, {"k": 1, "first": 0}):
        with pytest.raises(ValueError):
            bi.block_search(blocks, asked, **bad)
    empty = bi.build_block_index(saved(spark, spark.createDataFrame([(1, None)], docs.schema), str(tmp_path / "i2")), str(tmp_path / "b2"))
    assert bi.block_search(empty, asked, 3).collect() == []


def test_parts_follow_the_number_of_postings():
    assert lexical.parts_for(0) == lexical.LEAST_PARTS and lexical.parts_for(100 << 22) == 100 and lexical.parts_for(1 << 60) == lexical.MOST_PARTS
