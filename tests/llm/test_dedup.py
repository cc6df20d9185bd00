"""Embedding near-dedup, suffix dedup and the Jaccard join against brute force."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from docloom.llm import embedding_dedup, jaccard_join, suffix_dedup
from docloom.llm.components import connected_components
from docloom.llm.suffix_sort import sort_group


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500, k) for k in range(501, 700)]
    u = Union(range(701))
    for a, b in edges:
        u.join(a, b)
    for few in (0, 1000):  # in rounds, and in one task
        rows = connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()
        assert {r.node: r.component for r in rows} == {n: u.find(n) for a, b in edges if a != b for n in (a, b)} and len(rows) == len({r.node for r in rows})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_sort():
    for seed in range(300):
        rng = random.Random(seed)
        base = bytes(rng.choices(b"ab", k=60))
        strings = [base[: rng.randint(0, 60)] + bytes(rng.choices(b"abc", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 15))]
        out = sort_group(strings, list(range(len(strings))), 0, rng.choice([0, 3, 16]))
        ordered = [strings[i] for i, _ in out]
        assert sorted(i for i, _ in out) == list(range(len(strings))) and ordered == sorted(strings) and out[0][1] == -1
        for a, b, (_, n) in zip(ordered, ordered[1:], out[1:]):
            assert n == len(os.path.commonprefix([a, b]))


def brute_removed(rows, length):
    """Per document (key and text): what windows cover that start earlier by (key, hash of the text, start)."""
    tag = lambda t: np.uint64(xxhash.xxh64((t or "").encode(), seed=42).intdigest()).astype(np.int64)
    docs = sorted({(k, t or "") for k, t in rows}, key=lambda d: (d[0] is None, d[0] or 0 if not isinstance(d[0], str) else d[0], tag(d[1])))
    first, out = {}, {}
    for n, (k, t) in enumerate(docs):
        data, gone = t.encode(), set()
        for i in range(len(data) - length + 1):
            if first.setdefault(data[i : i + length], (n, i)) < (n, i):
                gone.update(range(i, i + length))
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        out[k, t] = (len(data), len(gone), sum(i in gone and i - 1 not in gone for i in range(len(data))), hashlib.sha256(kept).hexdigest())
    return {(k, t): out[k, t or ""] for k, t in rows}


@pytest.mark.parametrize("hot", [16, 0])
def test_suffix_query(spark, sf, hot):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(5)
    want = brute_removed([(r.doc_id, r.text) for r in docs.collect()], 100)
    rows = suffix_dedup.dedup_digests(docs, hot=hot).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == {k: v for (k, _), v in want.items()} and len(rows) == len(want)


@pytest.mark.parametrize("hot", [16, 0])
def test_suffix_cases(spark, hot):
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdé ", k=150))
    rows = [(i, rng.choice([passage, passage[:120], passage[20:]]) + "".join(rng.choices("xyz", k=rng.randint(0, 40))) + passage[: rng.randint(90, 110)]) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "a" * 5000), (104, "ab" * 700), (105, "a" * 99), (106, "a" * 100), (None, passage), (5, rows[5][1])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_digests(docs, hot=hot).collect()]
    want = brute_removed(rows, 100)
    order = lambda x: (x[0] is None, x)
    assert sorted(got, key=lambda x: str(x)) == sorted([(k, *want[k, t]) for k, t in rows], key=lambda x: str(x)), order
    assert suffix_dedup.dedup_digests(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in suffix_dedup.remaining_text(docs, hot=hot).collect()}
    assert texts[102] == "short" and texts[100] == ""


@pytest.mark.parametrize("hot", [16, 0])
def test_suffix_identity(spark, hot):
    """Unlike texts under one key, or under none, keep what repeats nowhere else."""
    rng = random.Random(3)
    a, b = ("".join(rng.choices("abcdefgh", k=200)) for _ in range(2))
    for rows in ([(1, a), (2, a), (2, b)], [(1, a), (None, a), (None, b)]):
        got = {(r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
        empty, whole = hashlib.sha256(b"").hexdigest(), lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got == {(1, 0, whole(a)), (rows[1][0], 200, empty), (rows[2][0], 0, whole(b))}
    parts = ["".join(rng.choices("abcd", k=rng.randint(60, 160))) for _ in range(12)]
    for name in (lambda i: i, lambda i: f"id-{i}", lambda i: None if i < 3 else i):
        rows = [(name(rng.randint(0, 9)), "".join(rng.choices(parts, k=rng.randint(1, 4)))) for _ in range(60)]
        rows += rng.choices(rows, k=10)
        kind = "string" if isinstance(name(5), str) else "long"
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_digests(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3), hot=hot).collect()]
        want = brute_removed(rows, 100)
        assert sorted(got, key=str) == sorted([(k, *want[k, t]) for k, t in rows], key=str)


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def brute_jaccard(rows, width, p, q):
    sets = {k: shingle_set(t, width) for k, t in rows}
    u, held = Union(sets), defaultdict(list)
    for k in sorted(sets):
        shared = defaultdict(int)
        for s in sets[k]:
            for o in held[s]:
                shared[o] += 1
            held[s].append(k)
        for o, n in shared.items():
            if q * n >= p * (len(sets[k]) + len(sets[o]) - n):
                u.join(k, o)
    return {k: (len(s), u.find(k)) for k, s in sets.items()}


def corpus(seed, n, size=(1, 80)):
    """Families of edited copies, some of them large, and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.7:
            text = list(rng.choice(base[:3] if rng.random() < 0.6 else base))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [rng.choice(words)]
            text = text or ["w"]
        else:
            text = rng.choices(words, k=rng.randint(*size))
        base.append(text)
        rows.append((i, " ".join(text)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "oNE"), (n + 5, "one two"), (n + 6, "x " * 30_000), (n + 7, "x " * 29_000)]
    return rows


@pytest.mark.parametrize("seed, width, p, deleting", [(0, 4, 85, None), (1, 5, 80, None), (2, 3, 70, True), (3, 4, 85, False), (4, 4, 80, 0.5)])
def test_jaccard_brute(spark, monkeypatch, seed, width, p, deleting):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = corpus(seed, 250)
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, width=width, similarity=jaccard_join.Similarity(p, 100), deleting=deleting).collect()}
    assert got == brute_jaccard(rows, width, p, 100)


def test_jaccard_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op10_jaccard_join(spark, sf).collect()}
    assert got == brute_jaccard(rows, 4, 85, 100)


def test_jaccard_cases(spark):
    docs = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (3, "A B C D E")], "doc_id long, text string")
    rows = jaccard_join.near_duplicates(docs).collect()
    assert len(rows) == 4 and {r.component_id for r in rows} == {3}
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_jaccard_identity(spark):
    """Unlike texts under one key, and near copies without a key, brute-forced by row."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choices(words, k=60) for _ in range(5)]
    for name in (lambda i: i % 7, lambda i: None if i % 3 else i, lambda i: f"id{i % 5}"):
        rows = []
        for i in range(60):
            text = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((name(i), " ".join(text), i))
        rows += [(*r[:2], 60 + n) for n, r in enumerate(rng.choices(rows, k=8))]
        linked = brute_jaccard([(i, t) for _, t, i in rows], 4, 85, 100)
        least = defaultdict(list)
        for k, _, i in rows:
            if k is not None:
                least[linked[i][1]].append(k)
        kind = "string" if isinstance(name(1), str) else "long"
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string, row int").repartition(3), width=4, similarity=jaccard_join.Similarity(85, 100)).collect()
        want = [(k, linked[i][0], min(least[linked[i][1]], default=None)) for k, _, i in rows]
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted(want, key=str)
    text = " ".join(f"a{i}" for i in range(100))
    rows = [(2, text), (None, text.replace("a99", "b")), (5, "x y z " + text[:50]), (5, text.replace("a0 ", "c ")), (7, text[:200])]
    got = [(r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(2, 2), (None, 2), (5, 5), (5, 2), (7, 7)], key=str)


def test_cost_model_allots_both_kinds(spark):
    """Where many sets share all but a few shingles of a segment, deletion neighbourhoods are cheaper; elsewhere exact segments are."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    crowd = [" ".join(rng.choices(words, k=rng.randint(4, 30))) for _ in range(1500)]
    plain = [" ".join(f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(100, 300))) for _ in range(300)]
    own = spark.createDataFrame([(t,) for t in crowd + plain], "__text string").repartition(3)
    s = jaccard_join.Similarity(80, 100)
    bands, found = jaccard_join.allot(own, 1, s, spark.sparkContext.broadcast(None), 1800, sample=2000)
    used = {r["band"] for r in found}
    assert any(bands[b].deleting for b in used) and any(not bands[b].deleting for b in used)
    assert all(b.segments - b.spare + b.deleting >= s.most_apart(b.hi, b.hi * 100 // 80) + 1 for b in bands)
    for b in used:  # the cheapest measured one is taken
        costs = {r["part"]: r["cost"] for r in found if r["band"] == b}
        assert bands[b] == jaccard_join.make_bands(s, deleting=min(costs, key=lambda p: (costs[p], p)))[b]


def test_pigeonhole_signatures():
    """Every pair of sets that is similar enough shares a key, for both kinds of segments."""
    rng = np.random.default_rng(0)
    s = jaccard_join.Similarity(80, 100)
    for deleting in (None, True, False, 0.25, 0.5):
        bands = jaccard_join.make_bands(s, 5000, deleting)
        for n in (1, 2, 3, 5, 8, 13, 21, 40, 77, 150, 400):
            for _ in range(20):
                a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
                b = a.copy()
                for _ in range(int(rng.integers(0, max(1, n // 4) + 1))):
                    b = b[1:] if rng.random() < 0.5 and len(b) > 1 else np.append(b, np.uint64(rng.integers(1 << 41, 1 << 42)))
                a, b = np.unique(a), np.unique(b)
                shared = len(np.intersect1d(a, b))
                if 100 * shared >= 80 * (len(a) + len(b) - shared):
                    keys, of = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands, s)
                    assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()), (n, deleting)


def brute_vectors(rows, threshold):
    ok = [(k, np.array(v, float) / np.abs(np.array(v, float)).max()) for k, v in rows if v is not None and len(v) and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.abs(np.array(v, float)).max() > 0]
    links, u = defaultdict(int), Union([k for k, _ in rows])
    for i, (k, v) in enumerate(ok):
        for o, w in ok[i + 1 :]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[k] += 1
                links[o] += 1
                u.join(k, o)
    return {k: (links[k], u.find(k), u.find(k) == k) for k, _ in rows}


@pytest.mark.parametrize("group", [32, 2])
def test_vectors_brute(spark, group):
    rng = np.random.default_rng(group)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(24)
        rows += [centre + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.25]) for _ in range(int(rng.integers(1, 25)))]
    rows += [rows[0] * 2.0**700, rows[0] * 2.0**-700, rows[0], rows[0] * 2, rows[1], np.zeros(24), np.full(24, np.nan), np.full(24, np.inf), rng.standard_normal(5)]
    listed = [(i, v.tolist()) for i, v in enumerate(rows)] + [(900, None), (901, []), (902, [1.0] * 23 + [None]), (903, rng.standard_normal(5).tolist())]
    df = spark.createDataFrame([(k, v, 0) for k, v in listed], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, group=group).collect()}
    assert got == brute_vectors(listed, 0.9)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vector_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.op4_embedding_dedup(spark, sf).collect()}
    assert got == brute_vectors(rows, 0.9)


def test_tables_miss_no_more_than_promised():
    """Pairs exactly at the threshold: 4,000 of them, with the tables for 100,000 vectors, and 1e-4 promised."""
    rng = np.random.default_rng(8)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 4000, 64)))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    bits, tables = embedding_dedup.tables_for(100_000, 0.9)
    met = np.zeros(4000, bool)
    for at in range(0, 4000, 500):
        rows = np.concatenate([a[at : at + 500], b[at : at + 500]])
        batch = pa.RecordBatch.from_arrays([pa.array([i.to_bytes(16, "big") for i in range(1000)], pa.binary()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["cid", "x"])
        (raw,) = (zstandard.ZstdDecompressor().decompress(z.as_py()) for part in embedding_dedup._tables(iter([batch]), bits, tables, 1, "<f8") for z in part.column(1))
        n = len(raw) // 20
        key, node = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, np.uint8, 16 * n, 4 * n).reshape(n, 16)[:, 14:].astype(int) @ [256, 1]
        left = {(k, i) for k, i in zip(key.tolist(), node.tolist()) if i < 500}
        for k, i in zip(key.tolist(), node.tolist()):
            if i >= 500 and (k, i - 500) in left:
                met[at + i - 500] = True
    missed = int((~met).sum())
    print(f"missed {missed} of 4000")
    assert missed <= 4


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    turn = embedding_dedup.rotation(64, 256)
    a = rng.standard_normal((3000, 64))
    b = a * rng.uniform(-1, 1, (3000, 1)) + rng.standard_normal((3000, 64))
    signs, factor = embedding_dedup.encode(a, turn)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    guess, bound = embedding_dedup.estimate(signs, factor, unit(b) @ turn.T)
    true = (unit(a) * unit(b)).sum(axis=1)
    assert abs((guess - true).mean()) < 0.01 and (np.abs(guess - true) < bound).all()


def test_linked_pairs_are_complete_in_parts():
    rng = np.random.default_rng(1)
    base = [rng.choice(5000, int(n), replace=False) for n in rng.integers(1, 60, 6)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.95], rng.choice(5000, 2)])).astype(np.uint64) for b in base for _ in range(7)]
    s = jaccard_join.Similarity(80, 100)
    similar = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    n = len(sets)
    one, two = np.arange(n // 2), np.arange(n // 2, n)
    for most in (1, 100, 1 << 20):
        got = {(min(i, j), max(i, j)) for x, y in jaccard_join._linked_pairs(sets, np.arange(n), None, s, most) for i, j in zip(x.tolist(), y.tolist()) if i != j}
        assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if similar(i, j)}
        got = {(i, j) for x, y in jaccard_join._linked_pairs(sets, one, two, s, most) for i, j in zip(x.tolist(), y.tolist())}
        assert got == {(i, j) for i in one.tolist() for j in two.tolist() if similar(i, j)}
