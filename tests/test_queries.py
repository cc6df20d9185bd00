"""Every registered query of the library's own operators against its DuckDB SQL."""

import hashlib
import html
import itertools
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
import regex
from conftest import same_rows

from docloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, name):
    same_rows(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def slow_pieces(text, limit, marks=("\n\n", "\n", ". ", " ")):
    if len(text) <= limit:
        return [text]
    for i, mark in enumerate(marks):
        if mark in text:
            parts = text.split(mark)
            kept = [p + mark for p in parts[:-1]] + [parts[-1]]
            return [x for p in kept for x in slow_pieces(p, limit, marks[i + 1 :])]
    return [text[i : i + limit] for i in range(0, len(text), limit)]


def slow_passages(text, size, overlap):
    """By the definition: a passage ends at the last piece end in reach, or at reach if that is no gain over the overlap."""
    limit, back = 4 * size, 4 * overlap
    ends = set(itertools.accumulate(map(len, slow_pieces(text, limit))))
    out, start = [], 0
    while text.strip():
        reach = min(start + limit, len(text))
        end = next((e for e in range(reach, start + back, -1) if e in ends), reach)
        out.append(text[start:end])
        if end == len(text):
            break
        start = end - back
    return [p for p in out if p.strip()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_split_text_query(spark, sf):
    want = {(k, i, len(p), sha(p)) for k, t in texts(spark, sf).items() if t for i, p in enumerate(slow_passages(t, 400, 60))}
    assert {tuple(r) for r in catalog.QUERIES["split_text"](spark, sf).select("doc_id", "n", "length", "text_hash").collect()} == want


def test_chunk_hashes_query(spark, sf):
    """Passages of the heading blocks (which have SQL of their own), numbered within a document."""
    from docloom.operators.segment import heading_blocks
    from docloom.plans.segment_queries import _pages, short_line_heading

    blocks = heading_blocks(_pages(spark, sf), "doc_id", "page", "text", short_line_heading).orderBy("doc_id", "block").collect()
    want, counts = set(), {}
    for b in blocks:
        for p in [b.text] if len(b.text) <= 1600 else slow_passages(b.text, 400, 60):
            n = counts[b.doc_id] = counts.get(b.doc_id, -1) + 1
            labels = [x for x in (b.h4, b.h5, b.h6) if x is not None]
            want.add((f"{b.doc_id}:{n}", " > ".join([str(b.doc_id), *labels]) if labels else None, b.control_id, sha(p), len(p)))
    assert {(r.id, r.section, r.control_id, r.content_hash, r.length) for r in catalog.QUERIES["chunk_hashes"](spark, sf).collect()} == want


def test_nfkc_query(spark, sf):
    assert {r.doc_id: r.text_hash for r in catalog.QUERIES["nfkc_text"](spark, sf).collect()} == {k: t if t is None else sha(unicodedata.normalize("NFKC", t)) for k, t in texts(spark, sf).items()}


def test_stemmed_search_query(spark, sf):
    """BM25 over stems in Python, by the definition."""
    from docloom.functions.stemmer import STOP_WORDS, stem
    from docloom.plans.retrieval_queries import K, TOKENS

    known = {}
    cut = regex.compile(TOKENS)
    own = lambda t: [known.setdefault(w, stem(w)) for w in cut.findall((t or "").lower()) if w not in STOP_WORDS]
    docs = {k: Counter(own(t)) for k, t in texts(spark, sf).items()}
    size = {k: sum(c.values()) for k, c in docs.items()}
    average, df = sum(size.values()) / len(size), Counter(w for c in docs.values() for w in c)
    weight = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    want = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id % 20 = 0").collect():
        asked = own(r.text)
        score = {k: round(sum(weight.get(w, 0) * c[w] / (c[w] + 1.5 * (0.25 + 0.75 * size[k] / average)) for w in asked), 6) for k, c in docs.items()}
        want |= {(r.item_id, i): s for i, s in enumerate(sorted((s for s in score.values() if s > 0), reverse=True)[:K])}
    got = catalog.QUERIES["stemmed_search"](spark, sf).collect()
    assert want and {(r.query_id, r["rank"]): r.score for r in got} == pytest.approx(want, abs=2e-6)


def test_token_matching_query(spark, sf):
    """Every pair by one matrix, from the definition."""
    from docloom.operators.conversations import completed_turns
    from docloom.operators.token_matching import GramVectors
    from docloom.plans.retrieval_queries import TOKENS

    cut, model, vectors = regex.compile(TOKENS), GramVectors(), {}
    turns = [(r.conv_id, r.turn, *(cut.findall((t or "").lower()) for t in (r.answer, r.question))) for r in completed_turns(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]
    n, df = sum(1 for t in turns), Counter(w for t in turns for w in set(t[3]))
    weight = {w: math.log((n + 1) / (c + 1)) for w, c in df.items()}

    def unit(w):
        if w not in vectors:
            v = model([w])[0]
            vectors[w] = v / np.linalg.norm(v)
        return vectors[w]

    want = {}
    for conv, turn, a, q in turns:
        wa, wq = (np.array([weight.get(w, max(weight.values())) for w in side]) for side in (a, q))
        if wa.sum() > 0 and wq.sum() > 0:
            s = np.stack([unit(w) for w in a]) @ np.stack([unit(w) for w in q]).T
            p, r = s.max(axis=1) @ wa / wa.sum(), s.max(axis=0) @ wq / wq.sum()
            want[conv, turn] = (p, r, 2 * p * r / (p + r))
    got = {(r.conv_id, r.turn): (r.precision, r.recall, r.f1) for r in catalog.QUERIES["token_matching"](spark, sf).collect()}
    assert want and len(got) == len(turns) and all(v == pytest.approx(want[k], abs=2e-6) if k in want else v == (None, None, None) for k, v in got.items())


def test_review_sample_query(spark, sf):
    keys = sorted(texts(spark, sf))
    drawn = sorted(random.Random(42).sample(range(len(keys)), min(30, len(keys))))
    assert [r.doc_id for r in catalog.QUERIES["review_sample"](spark, sf).collect()] == [keys[i] for i in drawn]


def test_html_lines_query(spark, sf):
    """Against a plain reading of the pages with regular expressions, which suffice for them."""
    from docloom.sources.html import BLOCK_TAGS, HIDDEN_TAGS

    got = {r.page_id: (r.n_lines, r.text_hash) for r in catalog.QUERIES["html_lines"](spark, sf).collect()}
    hidden, block = "|".join(sorted(HIDDEN_TAGS)), "|".join(sorted(BLOCK_TAGS, key=len, reverse=True))
    same = total = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect():
        if r.html is None:
            continue
        text = re.sub(rf"(?is)<!--.*?-->|<!doctype.*?>|<({hidden})\b.*?</\1\s*>", "", r.html)
        text = re.sub(r"(?s)<[^>]*>", "", re.sub(rf"(?is)</?({block})\b[^>]*>", "\0", " ".join(text.split())))
        lines = [" ".join(html.unescape(x).split()) for x in text.split("\0")]
        lines = [x for x in lines if x]
        total += 1
        same += got[r.page_id] == (len(lines), sha("\n".join(lines)))
    assert total and same == total, (same, total)


def test_every_query_has_sql_or_a_test_here():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"split_text", "chunk_hashes", "nfkc_text", "review_sample", "html_lines", "stemmed_search", "token_matching"}


def test_entry_imports_and_covers_all(spark, sf):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
