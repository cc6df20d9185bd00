"""Packing: every id once, no padding, ids of the library, and the defined cases."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return packing.ByteVocabulary.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 0]


def power(n):
    return n & (n - 1) == 0


def check(rows, want, length=1024):
    """want: for each document (in any order) its ids; every id is in one piece, sequences are gapless and unpadded."""
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_document[r.doc_id].append(r)
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at == length or at < length and power(at)
    assert sum(n < length for n in (sum(x for _, x in own) for own in by_sequence.values())) <= length.bit_length()
    assert set(by_document) == set(want)
    for key, own in by_document.items():
        own.sort(key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == want[key]
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert {r.doc_tokens for r in own} == {len(want[key])}


def test_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op11_packing"](spark, sf).collect()
    sums, ids = defaultdict(dict), {r.doc_id: library(r.text) for r in docs}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        sums[r.doc_id][r.start] = (r.length, r.doc_tokens)
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert {k: sum(n for n, _ in v.values()) for k, v in sums.items()} == {k: len(v) for k, v in ids.items()}
    assert all(t == len(ids[k]) for k, v in sums.items() for _, t in v.values())


def test_pieces_and_levels(spark, vocabulary, library):
    texts = ["word " * n for n in range(1, 240)] + [None, "", "x", "a b" * 900, "<|endoftext|> mark"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(7)
    want = {i: library(t) for i, t in enumerate(texts)}
    for length, fan_in in ((1024, 512), (64, 2), (100, 2)):
        rows = packing.pack(docs, vocabulary, length=length, open_windows=3, fan_in=fan_in).collect()
        by = defaultdict(int)
        for r in rows:
            by[r.sequence_id] += r.length
        assert all(n == length or power(n) for n in by.values())
        check(rows, want, length)


def test_best_fit_keeps_documents_whole():
    windows = packing.Windows(100, 4)
    for n in (60, 30, 50, 40, 10, 50):
        windows.place(packing.Piece(n, 0, n, np.zeros(n, np.int32)))
    assert [[len(p.ids) for p in own] for own in windows.done] == [[60, 30, 10]]
    windows.finish()
    assert [sum(len(p.ids) for p in own) for own in windows.done[1:]] == [100, 32, 8]


def test_long_texts_are_cut_where_no_token_spans(vocabulary, library, monkeypatch):
    coder = packing.encoding(vocabulary)
    text = "".join(f"word{i}'s \n\n  ünï 東京{i}  —— \t x" for i in range(400)) + "y" * 3000 + " end"
    for size in (1, 7, 50, 1 << 20):
        monkeypatch.setattr(packing, "PART", size)
        parts = list(packing.text_parts(text, size))
        assert "".join(parts) == text
        for twice in (10, 1 << 24):
            monkeypatch.setattr(packing, "TWICE", twice)
            n, ids = packing.id_parts(text, coder, 0)
            ids = np.concatenate(list(ids)).tolist()
            assert n == len(ids) and ids == library(text)


def test_defined_cases(spark, vocabulary, library):
    """Null keys and texts, repeated rows, clashing extra columns, an empty table; bad arguments."""
    schema = "key string, start string, ids string, doc_id long, text string"
    rows = [("a", "b", "c", None, "some text"), ("a", "b", "c", 5, None), ("a", "b", "c", 5, None), ("a", "b", "c", 6, "again"), ("a", "b", "c", 6, "again")]
    got = packing.digests(packing.pack(spark.createDataFrame(rows, schema), vocabulary))
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    sizes = defaultdict(int)
    for r in got.collect():
        sizes[r.doc_id] += r.length
    assert sizes == {None: len(library("some text")), 5: 2, 6: 2 * len(library("again"))}
    assert packing.pack(spark.createDataFrame([], schema), vocabulary).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], schema), vocabulary, open_windows=0)
