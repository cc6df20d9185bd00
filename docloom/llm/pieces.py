"""SentencePiece encoding and decoding: the model's own segmentation into pieces.

All pieces are in an Aho-Corasick automaton. One pass over a string yields, for every position, the pieces
that end there (the automaton's output links), and each of them relaxes the best score of that position
(Viterbi). In a Unigram model a piece adds its score. In a BPE model the scores are ranks of merges and must not be
added; there a piece costs nothing if merging it together with the piece before it leaves the two as they are, and
everything if not. Merging treats a text as it treats each two neighbours of the outcome, so exactly one piece
fits at every position, and the path through the last one is the library's segmentation. Whether two pieces fit is
worked out once, by merging the two, and remembered.

A character without a piece of its own becomes its UTF-8 byte pieces (in a Unigram model at a cost of ten below the
lowest score). The empty mark of the vocabulary (U+2581) stands for a space; a text that holds
that character itself gets byte pieces for it, so decoding is exact for every text. For texts without that
character the ids are those of the library.

A string is cut, before the search, between characters that stand side by side in no piece: no piece can
span such a place, so the parts can be solved one by one and the result is the same. Parts are remembered
per worker in a table of at most CACHE entries.

Scale: one pass, no shuffle; the vocabulary (a fixed size) is broadcast and each worker builds its
automaton once. The model file is read on the driver only and its path is a parameter.

Defined results: a null text has null ids; an empty one an empty list. Equal scores of a Unigram model: the longest
last piece. Texts count whole; repeated rows give repeated rows; extra columns stay, and result columns
replace columns of the same name.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import read, small_batches, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE, FITS = 250_000, 500_000
UNKNOWN = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values (numbers or bytes) of a serialized protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


def _is_bpe(model: bytes) -> bool:
    """Whether the trainer settings (field 2) of a serialized model name model type 2 (field 3)."""
    return any(n == 2 and any(k == 3 and v == 2 for k, v in _fields(x)) for n, x in _fields(model) if isinstance(x, bytes))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces (with spaces for the mark) and scores by id; byte_ids by byte value; unk for what has no bytes."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]  # neither control, unknown nor byte
    byte_ids: tuple[int, ...]
    merges: bool = False  # a BPE model: scores are the order of merges

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in ids]
        bytes_at = {names[i]: i for i in ids if sp.is_byte(i)}
        byte_ids = tuple(bytes_at[f"<0x{b:02X}>"] for b in range(256))
        plain = tuple(not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids)
        return Vocabulary(tuple(p.replace(SPACE, " ") for p in names), tuple(sp.get_score(i) for i in ids), plain, byte_ids, _is_bpe(sp.serialized_model_proto()))


class Encoder(dict):
    """Maps a part of a text to the little-endian 32-bit ids of its best segmentation."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        v = self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        pairs, self.single = set(), set()
        for i, piece in enumerate(v.pieces):
            if v.plain[i] and piece:
                self.automaton.add_word(piece, (len(piece), v.scores[i], i))
                pairs.update(zip(piece, piece[1:]))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.pairs = pairs
        self.number = {p: i for i, p in enumerate(v.pieces) if v.plain[i] and p}
        self.size, self.lengths = len(v.pieces), [len(p) for p in v.pieces]
        self.fit: dict[int, bool] = {}  # by (piece before + 1) * size + piece
        self.unknown = min((s for s, p in zip(v.scores, v.plain) if p), default=0.0) - UNKNOWN
        # A cut before each run of spaces and around line ends, if no piece spans such a place.
        stuck = any(b == " " and a != " " for a, b in pairs)
        self.parts = None if stuck else re.compile(r"\n| *[^ \n]+| +" if not any("\n" in p for p in pairs) else r" *[^ ]+| +")
        self.text_of = [p.encode() if v.plain[i] else b"" for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_ids):
            self.text_of[i] = bytes([b])

    def __missing__(self, part: str) -> bytes:
        """Search the part; a long one is cut first between characters that no piece joins."""
        cuts = [0, *(i for i in range(1, len(part)) if (part[i - 1], part[i]) not in self.pairs), len(part)] if len(part) > 64 else []
        if len(cuts) > 2:
            found = b"".join([self[part[a:b]] for a, b in zip(cuts, cuts[1:])])
        else:
            ids = self.search_merges(part) if self.vocabulary.merges else self.search(part)
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(self) >= CACHE:
            self.clear()
        if len(part) <= 64:
            self[part] = found
        return found

    def merge(self, text: str) -> list[int]:
        """Ids of a short text (-1 for a character without a piece) by merging neighbours, best score and leftmost first."""
        symbols = list(text)
        while len(symbols) > 1:
            found = [(-self.vocabulary.scores[self.number[a + b]], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.number]
            if not found:
                break
            i = min(found)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return [self.number.get(x, -1) for x in symbols]

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging leaves these two neighbours as they are; before is -1 at a start and after an unknown character."""
        if len(self.fit) >= FITS:
            self.fit.clear()
        own = [piece] if before < 0 else [before, piece]
        known = self.fit[(before + 1) * self.size + piece] = self.merge("".join(self.vocabulary.pieces[i] for i in own)) == own
        return known

    def search_merges(self, part: str) -> list[int]:
        """Ids of the segmentation of a BPE model: a position's score is 0 once a piece fits there, so the first that fits stays."""
        n, known, size_of = len(part), self.fit.get, self.size
        last = [None] * (n + 1)  # the piece that ends at each position; -1: an unknown character, or the start
        last[0] = -1
        strange = [i for i, c in enumerate(part) if c not in self.single] if not self.single.issuperset(part) else []
        strange.append(n)
        next_strange = iter(strange)
        stop = next(next_strange)
        for at, (size, _, piece) in self.automaton.iter(part):
            at += 1
            while stop < at:  # characters without a piece of their own end where they stand
                if last[stop] is not None:
                    last[stop + 1] = -1
                stop = next(next_strange)
            if last[at] is None:
                before = last[at - size]
                if before is not None:
                    ok = known((before + 1) * size_of + piece)
                    if self.fits(before, piece) if ok is None else ok:
                        last[at] = piece
        while stop < n:
            if last[stop] is not None:
                last[stop + 1] = -1
            stop = next(next_strange)
        ids: list[int] = []
        lengths = self.lengths
        while n:
            piece = last[n]
            if piece >= 0:
                ids.append(piece)
                n -= lengths[piece]
            else:
                ids.extend([self.vocabulary.byte_ids[b] for b in reversed(part[n - 1].encode())])
                n -= 1
        ids.reverse()
        return ids

    def search(self, part: str) -> list[int]:
        """Ids of the best-scoring segmentation of a Unigram model."""
        n = len(part)
        best, back = [float("-inf")] * (n + 1), [(-1, 1)] * (n + 1)
        best[0] = 0.0
        done = 0

        def settle(end: int) -> None:
            nonlocal done
            while done < end:  # characters that have no piece of their own
                if part[done] not in self.single and best[done] + self.unknown > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + self.unknown, (-1, 1)
                done += 1

        for last, (size, score, piece) in self.automaton.iter(part):
            settle(last)
            reached = best[last + 1 - size] + score
            if reached > best[last + 1]:
                best[last + 1], back[last + 1] = reached, (piece, size)
        settle(n)
        ids: list[int] = []
        while n:
            piece, size = back[n]
            ids.extend([piece] if piece >= 0 else [self.vocabulary.byte_ids[b] for b in reversed(part[n - 1].encode())])
            n -= size
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = " " + text  # the mark that begins every text
        return b"".join(map(self.__getitem__, self.parts.findall(text) if self.parts else [text]))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker process."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _lists(parts: list[bytes | None]) -> pa.Array:
    sizes = np.array([len(p or b"") // 4 for p in parts], np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p or b"" for p in parts), "<i4"), pa.int32())
    mask = pa.array([p is None for p in parts])
    return pa.ListArray.from_arrays(offsets, values, mask=mask)


def _chunks(column: pa.Array, limit: int = 8 << 20) -> Iterator[pa.Array]:
    """Slices of about limit characters, so that ids of a batch stay small."""
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, side="right")))
        yield a, column.slice(a, b - a)
        a = b


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """The columns carry (default: all) and ids: array<int>."""
    spark = docs.sparkSession
    small_batches(spark)
    carry = [c for c in (docs.columns if carry is None else carry) if c != ids]
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for a, part in _chunks(batch.column(0)):
                found = [None if t is None else own.encode(t) for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(part)) for c in batch.columns[1:]), _lists(found)], names=[*carry, ids])

    fields = [T.StructField(c, docs.schema[c].dataType) for c in carry] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    return docs.select(F.col(text).cast("string").alias("__text"), *carry).mapInArrow(tidy(run), T.StructType(fields))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """The columns carry (default: all) and the text of ids."""
    spark = encoded.sparkSession
    carry = [c for c in (encoded.columns if carry is None else carry) if c != text]
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            found = [None if x is None else own.decode(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], names=[*carry, text])

    fields = [T.StructField(c, encoded.schema[c].dataType) for c in carry] + [T.StructField(text, T.StringType())]
    return encoded.select(F.col(ids).alias("__ids"), *carry).mapInArrow(tidy(run), T.StructType(fields))


def digests(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Encode and decode in one pass: carry, n_tokens, ids_sha256 (ids as 32-bit little-endian) and round_trip."""
    import hashlib

    spark = docs.sparkSession
    small_batches(spark)
    added = ["n_tokens", "ids_sha256", "round_trip"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for a, part in _chunks(batch.column(0)):
                texts = part.to_pylist()
                found = [own.encode(t or "") for t in texts]
                same = [own.decode(np.frombuffer(x, "<i4").tolist()) == (t or "") for x, t in zip(found, texts)]
                columns = [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found]), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(part)) for c in batch.columns[1:]), *columns], names=[*carry, *added])

    kinds = [T.LongType(), T.StringType(), T.BooleanType()]
    fields = [T.StructField(c, docs.schema[c].dataType) for c in carry] + [T.StructField(c, k) for c, k in zip(added, kinds)]
    return docs.select(F.col(text).cast("string").alias("__text"), *carry).mapInArrow(tidy(run), T.StructType(fields))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, Vocabulary.load(model), carry=["doc_id"])
