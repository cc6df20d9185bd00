"""Packing documents into training windows: bounded-space online best fit.

Each task keeps at most OPEN unfinished windows. A document's ids (with an end id) first fill whole windows; what is
left of it is put into the open window that it fills best. If none has room, the fullest one is topped up with the
head of the document and emitted. At the end of a task its open windows are merged into one, and the tasks' last
windows are merged by further tasks of FAN_IN windows each, level by level, until one task is left. Its last window
is cut into sequences of powers of two, which need no padding. So no sequence is padded at all; what cutting costs is
the number of pieces.

Ids are those of the `tokenizers` library for a byte-level BPE model, end and other marks in a text being ordinary
text. They are made by `tiktoken`, whose ranks follow from the model's file (three times as fast; tests compare whole
texts). Texts of over PART characters are encoded in parts, cut where no token can span, and very long ones
twice (first to count), so a task holds the ids of one part and its open windows only.

Scale: one pass over the texts without a shuffle; every level shuffles at most one window per task of the level before.
Written tables hold the pieces, so sequences stay the same if executors are lost. Only counts reach the driver.

Defined results: a null text is an empty one; an empty one has the end id only. A null key, repeated keys and repeated
rows are documents like others. An empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import materialize, read, small_batches, tidy

LENGTH, OPEN, FAN_IN = 1024, 32, 512
PART, TWICE = 1 << 20, 1 << 24
#: Between a letter or digit and a blank no token of a byte-level model can span.
_SAFE = re.compile(r"[^\W_](?=[ \n])")
#: Pieces and ids of an output batch at most.
_ROWS, _IDS = 20_000, 1 << 20


@dataclass(frozen=True)
class ByteVocabulary:
    """The pieces of a byte-level BPE model, by id, and the pattern that splits text before merging."""

    pieces: tuple[bytes, ...]
    pattern: str
    name: str

    @staticmethod
    def load(path: str, pattern: str) -> ByteVocabulary:
        """From the file of a `tokenizers` model whose ids are the order of its merges; others are an error."""
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        split, model = whole["pre_tokenizer"] or {}, whole["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and whole.get("normalizer") is None
        bytes_of = _letters()
        by_id = sorted(model["vocab"].items(), key=lambda item: item[1])
        pieces = tuple(bytes(bytes_of[c] for c in piece) for piece, _ in by_id)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(pieces) - len(merges)
        ranked = [i for _, i in by_id] == list(range(len(pieces))) and all(model["vocab"][a + b] == first + i for i, (a, b) in enumerate(merges))
        if not plain or not ranked or model["type"] != "BPE":
            raise ValueError("a byte-level BPE model is needed, with ids in the order of its merges")
        return ByteVocabulary(pieces, pattern, path)


def _letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(vocabulary: ByteVocabulary) -> tiktoken.Encoding:
    """One per worker and vocabulary."""
    key = (vocabulary.name, vocabulary.pattern)
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks={p: i for i, p in enumerate(vocabulary.pieces)}, special_tokens={})
    return _encodings[key]


def text_parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of about size characters whose ids are together those of the text."""
    at = 0
    while len(text) - at > size and (found := _SAFE.search(text, at + size - 1)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def id_parts(text: str, coder: tiktoken.Encoding, end: int) -> tuple[int, Iterator[np.ndarray]]:
    """The number of ids of a text with its end, and the ids part by part."""
    parts = lambda: (np.array(coder.encode_ordinary(p), np.int32) for p in text_parts(text, PART))
    last = np.array([end], np.int32)
    if len(text) <= TWICE:
        held = [*parts(), last]
        return sum(map(len, held)), iter(held)

    def again() -> Iterator[np.ndarray]:
        yield from parts()
        yield last

    return 1 + sum(len(p) for p in parts()), again()


@dataclass
class Piece:
    key: object
    start: int
    total: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.key, self.start, self.total, self.ids[:n]), Piece(self.key, self.start + n, self.total, self.ids[n:])


@dataclass
class Windows:
    """At most `most` open windows; full ones go to `done` at once."""

    length: int = LENGTH
    most: int = OPEN
    room: list[tuple[int, int]] = field(default_factory=list)  # (free ids, window), sorted
    held: dict[int, list[Piece]] = field(default_factory=dict)
    done: list[list[Piece]] = field(default_factory=list)
    opened: int = 0

    def place(self, piece: Piece, most: int | None = None) -> None:
        """Whole windows first, then best fit; if nothing has room, the fullest window takes the head and is emitted."""
        while len(piece.ids) >= self.length:
            head, piece = piece.cut(self.length)
            self.done.append([head])
        while len(piece.ids):
            at = bisect_left(self.room, (len(piece.ids), -1))
            if at < len(self.room):
                self._put(at, piece)
                return
            if len(self.room) < (most or self.most):
                insort(self.room, (self.length, self.opened))
                self.held[self.opened] = []
                self.opened += 1
                continue
            head, piece = piece.cut(self.room[0][0])
            self._put(0, head)

    def _put(self, at: int, piece: Piece) -> None:
        free, window = self.room.pop(at)
        self.held[window].append(piece)
        if free == len(piece.ids):
            self.done.append(self.held.pop(window))
        else:
            insort(self.room, (free - len(piece.ids), window))

    def merge(self) -> None:
        """Leave one open window at most: the emptiest is dealt out to the others, again and again."""
        while len(self.room) > 1:
            _, emptiest = self.room.pop()
            for piece in sorted(self.held.pop(emptiest), key=lambda p: -len(p.ids)):
                self.place(piece, 1)

    def finish(self) -> None:
        """Cut the last open window into sequences of powers of two, the largest first."""
        self.merge()
        rest = [p for _, window in self.room for p in self.held.pop(window)]
        self.room = []
        left = sum(len(p.ids) for p in rest)
        while left:
            take = 1 << (left.bit_length() - 1)
            left -= take
            own = []
            while take:
                head, tail = rest[0].cut(min(take, len(rest[0].ids)))
                own.append(head)
                take -= len(head.ids)
                rest[:1] = [tail] if len(tail.ids) else []
            self.done.append(own)


def _typed(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    """The type of the first column, and the batches."""
    one = next(batches, None)
    return (pa.null(), iter(())) if one is None else (one.column(0).type, chain([one], batches))


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Rows (key, start, total, sequence or None, offset, ids)."""
    ends = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[5] for r in rows])))
    numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3, 4)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *numbers, ids], names=["key", "start", "total", "sequence", "offset", "ids"])


def _emitted(windows: Windows, pieces: Iterator[Piece], level: int, last: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Place pieces and yield the rows of full windows, then those of the open one without a sequence."""
    base = level << 54 | TaskContext.get().partitionId() << 27
    made, rows, size = 0, [], 0

    def drain() -> Iterator[pa.RecordBatch]:
        nonlocal made, rows, size
        for window in windows.done:
            offset = 0
            for p in window:
                rows.append((p.key, p.start, p.total, base | made, offset, p.ids))
                offset += len(p.ids)
            made += 1
            size += offset
            if size >= _IDS or len(rows) >= _ROWS:
                yield _batch(rows, kind)
                rows, size = [], 0
        windows.done.clear()

    for piece in pieces:
        windows.place(piece)
        yield from drain()
    windows.finish() if last else windows.merge()
    yield from drain()
    rows += [(p.key, p.start, p.total, None, None, p.ids) for own in windows.held.values() for p in own]
    if rows:
        yield _batch(rows, kind)


def pack(docs: DataFrame, vocabulary: ByteVocabulary, key: str = "doc_id", text: str = "text", length: int = LENGTH, open_windows: int = OPEN, end: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset and ids (array<int>).

    length is at least 2, open_windows and fan_in at least 1 and 2; others are an error.
    """
    if length < 2 or open_windows < 1 or fan_in < 2:
        raise ValueError("length, open_windows and fan_in must be at least 2, 1 and 2")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)  # of the vocabulary's size
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *T._parse_datatype_string("start bigint, total bigint, sequence bigint, offset bigint, ids array<int>").fields])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(shared.value)
        kind, own = _typed(batches)

        def pieces() -> Iterator[Piece]:
            for batch in own:
                for i in range(batch.num_rows):
                    total, parts = id_parts(batch.column(1)[i].as_py() or "", coder, end)
                    name, at, rest = batch.column(0)[i].as_py(), 0, np.zeros(0, np.int32)
                    for part in parts:  # whole windows go at once, the rest when the document ends
                        rest = np.concatenate([rest, part])
                        whole = len(rest) // length * length
                        if whole:
                            yield Piece(name, at, total, rest[:whole])
                            at, rest = at + whole, rest[whole:]
                    if len(rest):
                        yield Piece(name, at, total, rest)

        yield from _emitted(Windows(length, open_windows), pieces(), 0, False, kind)

    def merging(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind, own = _typed(batches)

            def pieces() -> Iterator[Piece]:
                for batch in own:
                    for name, start, total, ids in zip(*(batch.column(i) for i in (0, 1, 2, 5))):
                        yield Piece(name.as_py(), start.as_py(), total.as_py(), ids.values.to_numpy().astype(np.int32))

            yield from _emitted(Windows(length, open_windows), pieces(), level, last, kind)

        return run

    tables = [materialize(docs.select(key, text).mapInArrow(tidy(first), schema), "packed")]
    level = 0
    while True:
        level += 1
        left = tables[-1].where("sequence is null")
        ids = left.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first().n
        tasks = -(-ids // (length * fan_in))
        if not ids:
            break
        tables.append(materialize(left.repartition(tasks).mapInArrow(tidy(merging(level, tasks == 1)), schema), "packed"))
        if tasks == 1:
            break
    whole = tables[0].where("sequence is not null")
    for table in tables[1:]:
        whole = whole.unionByName(table.where("sequence is not null"))
    return whole.select(F.col("key").alias(key), "start", F.size("ids").cast("long").alias("length"), F.col("total").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset", "ids")


def digests(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """packed with ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) in the place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            sums = [zlib.crc32(own.values.to_numpy().astype("<u4").tobytes()) for own in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])

    own = packed.select(*[c for c in packed.columns if c != "ids"], "ids")
    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], T.StructField("ids_crc32", T.LongType())]))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = ByteVocabulary.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return digests(pack(read(spark, sf_dir, "documents"), vocabulary))
