"""Counting symbol n-grams by group with Spark, and frozen back-off tables to score texts with.

A symbol is a byte or a class of bytes. An n-gram is packed into one integer, eight bits a symbol, first
symbol highest. Counting sorts the codes of a block, merges blocks within a task and leaves the rest to a
Spark aggregation. A table keeps the codes of each order in open-addressing hash arrays with resolved
log-probabilities, so scoring a block is one vectorised probe per order, and only positions whose n-gram
is unknown go on to the next lower order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import tidy
from docloom.llm.textblocks import M1, U, blocks, mix, text_of

COUNTS = "group string, code long, n long"
#: Entries that a counting task merges before it hands them on.
MERGE = 1 << 20


def merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def codes_of(symbols: np.ndarray, order: int) -> np.ndarray:
    """Codes of the order-grams that end at each position; too short where fewer symbols stand before."""
    out = np.zeros(len(symbols), np.uint64)
    for k in range(order - 1, -1, -1):
        out <<= U(8)
        out[k:] |= symbols[: len(symbols) - k]
    return out


def _count(batches: Iterator[pa.RecordBatch], order: int, classes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    groups: dict[str, tuple[list, list]] = {}
    held = 0

    def flush():
        for g, (codes, counts) in groups.items():
            c, n = merged(np.concatenate(codes), np.concatenate(counts))
            yield g, c, n

    def rows(found):
        for g, c, n in found:
            for a in range(0, len(c), 1 << 17):
                part = c[a : a + (1 << 17)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(part)), pa.array(part), pa.array(n[a : a + (1 << 17)])], names=["group", "code", "n"])

    for batch in batches:
        names = batch.column(0).fill_null("").to_pylist()
        for row, data, offsets in blocks(batch.column(1)):
            symbols = data if classes is None else classes[data]
            codes, of = codes_of(symbols, order), text_of(offsets)
            whole = np.arange(len(data)) - offsets[of] >= order - 1 if len(data) else np.zeros(0, bool)
            own = names[row : row + len(offsets) - 1]
            labels = {g: i for i, g in enumerate(dict.fromkeys(own))}
            label = np.array([labels[g] for g in own], np.int64)[of]
            for g, i in labels.items():
                c, n = np.unique(codes[whole & (label == i)], return_counts=True)
                if len(c):
                    store = groups.setdefault(g, ([], []))
                    store[0].append(c)
                    store[1].append(n)
                    held += len(c)
        if held > 4 * MERGE:
            found = {g: ([c], [n]) for g, c, n in flush()}
            held = sum(len(v[0][0]) for v in found.values())
            groups.clear()
            if held > 2 * MERGE:
                yield from rows((g, v[0][0], v[1][0]) for g, v in found.items())
                held = 0
            else:
                groups.update(found)
    yield from rows(flush())


def count_ngrams(docs: DataFrame, group: str, text: str, order: int, classes: np.ndarray | None = None) -> DataFrame:
    """group, code, n: how often each order-gram stands in the texts of a group. A null group is ''."""
    counted = docs.select(F.col(group).cast("string"), F.col(text).cast("string")).mapInArrow(tidy(lambda it: _count(it, order, classes)), COUNTS)
    return counted.groupBy("group", "code").agg(F.sum("n").alias("n"))


@dataclass
class HashArrays:
    """Open addressing over sorted arrays of distinct codes; at most a quarter of the slots is taken."""

    codes: np.ndarray
    slots: np.ndarray = field(init=False)
    bits: int = field(init=False)

    def __post_init__(self) -> None:
        self.bits = max(4, int(len(self.codes)).bit_length() + 2)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(self.codes), dtype=np.int32), self._slot(self.codes)
        while len(left):
            at_left = at[left]
            free = self.slots[at_left] < 0
            self.slots[at_left[free]] = left[free]  # of several the last one stays
            lost = self.slots[at_left] != left
            left = left[lost]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (mix(codes + M1) >> U(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The index of each code, -1 where there is none."""
        at = self._slot(codes)
        out = self.slots[at]
        if not len(self.codes):
            return out
        wrong = np.flatnonzero((out >= 0) & (self.codes[out] != codes))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            out[wrong] = got
            more = (got >= 0) & (self.codes[got] != codes[wrong])
            wrong, at = wrong[more], at[more]
        return out


@dataclass
class Level:
    """One order: for its grams the resolved log2 probabilities, and as contexts the log2 of going lower."""

    grams: HashArrays
    logp: np.ndarray  # [columns, grams]
    contexts: HashArrays
    lower: np.ndarray  # [columns, contexts]; contexts are one symbol shorter


@dataclass
class BackoffTable:
    levels: list[Level]  # order 1 first
    floor: float  # log2 probability of a symbol of which nothing is known
    columns: int

    def score(self, symbols: np.ndarray, offsets: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """[columns, texts]: the summed log2 probabilities of each text. prefix: a number per text that leads its codes."""
        n, order = len(symbols), len(self.levels)
        of = text_of(offsets)
        depth = np.minimum(np.arange(n) - offsets[of], order - 1) + 1 if n else np.zeros(0, np.int64)  # longest order that fits
        lead = None if prefix is None else prefix.astype(np.uint64)[of]
        out = np.zeros((self.columns, n), np.float32)
        todo = np.zeros(0, np.int64)
        for k in range(order, 0, -1):
            level = self.levels[k - 1]
            todo = np.concatenate([todo, np.flatnonzero(depth == k)])
            if len(todo):
                codes = np.zeros(len(todo), np.uint64)
                for j in range(k - 1, -1, -1):
                    codes = codes << U(8) | symbols[todo - j]
                high = None if lead is None else lead[todo]
                at = level.grams.find(codes if high is None else codes | high << U(8 * k))
                hit = at >= 0
                for c in range(self.columns):
                    out[c, todo[hit]] += level.logp[c, at[hit]]
                todo, codes = todo[~hit], codes[~hit]
                context = codes >> U(8)
                at = level.contexts.find(context if high is None else context | high[~hit] << U(8 * (k - 1)))
                known = at >= 0
                for c in range(self.columns):
                    out[c, todo[known]] += level.lower[c, at[known]]
        out[:, todo] += self.floor
        total = np.concatenate([np.zeros((self.columns, 1)), np.cumsum(out, axis=1, dtype=np.float64)], axis=1)
        return total[:, offsets[1:]] - total[:, offsets[:-1]]


def lower_order(codes: np.ndarray, counts: np.ndarray, order: int, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the first symbol: counts of the grams that are one symbol shorter; keep bits above stay."""
    tail = codes & U((1 << (8 * (order - 1))) - 1)
    high = (codes >> U(8 * order)) << U(8 * (order - 1)) if keep else U(0)
    return merged(tail | high, counts)
