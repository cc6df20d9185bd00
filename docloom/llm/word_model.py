"""Modified Kneser-Ney word bigrams over all documents, each document scored with its own counts left out.

A document that counts itself finds all its words and pairs in the model, however odd they are. So every text is
scored by what the other documents know: its own pairs are subtracted from the counts of pairs, of contexts, of their
kinds (seen once, twice, more often) and of the different words before a word. The result is exactly the
interpolated model of the other documents, but for the discounts and the number of words, which are those of all.

The model grows with the corpus: sorted arrays of 64-bit pairs (two 32-bit word hashes, which know the language) and of
words, dealt over buckets. No task and no driver holds more than a part of it.

1. Ask: a task cuts its rows into chunks of about CHUNK bytes and sends each chunk's distinct pairs, with their
   counts, and its distinct words to the buckets, sorted, as differences, compressed.
2. Pairs: a bucket adds up each pair, and answers every chunk in the order it asked in. It passes on, for each of its
   words, what its pairs add to the word's numbers.
3. Words: a bucket of words adds these up and answers every chunk.
4. Score: a second pass over the texts sends each chunk's words as numbers into its list of words (about two bytes
   each) to where its answers are, and scores its documents.

Scale: a very common pair or word costs one entry per chunk, and a word's numbers are sums of sums, so no bucket grows
with how common its words are. The number of buckets follows the bytes of the texts. Both passes must see the rows in
the same order, as reading a table does; what comes out of a shuffle is written down first. A chunk whose
answers do not match its words raises an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop_table, materialize, tidy
from docloom.llm.textblocks import LOWER, U, blocks, mix, word_hashes

#: Bytes of text of a chunk, and bytes of text that a bucket of pairs answers for.
CHUNK, PER_BUCKET = 12 << 20, 24 << 20
#: Ranges of first and of second words that buckets of pairs are made of, at most.
SIDE = 16
ASKED = "kind int, bucket long, other long, chunk long, blob binary"
TOLD = "kind int, bucket long, chunk long, blob binary"
PAIRS, WORDS, PARTS, PAIR_STATS, WORD_STATS = range(5)
NUMBERS = ["count", "once", "twice", "more", "before"]


def language_salts(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.md5(n.encode(), usedforsecurity=False).digest()[:8], "little") for n in names], np.uint64)


def word_numbers(data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> tuple[np.ndarray, ...]:
    """Starts, ends and 32-bit hashes of the lower-cased words of each text in its language, and the texts' bounds."""
    starts, ends, hashes, bounds = word_hashes(LOWER[data], offsets)
    names = {g: i for i, g in enumerate(dict.fromkeys(langs))}
    salt = language_salts(list(names))[np.array([names[g] for g in langs], np.int64)]
    return starts, ends, (mix(hashes ^ np.repeat(salt, np.diff(bounds))) >> U(32)).astype(np.uint32), bounds


def pairs_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring words within a text as 64-bit keys, and the place of the first word of each."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(text[1:] == text[:-1])
    return (words[at].astype(np.uint64) << U(32)) | words[at + 1], at


def pair_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are the cells of a square of ranges of first and second words, so a bucket sees few words; beyond SIDE
    ranges, at which a very common word adds little to a range, each cell is cut by a hash of the pair."""
    side = min(SIDE, math.isqrt(buckets))
    rest = buckets // side**2
    cell = ((keys >> U(32)) * U(side) >> U(32)) * U(side) + ((keys & U(0xFFFFFFFF)) * U(side) >> U(32))
    return (cell * U(rest) + (mix(keys) >> U(32)) % U(rest)).astype(np.int64)


def bucket_count(size: int) -> int:
    """Buckets for so many bytes of text: whole cells, and as many parts of each."""
    least = max(16, size // PER_BUCKET)
    side = min(SIDE, math.isqrt(least - 1) + 1)
    return side**2 * -(-least // side**2)


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of words are ranges, so words in order are buckets in order."""
    return ((words.astype(np.uint64) * U(buckets)) >> U(32)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, kind: str, columns: int = 1) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)
    return raw.reshape(columns, -1)


def _planes8(numbers: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, their first bytes first, then their second bytes, and so on."""
    return _pack(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T))


def _from_planes8(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<i8").reshape(-1)


def _planes(numbers: np.ndarray) -> bytes:
    """Low, middle and high bytes apart, which compress better."""
    return _pack(*[((numbers >> s) & 255).astype(np.uint8) for s in (0, 8, 16, 24)])


def _from_planes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def _steps(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs as differences of their first words, and of their second words where the first is the same."""
    first, second = (keys >> U(32)).astype(np.uint32), (keys & U(0xFFFFFFFF)).astype(np.uint32)
    jump = np.diff(first, prepend=np.uint32(0))
    step = second.copy()
    step[1:] -= np.where(jump[1:] == 0, second[:-1], 0).astype(np.uint32)
    return jump, step


def _from_steps(jump: np.ndarray, step: np.ndarray) -> np.ndarray:
    first = np.cumsum(jump, dtype=np.uint32)
    total = np.cumsum(step.astype(np.uint64))
    begin = jump != 0
    begin[:1] = True
    at = np.flatnonzero(begin)
    before = total[at] - step[at]  # what the runs before add up to
    second = total - np.repeat(before, np.diff(np.append(at, len(step))))
    return (first.astype(np.uint64) << U(32)) | second


def _request(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs and their counts. Second words are places in a sorted list of their own, as they repeat."""
    listed, place = np.unique((keys & U(0xFFFFFFFF)).astype(np.uint32), return_inverse=True)
    jump, step = _steps((keys & ~U(0xFFFFFFFF)) | place.astype(np.uint64))
    return _planes(np.concatenate([np.array([len(keys)], np.uint32), jump, step, counts, np.diff(listed, prepend=np.uint32(0))]))


def _requested(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _from_planes(blob)
    n = int(raw[0])
    jump, step, counts = raw[1 : 3 * n + 1].reshape(3, n)
    keys, listed = _from_steps(jump, step), np.cumsum(raw[3 * n + 1 :], dtype=np.uint32)
    return (keys & ~U(0xFFFFFFFF)) | listed[(keys & U(0xFFFFFFFF)).astype(np.int64)].astype(np.uint64), counts


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """Chunk number, rows, and whether the chunk ends with them. Cuts depend on the rows alone, not on how they are batched."""
    chunk, size = 0, 0
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        a = 0
        while a < batch.num_rows:
            total = np.cumsum(length[a:]) + size
            end = int(np.searchsorted(total, limit)) + 1
            b = min(a + end, batch.num_rows)
            ends = total[b - a - 1] >= limit
            yield chunk, batch.slice(a, b - a), bool(ends)
            chunk, size = (chunk + 1, 0) if ends else (chunk, int(total[b - a - 1]))
            a = b


def _numbers_of(batch: pa.RecordBatch, spelled: list[tuple[np.ndarray, np.ndarray]] | None = None, spell=None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and word counts of the rows (text, language). spelled: takes distinct words and their spelling's bits."""
    langs = batch.column(1).fill_null("").to_pylist()
    words, counts = [], []
    for row, data, offsets in blocks(batch.column(0)):
        own = langs[row : row + len(offsets) - 1]
        starts, ends, w, bounds = word_numbers(data, offsets, own)
        words.append(w)
        counts.append(np.diff(bounds))
        if spell is not None and len(w):
            distinct, first = np.unique(w, return_index=True)
            text = np.searchsorted(bounds, first, side="right") - 1
            spelled.append((distinct, spell(data, starts[first], ends[first], [own[i] for i in text])))
    return np.concatenate(words or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])


def _ask(batches: Iterator[pa.RecordBatch], buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 32

    def question(chunk: int, keys: list[np.ndarray], words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        own = np.unique(np.concatenate(words))
        bucket = pair_bucket(k, buckets)
        order = np.argsort(bucket, kind="stable")
        k, n, bucket = k[order], n[order].astype(np.uint32), bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(k) else np.zeros(1, np.int64)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows.append((PAIRS, int(bucket[a]), 0, _request(k[a:b], n[a:b])))
        of = word_bucket(own, buckets)
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
        rows += [(WORDS, int(of[a]), int(of[a]), _planes(np.diff(own[a:b], prepend=np.uint32(0)))) for a, b in zip(cuts[:-1], cuts[1:])]
        for i in range(0, len(rows), 256):
            kind, at, other, blob = zip(*rows[i : i + 256])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(other, pa.int64()), pa.array([chunk] * len(at), pa.int64()), pa.array(blob, pa.binary())], names=[f.split()[0] for f in ASKED.split(", ")])

    keys, words, last = [], [], 0
    for last, rows, ends in _slices(batches, limit):  # noqa: B007
        w, counts = _numbers_of(rows)
        keys.append(pairs_of(w, np.concatenate([[0], np.cumsum(counts)]))[0])
        words.append(w)
        if ends:
            yield from question(task | last, keys, words)
            keys, words = [], []
    if words:
        yield from question(task | last, keys, words)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[:, order], first, axis=1) if len(first) else values[:, :0]


def _kinds(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, 5)]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=[f.split()[0] for f in TOLD.split(", ")])


def _add_pairs(table: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket: answers with the pairs' totals, requests for words, parts of the words' numbers, counts of counts."""
    kind, other, chunk, blob = (table.column(c).to_pylist() for c in ("kind", "other", "chunk", "blob"))
    rows = [(WORDS, o, c, z) for k, o, c, z in zip(kind, other, chunk, blob) if k == WORDS]
    asked = [(c, *_requested(z)) for k, c, z in zip(kind, chunk, blob) if k == PAIRS]
    if not asked:
        return _table(rows)
    keys = np.concatenate([x for _, x, _ in asked])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    total = np.add.reduceat(np.concatenate([n for _, _, n in asked]).astype(np.int64)[order], np.flatnonzero(new))
    answer = np.empty(len(keys), np.int64)
    answer[order] = total[np.cumsum(new) - 1]
    at = 0
    for c, x, _ in asked:
        n = len(x)
        rows.append((PAIRS, int(table.column("bucket")[0].as_py()), c, _planes8(answer[at : at + n])))
        at += n
    pair = ordered[new]
    first, second = (pair >> U(32)).astype(np.uint32), (pair & U(0xFFFFFFFF)).astype(np.uint32)
    zero, one = np.zeros(len(pair), np.int64), np.ones(len(pair), np.int64)
    left = _summed(first, np.stack([total, total == 1, total == 2, total > 2, zero]).astype(np.int64))
    right = _summed(second, np.stack([zero, zero, zero, zero, one]))
    words, numbers = _summed(np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]], axis=1))
    of = word_bucket(words, buckets)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows.append((PARTS, int(of[a]), None, _planes8(np.concatenate([np.diff(words[a:b].astype(np.int64), prepend=0), *numbers[:, a:b]]))))
    rows.append((PAIR_STATS, 0, None, _pack(np.array([*_kinds(total), len(pair)], np.int64))))
    return _table(rows)


def _add_words(table: pa.Table) -> pa.Table:
    """Of one bucket of words: answers with the words' numbers, and counts of how many words come before a word."""
    kind, chunk, blob = (table.column(c).to_pylist() for c in ("kind", "chunk", "blob"))
    parts = [_from_planes8(z).reshape(6, -1) for k, z in zip(kind, blob) if k == PARTS]
    for p in parts:
        np.cumsum(p[0], out=p[0])
    words, numbers = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1:] for p in parts], axis=1)) if parts else (np.zeros(0, np.int64), np.zeros((5, 0), np.int64))
    numbers = np.concatenate([numbers, np.zeros((5, 1), np.int64)], axis=1)
    rows = []
    for k, c, z in zip(kind, chunk, blob):
        if k == WORDS:
            asked = np.cumsum(_from_planes(z), dtype=np.uint32).astype(np.int64)
            at = np.searchsorted(words, asked)
            at[(at >= len(words)) | (words[np.minimum(at, len(words) - 1)] != asked if len(words) else True)] = len(words)  # in no pair
            rows.append((WORDS, int(table.column("bucket")[0].as_py()), c, _planes8(numbers[:, at].reshape(-1))))
    rows.append((WORD_STATS, 0, None, _pack(np.array([*_kinds(numbers[4]), len(words)], np.int64))))
    return _table(rows)


def discounts(kinds: np.ndarray) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n = [int(x) for x in kinds[:4]]
    if min(n[:3]) == 0:
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))])


def log_probabilities(words: np.ndarray, bounds: np.ndarray, totals, numbers, pair_stats: np.ndarray, word_stats: np.ndarray) -> np.ndarray:
    """Summed log2 probabilities of each text's words under the model of the other documents.

    words: their numbers into a sorted list; totals(keys): how often these sorted distinct pairs (number << 32 | number)
    stand in all documents; numbers: five rows for the list (NUMBERS). Words that were never seen are equally likely.
    """
    n = len(bounds) - 1
    d2, d1 = discounts(pair_stats), discounts(word_stats)
    types, vocabulary = max(int(pair_stats[4]), 1), max(int(word_stats[4]), 1)
    count, once, twice, more, before = numbers
    # How the words before a word are discounted, and what that leaves for words never seen.
    spare = (d1[1] * word_stats[0] + d1[2] * word_stats[1] + d1[3] * max(vocabulary - int(word_stats[0]) - int(word_stats[1]), 0)) / types
    text = np.repeat(np.arange(n), np.diff(bounds))
    keys, at = pairs_of(words, bounds)
    listed, number = np.unique(keys, return_inverse=True)
    both, own = np.unique(text[at] * len(listed) + number, return_counts=True)  # each text's pairs, in order
    of, number = np.divmod(both, max(len(listed), 1))
    u, v = (listed >> U(32)).astype(np.int64)[number], (listed & U(0xFFFFFFFF)).astype(np.int64)[number]
    all_of = totals(listed)[number]
    rest = all_of - own
    # The contexts of a text are runs, as its pairs are sorted.
    run = np.concatenate([[True], (u[1:] != u[:-1]) | (of[1:] != of[:-1])]) if len(u) else np.zeros(0, bool)
    start, member = np.flatnonzero(run), np.cumsum(run) - 1
    change = lambda k: np.add.reduceat((np.minimum(rest, 3) == k).astype(np.int64) - (np.minimum(all_of, 3) == k), start)[member] if len(start) else rest
    context = count[u] - (np.add.reduceat(own, start)[member] if len(start) else own)
    weight = d2[1] * (once[u] + change(1)) + d2[2] * (twice[u] + change(2)) + d2[3] * (more[u] + change(3))
    # Words that only this text has before a word.
    alone = rest == 0
    ends, gone = np.unique(of[alone] * len(before) + v[alone], return_counts=True)
    lost = np.bincount(of[alone], minlength=n)

    def lower(text_number: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = text_number * len(before) + word
        place = np.minimum(np.searchsorted(ends, key), max(len(ends) - 1, 0))
        left = before[word] - (np.where(ends[place] == key, gone[place], 0) if len(ends) else 0)
        return np.maximum(left - d1[np.minimum(left, 3)], 0) / np.maximum(types - lost[text_number], 1) + max(spare, 1e-9) / vocabulary

    below = lower(of, v)
    p = np.where(context > 0, (np.maximum(rest - d2[np.minimum(rest, 3)], 0) + weight * below) / np.maximum(context, 1), below)
    score = np.bincount(of, own * np.log2(p), n) if len(of) else np.zeros(n)
    begins = bounds[:-1][np.diff(bounds) > 0]
    if len(begins):
        score[text[begins]] += np.log2(lower(text[begins], words[begins].astype(np.int64)))
    return score


def _answers(table: pa.Table, kind: int, columns: int) -> np.ndarray:
    """The numbers that buckets sent, in the buckets' order."""
    rows = sorted((b, z) for k, b, z in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist()) if k == kind)
    return np.concatenate([_from_planes8(z).reshape(columns, -1) for _, z in rows], axis=1) if rows else np.zeros((columns, 0), np.int64)


def _score(own: pa.Table, told: pa.Table, buckets: int, pair_stats: np.ndarray, word_stats: np.ndarray, names: list[str], spelled: bool) -> pa.Table:
    """The documents of one chunk (own: rows, and one with the words) with log_ppl."""
    blob = own.column("__blob")
    recipe = zstandard.ZstdDecompressor().decompress(blob.filter(blob.is_valid())[0].as_py())
    n, m, k = np.frombuffer(recipe, "<i8", 3).tolist()
    counts = np.frombuffer(recipe, "<u4", n, 24).astype(np.int64)
    at = 24 + 4 * n
    bits = np.frombuffer(recipe, "<f2", m, at) if spelled else None
    at += 2 * m * spelled
    sent = _from_planes(recipe[at:]) if k else np.zeros(0, np.uint32)
    words = np.cumsum(sent[:m], dtype=np.uint32)
    order = np.argsort(words)
    place = np.empty(m, np.uint32)
    place[order] = np.arange(m, dtype=np.uint32)
    words, number = words[order], place[sent[m:]]
    numbers, answer = _answers(told, WORDS, 5), _answers(told, PAIRS, 1)[0]

    def totals(listed: np.ndarray) -> np.ndarray:
        hashes = (words[(listed >> U(32)).astype(np.int64)].astype(np.uint64) << U(32)) | words[(listed & U(0xFFFFFFFF)).astype(np.int64)]
        order = np.argsort(pair_bucket(hashes, buckets), kind="stable")
        if len(order) != len(answer):
            raise RuntimeError("the rows of a chunk changed between two passes")
        out = np.empty(len(listed), np.int64)
        out[order] = answer
        return out

    if numbers.shape[1] != m:
        raise RuntimeError("the rows of a chunk changed between two passes")
    sums = log_probabilities(number, np.concatenate([[0], np.cumsum(counts)]), totals, numbers, pair_stats, word_stats)
    rows = own.filter(pc.is_null(blob))
    place = rows.column("__place").to_numpy()
    bounds, none = np.concatenate([[0], np.cumsum(counts)]), counts[place] == 0
    spelling = np.diff(np.concatenate([[0.0], np.cumsum(bits.astype(float)[number])])[bounds]) if spelled else np.zeros(n)
    table = rows.select(names)
    for name, total in (("log_ppl", -sums), ("spelling", spelling)):
        table = table.append_column(name, pa.array(total[place] / np.maximum(counts[place], 1), mask=none))
    return table


def prepare(batches: Iterator[pa.RecordBatch], names: list[str], counted, limit: int, schema: pa.Schema, spell=None) -> Iterator[pa.RecordBatch]:
    """Rows (text, language, others) as (others, what counted(rows) gives, chunk, place) and a row with the words for each chunk."""
    task = TaskContext.get().partitionId() << 32

    def recipe(chunk: int) -> pa.RecordBatch:
        all_words, all_counts = np.concatenate(words), np.concatenate(counts).astype(np.uint32)
        own, number, times = np.unique(all_words, return_inverse=True, return_counts=True)
        head = np.array([len(all_counts), len(own), len(all_words)], "<i8")
        parts = [head, all_counts]
        if len(own):
            if spell is not None:
                w, bits = (np.concatenate(x) for x in zip(*spelled))
                parts.append(np.minimum(bits[np.unique(w, return_index=True)[1]], 60_000).astype("<f2"))
            # Common words get small numbers: by the power of two of their count, then in order, so differences stay small.
            order = np.argsort(-np.frexp(times)[1], kind="stable")
            place = np.empty(len(own), np.uint32)
            place[order] = np.arange(len(own), dtype=np.uint32)
            parts.append(np.frombuffer(_planes(np.concatenate([np.diff(own[order], prepend=np.uint32(0)), place[number]])), np.uint8))
        blob = _pack(*parts)
        values = {"__chunk": chunk, "__place": None, "__blob": blob}
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)

    counts, words, spelled, last, place = [], [], [], 0, 0
    for last, rows, ends in _slices(batches, limit):  # noqa: B007
        w, c = _numbers_of(rows, spelled, spell)
        words.append(w)
        counts.append(c)
        n = rows.num_rows
        made = counted(rows)
        columns = [*rows.columns[2:], *[pa.array(made[x]) for x in names], pa.array(np.full(n, task | last)), pa.array(np.arange(place, place + n)), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
        place += n
        if ends:
            yield recipe(task | last)
            counts, words, spelled, place = [], [], [], 0
    if words:
        yield recipe(task | last)


def steady(docs: DataFrame) -> DataFrame:
    """docs, if its rows come in the same order each time they are read; else a copy on disk."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return materialize(docs, "steady") if any(x in plan for x in ("Exchange", "Sample", "Limit")) else docs


def scored(docs: DataFrame, text: str, lang: str, carry: list[str], added: dict[str, str], counted, chunk: int = CHUNK, speller=None) -> DataFrame:
    """carry, what counted(rows) gives (added: names and types), log_ppl and spelling (bits per word; null without words) of every row.

    speller(bytes, starts, ends, languages): the bits of the spellings of words (none: 0).
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    own = steady(docs.select(F.col(text).cast("string").alias("__text"), F.col(lang).cast("string").alias("__lang"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]))
    size = own.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    buckets = bucket_count(size)
    asked = own.select("__text", "__lang").mapInArrow(tidy(lambda it: _ask(it, buckets, chunk)), ASKED)
    told = materialize(asked.groupBy("bucket").applyInArrow(lambda t: _add_pairs(t, buckets), TOLD), "pairs")
    words = materialize(told.where(F.col("kind").isin(WORDS, PARTS)).groupBy("bucket").applyInArrow(_add_words, TOLD), "words")

    def stats(table: DataFrame, kind: int) -> np.ndarray:
        """Sums of five numbers of each bucket."""
        total = np.zeros(5, np.int64)
        for r in table.where(F.col("kind") == kind).select("blob").toLocalIterator():
            total += _unpack(bytes(r.blob), "<i8")[0]
        return total

    pair_stats, word_stats = stats(told, PAIR_STATS), stats(words, WORD_STATS)
    answered = materialize(told.where(F.col("kind") == PAIRS), "answers")  # the larger part is of no more use
    drop_table(told)
    kinds = {"long": T.LongType(), "boolean": T.BooleanType()}
    inner = [T.StructField(f"__c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)] + [T.StructField(f"__a{i}", kinds[k]) for i, k in enumerate(added.values())]
    names = [f.name for f in inner]
    whole = T.StructType([*inner, T.StructField("__chunk", T.LongType()), T.StructField("__place", T.LongType()), T.StructField("__blob", T.BinaryType())])
    arrow = to_arrow_schema(whole)
    rows = own.mapInArrow(tidy(lambda it: prepare(it, list(added), counted, chunk, arrow, speller)), whole)
    answers = answered.unionByName(words.where(F.col("kind") == WORDS)).withColumnRenamed("chunk", "__chunk")
    out = T.StructType([*inner, T.StructField("log_ppl", T.DoubleType()), T.StructField("spelling", T.DoubleType())])
    joined = rows.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(lambda a, b: _score(a, b, buckets, pair_stats, word_stats, names, speller is not None), out)
    final = materialize(joined, "quality")
    drop_table(answered)
    drop_table(words)
    return final.select(*[F.col(f.name).alias(c) for f, c in zip(inner, [*carry, *added])], "log_ppl", "spelling")
