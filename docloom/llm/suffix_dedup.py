"""Suffix-array dedup: remove every byte that lies in a LENGTH-byte string which also starts earlier.

A full suffix array over all bytes would be many times the input. Instead every window of LENGTH bytes is
represented by its anchor, the GRAM-byte string in it with the least hash (leftmost if equal). The choice
depends on the window's bytes alone, so equal windows have equal anchors at equal offsets, and only windows
of equal anchors need to be compared. An anchor's run is the stretch of consecutive windows it represents.

1. Anchors (one per some 35 bytes) are packed by bucket of their gram's hash and shuffled, some twenty bytes
   each. Runs of equal bytes are one class; all but the earliest are removed as a whole.
2. Grams with several classes: the earliest run of each class is fetched from the texts. In a bucket, what
   follows the anchors and what precedes them (reversed) is sorted by deep-shallow suffix sorting; the
   common-prefix lengths give, for every offset, the classes of equal windows. The earliest of a class
   stays, the others are removed.
3. Grams that are very frequent in one task's data are hot. Their runs go another exact way: each window is
   a row with its 128-bit hash, and the earliest of a hash is found by an aggregation (map-side first; only
   the earliest among a task's equal windows becomes a row at all).
   So no gram, however frequent, gathers in one task.

Equal runs inside one task's data are settled there, before the shuffle. Texts are shuffled twice (for
step 2, and for the removal). Intermediate tables are in the shared folder. Runs and hot windows are
told apart by hashes of 100 bits or more; step 2 compares the bytes.

Defined results: texts are UTF-8 bytes, a null text is empty; matches never cross texts; strings are judged
on the input. A document is a key with a text (told apart by a 64-bit hash), so unlike texts under one key, or
under no key, are different documents; rows that repeat both are one document and get equal results.
"Earlier" is by (key, hash of the text, start), and a null key counts as the largest. Keys may be of any type
that can be sorted; those that are no whole numbers are numbered in their order first. Texts shorter
than LENGTH stay whole. Extra columns are ignored: the results have the key and the digest columns;
``remaining_text`` returns texts instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import materialize, read, small_batches, tidy
from docloom.llm.suffix_sort import sort_group
from docloom.llm.textblocks import INVERSE, M1, M2, M3, U, blocks, mix, powers, prefix_hash, span_hash, text_of

LENGTH, GRAM = 100, 32
#: Anchors that a task holds before it packs them; different runs of one gram among these that make it hot.
FLUSH, HOT = 1 << 19, 16
#: Hot windows that a task holds before it settles the equal ones among them.
WINDOWS_HELD = 1 << 21
NO_KEY = (1 << 63) - 1
FIELDS = [("gram", "<u4"), ("run", "<u8"), ("key", "<i8"), ("doc", "<i8"), ("start", "<u4"), ("off", "u1"), ("count", "u1"), ("flag", "u1")]
PLAIN, SETTLED, SPREAD, MARK = 0, 1, 2, 3
REMOVED, COMPARE, WINDOWS = 0, 1, 2


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of a block: gram hash, run hash, text number, start of the first window in the text, offset of the anchor in it, windows."""
    n, span = len(data), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < length:
        return none
    prefix, inverse = prefix_hash(data), powers(INVERSE, n + 1)
    starts = np.arange(n - gram + 1)
    hashes = mix((prefix[gram:] - prefix[: n - gram + 1]) * inverse[: n - gram + 1])
    value, place, width = hashes, starts.astype(np.int32), 1
    while width < span:
        step = min(width, span - width)
        later = value[step:] < value[:-step]
        value = np.where(later, value[step:], value[:-step])
        place = np.where(later, place[step:], place[:-step])
        width += step
    of = text_of(offsets)
    whole = np.flatnonzero(offsets[1:][of[: len(place)]] - np.arange(len(place)) >= length)
    if not len(whole):
        return none
    at = place[whole]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(whole)))
    begin, anchor = whole[first], at[first].astype(np.int64)
    off = anchor - begin
    run = mix(span_hash(prefix, begin, begin + count - 1 + length, inverse) ^ (off.astype(np.uint64) * M3))
    text = of[begin]
    return hashes[anchor], run, text, begin - offsets[text], off, count


def _pack(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c, dtype=t).tobytes() for c, (_, t) in zip(columns, FIELDS)))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = len(raw) // sum(np.dtype(t).itemsize for _, t in FIELDS), 0, []
    for _, t in FIELDS:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _gather(batches: Iterator[pa.RecordBatch], buckets: int, length: int, gram: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Anchors of a task, packed by bucket."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal rows
        if not held:
            return
        grams, run, key, doc, start, off, count = (np.concatenate(x) for x in zip(*held))
        held.clear()
        rows = 0
        order = np.lexsort((start, doc, key, run, grams))
        grams, run, key, doc, start, off, count = (x[order] for x in (grams, run, key, doc, start, off, count))
        new_gram = np.concatenate([[True], grams[1:] != grams[:-1]])
        new_run = new_gram | np.concatenate([[True], run[1:] != run[:-1]])
        flag = np.where(new_run, PLAIN, SETTLED)
        # Equal (key, doc, start) can only be repeated rows; they do not settle each other.
        tie = np.concatenate([[False], (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])
        flag[tie & ~new_run] = PLAIN
        group = np.cumsum(new_gram) - 1
        frequent = np.bincount(group, new_run) > hot
        flag[(flag == PLAIN) & frequent[group]] = SPREAD
        where = np.where(flag == PLAIN, grams, mix(grams ^ run ^ mix((key ^ doc).astype(np.uint64) + start.astype(np.uint64) * M1)))
        marks = grams[new_gram][frequent]
        if len(marks):
            grams, run, key, doc, start, off, count = (np.concatenate([x, marks if x is grams else np.zeros(len(marks), x.dtype)]) for x in (grams, run, key, doc, start, off, count))
            flag, where = np.concatenate([flag, np.full(len(marks), MARK)]), np.concatenate([where, marks])
        bucket = ((where >> U(32)) % U(buckets)).astype(np.int64)
        order = np.lexsort((grams & U(0xFFFFFFFF), bucket))
        bucket = bucket[order]
        columns = [x[order] for x in (grams & U(0xFFFFFFFF), run, key, doc, start, off, count, flag)]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for i in range(0, len(cuts) - 1, 256):
            spans = list(zip(cuts[i : i + 256], cuts[i + 1 : i + 257]))
            blobs = [_pack([x[a:b] for x in columns]) for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    for batch in batches:
        keys, docs = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for row, data, offsets in blocks(batch.column(0), 1 << 19):
            found = anchors(data, offsets, length, gram)
            if len(found[0]):
                held.append((found[0], found[1], keys[row:][found[2]], docs[row:][found[2]], found[3].astype(np.uint32), found[4].astype(np.uint8), found[5].astype(np.uint8)))
                rows += len(found[0])
        if rows >= FLUSH:
            yield from flush()
    yield from flush()


SORTED_OUT = "key long, doc long, start long, off int, count int, kind int, gram long"


def _classes(table: pa.Table) -> pa.Table:
    """Of one bucket: runs to remove, runs to compare, and runs of hot grams."""
    bucket = table.column("bucket")[0].as_py()
    gram, run, key, doc, start, off, count, flag = (np.concatenate(x) for x in zip(*(_unpack(b) for b in table.column("blob").to_pylist())))
    kind = np.full(len(gram), -1)
    kind[flag == SETTLED] = REMOVED
    kind[flag == SPREAD] = WINDOWS
    marked = np.unique(gram[flag == MARK])
    at = np.flatnonzero(flag == PLAIN)
    at = at[np.lexsort((start[at], doc[at], key[at], run[at], gram[at]))]
    if len(at):
        g, r = gram[at], run[at]
        new_gram = np.concatenate([[True], g[1:] != g[:-1]])
        new_run = new_gram | np.concatenate([[True], r[1:] != r[:-1]])
        group, class_of = np.cumsum(new_gram) - 1, np.cumsum(new_run) - 1
        first = np.flatnonzero(new_run)[class_of]
        tie = (key[at] == key[at][first]) & (doc[at] == doc[at][first]) & (start[at] == start[at][first])
        kind[at[~tie]] = REMOVED
        several = np.bincount(group, new_run) > 1
        is_hot = np.isin(g, marked)
        kind[at[tie & several[group] & ~is_hot]] = COMPARE
        kind[at[tie & is_hot]] = WINDOWS
    out = np.flatnonzero(kind >= 0)
    columns = [key[out], doc[out], start[out].astype(np.int64), off[out].astype(np.int32), count[out].astype(np.int32), kind[out].astype(np.int32), (bucket << 32) | gram[out].astype(np.int64)]
    return pa.table({f.split()[0]: pa.array(c) for f, c in zip(SORTED_OUT.split(", "), columns)})


FETCHED = "gram long, blob binary, w1 long, w2 long, key long, doc long, start long, stop long"


def _fetch(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """From texts and their runs: run bytes packed by bucket (gram: the bucket), a row for the earliest of equal hot
    windows among this task's, and the others as spans (stop)."""
    held: dict[int, list[tuple]] = {}
    hot: list[tuple[np.ndarray, ...]] = []
    size = windows = 0
    names = [f.split()[0] for f in FETCHED.split(", ")]

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        pack = zstandard.ZstdCompressor(level=3)
        blobs = []
        for rows in held.values():
            meta = np.array([r[:6] for r in rows], "<i8")
            blobs.append(pack.compress(np.int64(len(rows)).tobytes() + meta.tobytes() + b"".join(r[6] for r in rows)))
        if blobs:
            k = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(blobs, pa.binary()), *[pa.nulls(k, pa.int64())] * 6], names=names)
        held.clear()
        size = 0

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal windows
        if not hot:
            return
        w1, w2, key, doc, start = (np.concatenate(x) for x in zip(*hot))
        hot.clear()
        windows = 0
        order = np.lexsort((start, doc, key, w2, w1))
        w1, w2, key, doc, start = (x[order] for x in (w1, w2, key, doc, start))
        new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (key != key[first]) | (doc != doc[first]) | (start != start[first])
        w1, w2 = w1[new].view(np.int64), w2[new].view(np.int64)
        for a in range(0, len(w1), 1 << 16):
            s = slice(a, a + (1 << 16))
            m = len(w1[s])
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(w1[s]), pa.array(w2[s]), pa.array(key[new][s]), pa.array(doc[new][s]), pa.array(start[new][s]), pa.nulls(m, pa.int64())], names=names)
        spans = _merged(key[later], doc[later], start[later], length)
        m = len(spans[0])
        if m:
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *map(pa.array, spans)], names=names)

    for batch in batches:
        for key, doc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or b""
            asked = []
            for r in runs:
                end = r["start"] + r["count"] - 1 + length
                if r["kind"] == COMPARE:
                    part = text[r["start"] : end]
                    held.setdefault((r["gram"] >> 32) % buckets, []).append((r["gram"], key, doc, r["start"], r["off"], r["count"], part))
                    size += len(part)
                else:
                    asked.append(np.arange(r["start"], r["start"] + r["count"], dtype=np.int64))
            if asked:
                begin = np.concatenate(asked)
                hot.append((*_window_hashes(np.frombuffer(text, np.uint8), begin, length), np.full(len(begin), key, np.int64), np.full(len(begin), doc, np.int64), begin))
                windows += len(begin)
                if windows >= WINDOWS_HELD:
                    yield from settle()
        if size >= 16 << 20:
            yield from flush()
    yield from flush()
    yield from settle()


def _merged(key: np.ndarray, doc: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Keys, documents, starts and stops of the stretches that windows of this length cover."""
    order = np.lexsort((begin, doc, key))
    key, doc, begin = key[order], doc[order], begin[order]
    if not len(key):
        return key, doc, begin, begin
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + length)]))
    last = np.append(first[1:], len(key)) - 1
    return key[first], doc[first], begin[first], begin[last] + length


def _window_hashes(data: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows that begin at these places."""
    inverse = powers(INVERSE, len(data) + 1)
    one, two = prefix_hash(data), prefix_hash(255 - data)
    other = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + M2) * powers(M3 | U(1), len(data)), out=other[1:])
    back = powers(U(pow(int(M3 | U(1)), -1, 1 << 64)), len(data) + 1)
    end = begin + length
    return mix((one[end] - one[begin]) * inverse[begin] + (two[end] - two[begin]) * inverse[begin] * M1), mix((other[end] - other[begin]) * back[begin])


SPANS_OUT = "key long, doc long, start long, stop long"


def _compare(table: pa.Table, length: int, gram: int) -> pa.Table:
    """Of one bucket's runs: the windows that also start earlier, as spans."""
    meta, parts = [], []
    for blob in table.column("blob").to_pylist():
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        m = np.frombuffer(raw, "<i8", 6 * n, 8).reshape(n, 6)
        at = 8 + 48 * n
        for size in m[:, 5] - 1 + length:
            parts.append(raw[at : at + int(size)])
            at += int(size)
        meta.append(m)
    rows = np.concatenate(meta)
    order = np.argsort(rows[:, 0], kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(rows[order, 0]) != 0, [True]]))
    offs = rows[:, 4].tolist()
    after = [p[o:] for p, o in zip(parts, offs)]
    before = [p[:o][::-1] for p, o in zip(parts, offs)]
    n = len(rows)
    right, left = (np.zeros(n, np.int64), np.zeros(n, np.int64)), (np.zeros(n, np.int64), np.zeros(n, np.int64))
    at = 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        group = order[a:b].tolist()
        shared = gram if len({after[i][:gram] for i in group}) == 1 else 0
        for strings, depth, (numbers, prefixes) in ((after, shared, right), (before, 0, left)):
            found = sort_group(strings, group, depth)
            numbers[at : at + len(found)], prefixes[at : at + len(found)] = zip(*found)
        at += len(group)
    keys, docs, starts, off, count = (rows[:, i] for i in range(1, 6))
    class_right, class_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(length - gram + 1):  # windows whose anchor is at offset j
        has = (off >= j) & (j > off - count)
        if not has.any():
            continue
        class_right[right[0]] = np.cumsum(right[1] < length - j)
        class_left[left[0]] = np.cumsum(left[1] < j)
        own = np.flatnonzero(has)
        begin = starts[own] + off[own] - j
        own_order = np.lexsort((begin, docs[own], keys[own], class_left[own], class_right[own]))
        own, begin = own[own_order], begin[own_order]
        new = np.concatenate([[True], (class_right[own][1:] != class_right[own][:-1]) | (class_left[own][1:] != class_left[own][:-1])])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (keys[own] != keys[own[first]]) | (docs[own] != docs[own[first]]) | (begin != begin[first])
        spans.append((keys[own[later]], docs[own[later]], begin[later]))
    key, doc, begin = (np.concatenate(x) for x in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 3
    return pa.table(dict(zip(("key", "doc", "start", "stop"), map(pa.array, _merged(key, doc, begin, length)))))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """__own (the key), __text (bytes), and the document: __key (a whole number in the keys' order) and __doc."""
    body = F.col(text).cast("string").cast("binary")
    rows = docs.select(F.col(key).alias("__own"), body.alias("__text"), F.xxhash64(F.coalesce(body, F.lit(b""))).alias("__doc"))
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return rows.withColumn("__key", F.coalesce(F.col("__own").cast("long"), F.lit(NO_KEY)))
    # Sorted ranges of the distinct keys: numbers that grow with the key, made once and written down.
    ordered = rows.select("__own").where("__own is not null").distinct().sort("__own")
    numbers = materialize(ordered.select(F.col("__own").alias("__name"), F.monotonically_increasing_id().alias("__number")), "keys")
    return rows.join(numbers, F.col("__own") == F.col("__name"), "left").select("__own", "__text", "__doc", F.coalesce("__number", F.lit(NO_KEY)).alias("__key"))


def _spans(own: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """key, doc, start and stop (bytes; may overlap) of what also starts earlier, over all texts."""
    buckets = max(64, 4 * own.rdd.getNumPartitions())
    packed = own.select("__text", "__key", "__doc").mapInArrow(tidy(lambda it: _gather(it, buckets, length, gram, hot)), "bucket long, blob binary")
    runs = materialize(packed.groupBy("bucket").applyInArrow(_classes, SORTED_OUT), "runs")
    whole = runs.where(F.col("kind") == REMOVED).select("key", "doc", "start", (F.col("start") + F.col("count") - 1 + length).alias("stop"))

    asked = runs.where(F.col("kind") != REMOVED).groupBy("key", "doc").agg(F.collect_list(F.struct("start", "off", "count", "kind", "gram")).alias("runs"))
    joined = own.join(asked, (own["__key"] == asked["key"]) & (own["__doc"] == asked["doc"])).select("key", "doc", "__text", "runs")
    fetched = materialize(joined.mapInArrow(tidy(lambda it: _fetch(it, length, buckets)), FETCHED), "fetched")
    blobs = fetched.where("blob is not null").select(F.col("gram").alias("bucket"), "blob")
    compared = blobs.groupBy("bucket").applyInArrow(lambda t: _compare(t, length, gram), SPANS_OUT)

    settled = fetched.where("stop is not null").select("key", "doc", "start", "stop")
    windows = fetched.where("w1 is not null").select("w1", "w2", "key", "doc", "start")
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("key", "doc", "start")).alias("__first"))
    later = windows.join(earliest, ["w1", "w2"]).where(F.struct("key", "doc", "start") != F.col("__first")).select("key", "doc", "start", (F.col("start") + length).alias("stop"))
    return whole.unionByName(compared).unionByName(settled).unionByName(later)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, text hash (doc), start and stop (bytes; may overlap) of what also starts earlier, over all texts."""
    small_batches(docs.sparkSession)
    own = _identified(docs, key, text)
    names = own.select("__own", F.col("__key").alias("key")).distinct()
    found = _spans(own, length, gram, hot).join(names, "key").select("__own", "doc", "start", "stop")
    return found.withColumnRenamed("__own", key) if key != "doc" else found.select(F.col("__own").alias(key), "start", "stop")


def merge_spans(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover, within size bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], min(s["stop"], size)) for s in spans or []):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, left = 0, []
    for a, b in spans:
        left.append(data[at:a])
        at = b
    left.append(data[at:])
    return b"".join(left)


def _with_spans(docs: DataFrame, key: str, text: str, make: Callable, out: T.StructType, length: int, hot: int) -> DataFrame:
    small_batches(docs.sparkSession)
    own = _identified(docs, key, text)
    lists = _spans(own, length, GRAM, hot).groupBy("key", "doc").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    joined = own.join(lists, (own["__key"] == lists["key"]) & (own["__doc"] == lists["doc"]), "left").select("__own", "__text", "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            made = [make(t or b"", merge_spans(s, len(t or b""))) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*made))], names=out.names) if made else batch.slice(0, 0)

    return joined.mapInArrow(tidy(run), out)


def dedup_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def make(data: bytes, spans: list[tuple[int, int]]) -> tuple:
        return len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_cut(data, spans)).hexdigest()

    kinds = [(key, docs.schema[key].dataType), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    return _with_spans(docs, key, text, make, T.StructType([T.StructField(*k) for k in kinds]), length, hot)


def remaining_text(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """key and the text without the removed bytes; characters that were cut apart are dropped."""
    kinds = [(key, docs.schema[key].dataType), (text, T.StringType())]
    return _with_spans(docs, key, text, lambda data, spans: (_cut(data, spans).decode("utf-8", "ignore"),), T.StructType([T.StructField(*k) for k in kinds]), length, hot)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))
