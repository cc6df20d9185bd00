"""N-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

A document is the set of its distinct word shingles. Sets fall into size bands. If two sets reach the wanted
similarity, their symmetric difference is at most H, a bound that the band knows. The universe of shingles
is hashed into the band's segments; a segment that must match exactly takes one unit of the difference to
break, a segment with its one-deletion neighbourhood takes two. With more than H units some segment of such
a pair must match. A cost model allots segments to the two kinds per band: on a bounded sample of the documents
it counts, for several allotments, the index rows of a band and the distinct pairs that meet there, scales
them to all documents (rows with their number, pairs with its square) and takes the cheapest. Each set indexes the
segments of its own band and of the bands of smaller sets it can still be similar to.

Weak segments, which are empty or have nothing but frequent shingles (of a passage that many documents
share), would make candidates of documents that share little. Bands have some segments to spare, so a similar
pair matches in more segments than that; a set with no more weak exact segments than are spare does not index
them, and only sets with more of them do (segments with neighbourhoods are always indexed). Which shingles are frequent is estimated from a bounded sample into
a bitmap of fixed size. It is the same for all sets, so it decides what is indexed and never what is found.

Signatures are packed by bucket (about seven bytes each) before they are shuffled. Sets that share a
signature are candidates; candidates are compared exactly, by their texts. The result needs links only up
to connectivity, so a signature that very many sets share gives each set two partners first (the group's
first and the one before). Sets that such groups tie together and that are still in different components
are then compared block by block (of like sizes), a matrix product for each two blocks. No pair is dropped: a candidate pair
that is never compared lies in one component already.

Scale: texts are read once for signatures and shuffled once, for candidates alone to be packed. Exact copies
are one class, keyed by a 128-bit hash of the set; classes are joined, never listed as pairs. Intermediate
tables are in the shared folder. Shingles are told apart by 64-bit hashes.

Defined results: A-Z are lower-cased; a set has all shingles of ``width`` words, or the whole sequence if
there are fewer words. A null text, or one without words, has an empty set and links with nothing. The
component is the smallest key it reaches, itself included. Documents are told apart by their sets, never by
their keys: rows with a null key take part like others and are never the smallest (a component of such rows
alone is null), and unlike texts under one key are compared, linked and returned one by one. Repeated rows
stay repeated. Extra columns are ignored: the result has the key and the result columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import drop_table, give_back, if_small, materialize, read, small_batches, tidy, tidy_group
from docloom.llm.components import connected_components
from docloom.llm.textblocks import LOWER, M1, M2, M3, U, blocks, mix, sets_of, shingles, sums, word_hashes

#: Rows that a signature task holds before it packs them; sets of one signature that are paired in full.
FLUSH, FULL = 1 << 20, 12
#: Frequent shingles: documents of the sample, cells of the bitmap, and the least count and share of the sample that make a cell frequent.
SAMPLE, CELLS, LEAST_COUNT, LEAST_SHARE = 20_000, 1 << 22, 10, 0.0005
#: The cost model: documents of its sample, shares of one-deletion segments it compares, and measured costs (in
#: microseconds) of an index row and of a shingle of a text that is fetched and verified.
COST_SAMPLE, SHARES = 4_000, (0.0, 0.25, 0.5, 1.0)
ROW_COST, VERIFY_COST = 1.4, 0.8


@dataclass(frozen=True)
class Similarity:
    """At least p / q of the union is shared."""

    p: int = 85
    q: int = 100

    def most_apart(self, s: int, t: int) -> int:
        """The largest symmetric difference of similar sets of these sizes."""
        return (self.q - self.p) * (s + t) // (self.q + self.p)

    def least_partner(self, n):
        """The smallest size a similar set can have."""
        return -(-n * self.p // self.q)


@dataclass(frozen=True)
class Band:
    """Sizes lo .. hi; segments, of which the last ``deleting`` have one-deletion neighbourhoods, and weak ones to spare."""

    lo: int
    hi: int
    segments: int
    deleting: int
    spare: int


def make_bands(similarity: Similarity, largest: int = 1 << 31, deleting: float | list[float] | None = None) -> list[Band]:
    """Bands over which the smallest and the largest size can still be similar.

    deleting: the share of one-deletion segments, from none (0) to as many as serve (1), of all bands or of each.
    """
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, lo * similarity.q // similarity.p)
        apart = similarity.most_apart(hi, hi * similarity.q // similarity.p)
        share = deleting[len(out)] if isinstance(deleting, list) else float(deleting or 0)
        dels = round(share * ((apart + 2) // 2)) if apart else 0
        exact = max(apart + 1 - 2 * dels, 0)
        spare = 0 if exact < 3 else int(np.ceil(exact / 10)) + 1
        out.append(Band(lo, hi, exact + spare + dels, dels, spare))
        lo = hi + 1
    return out


def band_costs(values: np.ndarray, bounds: np.ndarray, bands: list[Band], similarity: Similarity, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per band: index rows of these sets, and shingles of the distinct pairs that meet in it and have to be verified."""
    keys, of, band = signatures(values, bounds, bands, similarity, frequent, with_band=True)
    rows = np.bincount(band, minlength=len(bands))
    order = np.lexsort((of, keys))
    keys, of, band = keys[order], of[order], band[order]
    if not len(keys):
        return rows, np.zeros(len(bands))
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    first, group = np.repeat(start, size), np.repeat(size, size)
    place = np.arange(len(keys)) - first
    left, right = [], []
    for back in range(1, FULL):  # large groups are paired with two others first
        at = np.flatnonzero((place >= back) & ((group <= FULL) | (back == 1)))
        left.append(at - back)
        right.append(at)
    large = np.flatnonzero((place > 1) & (group > FULL))
    left, right = np.concatenate([*left, first[large]]), np.concatenate([*right, large])
    n = np.diff(bounds)
    a, b = n[of[left]], n[of[right]]
    near = (np.minimum(a, b) * similarity.q >= np.maximum(a, b) * similarity.p) & (of[left] != of[right])
    met = np.unique(np.stack([band[right], np.minimum(of[left], of[right]), np.maximum(of[left], of[right])], axis=1)[near], axis=0)
    verified = np.bincount(met[:, 0], n[met[:, 1]] + n[met[:, 2]], len(bands))
    # The other pairs of large groups are compared block by block, at about the cost of a shingle a pair.
    return rows, verified + np.bincount(band[large], place[large], len(bands))


def allot(own: DataFrame, width: int, similarity: Similarity, frequent, total: int, sample: int = COST_SAMPLE) -> tuple[list[Band], list[dict]]:
    """The bands with the cheapest allotment of each, and what was measured (band, share, rows and shingles to verify, cost).

    own: __text. One task looks at about ``sample`` documents and gives a row per band and allotment.
    """
    share = 1.0 if total <= sample else sample / total
    plain = make_bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = [], set()
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                values, bounds = sets_in(data, offsets, width)
                for i, c in enumerate(class_ids(values, bounds)):
                    if bounds[i] < bounds[i + 1] and c not in seen:
                        seen.add(c)
                        sets.append(values[bounds[i] : bounds[i + 1]])
        if not sets:
            return
        values, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        for part in SHARES:
            rows, verified = band_costs(values, bounds, make_bands(similarity, deleting=part), similarity, frequent.value)
            at = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), part)), pa.array(rows[at] / share), pa.array(verified[at] / share**2)], names=["band", "part", "rows", "verified"])

    picked = own.select("__text").where(F.rand(11) < share) if share < 1 else own.select("__text")
    found = [r.asDict() for r in picked.repartition(1).mapInArrow(tidy(run), "band long, part double, rows double, verified double").collect()]
    best = [0.0] * len(plain)
    least = [float("inf")] * len(plain)
    for r in sorted(found, key=lambda r: r["part"]):
        r["cost"] = ROW_COST * r["rows"] + VERIFY_COST * r["verified"]
        if r["cost"] < least[r["band"]]:
            least[r["band"]], best[r["band"]] = r["cost"], r["part"]
    return make_bands(similarity, deleting=best), found


def cell(values: np.ndarray) -> np.ndarray:
    """The cell of the bitmap of frequent shingles."""
    return (values >> U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequent_cells(own: DataFrame, width: int, total: int, sample: int = SAMPLE) -> np.ndarray:
    """A bitmap (bool) of cells that many of about ``sample`` documents fall into; own: __text."""
    share = 1.0 if total <= sample else sample / total
    picked = own.select("__text").where(F.rand(7) < share) if share < 1 else own.select("__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(CELLS, np.uint32), 0
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                np.add.at(counts, cell(sets_in(data, offsets, width)[0]), 1)
                n += len(offsets) - 1
        if n:
            packed = zstandard.ZstdCompressor(level=1).compress(np.minimum(counts, 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([packed], pa.binary())], names=["n", "z"])

    counts, n = np.zeros(CELLS, np.uint32), 0
    for r in picked.repartition(8).mapInArrow(tidy(count), "n long, z binary").collect():
        counts += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.z)), np.uint16)
        n += r.n
    found = counts >= max(LEAST_COUNT, LEAST_SHARE * n)
    del counts
    give_back()
    return found


def signatures(values: np.ndarray, bounds: np.ndarray, bands: list[Band], similarity: Similarity, frequent: np.ndarray | None = None, with_band: bool = False) -> tuple[np.ndarray, ...]:
    """Keys and set numbers (and bands) of all signatures of a block's sets."""
    n = np.diff(bounds)
    lows, width = np.array([b.lo for b in bands]), np.array([b.segments for b in bands])
    dels, spare = np.array([b.deleting for b in bands]), np.array([b.spare for b in bands])
    own = np.searchsorted(lows, n, side="right") - 1
    least = np.searchsorted(lows, similarity.least_partner(n), side="right") - 1
    token = mix(values ^ M2)
    place = mix(values ^ M3)
    rare = np.ones(len(values), bool) if frequent is None else ~frequent[cell(values)]
    keys, of, bands_of = [], [], []
    for back in range(int((own - least)[n > 0].max(initial=0)) + 1):
        sets = np.flatnonzero((n > 0) & (own - back >= least))
        if not len(sets):
            continue
        band = own[sets] - back
        m = width[band]
        at = np.concatenate([[0], np.cumsum(m)])
        size = n[sets]
        local = np.repeat(np.arange(len(sets)), size)
        index = np.repeat(bounds[:-1][sets], size) + np.arange(len(local)) - np.repeat(np.cumsum(size) - size, size)
        segment = (place[index] % m[local].astype(np.uint64)).astype(np.int64)
        slot = at[local] + segment
        sums_of = np.zeros(at[-1], np.uint64)
        np.add.at(sums_of, slot, token[index])
        strong = np.bincount(slot[rare[index]], minlength=at[-1]) > 0
        owner = np.repeat(np.arange(len(sets)), m)
        deletes = np.arange(at[-1]) - at[owner] >= (m - dels[band])[owner]
        weak = sums(~strong & ~deletes, at)
        keep = strong | deletes | (weak > spare[band])[owner]
        salt = mix((band[owner].astype(np.uint64) << U(32)) + (np.arange(at[-1]) - at[owner]).astype(np.uint64) + M1)
        keys.append(mix(sums_of[keep] ^ salt[keep]))
        of.append(sets[owner[keep]])
        bands_of.append(band[owner[keep]])
        deleting = np.flatnonzero(deletes[slot]) if dels.any() else np.zeros(0, np.int64)
        if len(deleting):
            keys.append(mix((sums_of[slot[deleting]] - token[index[deleting]]) ^ salt[slot[deleting]]))
            of.append(sets[local[deleting]])
            bands_of.append(band[local[deleting]])
    found = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((keys, np.uint64), (of, np.int64), (bands_of, np.int64)))
    return tuple(found) if with_band else tuple(found)[:2]


def sets_in(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, and their bounds."""
    _, _, hashes, bounds = word_hashes(LOWER[data], offsets)
    return sets_of(*shingles(hashes, bounds, width), len(offsets) - 1)


def class_ids(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each set."""
    halves = [mix(sums(mix(values ^ salt), bounds) + np.diff(bounds).astype(np.uint64) * salt) for salt in (M1, M3)]
    joined = np.stack(halves, axis=1).astype(">u8")
    return [row.tobytes() for row in joined]


SIGNED = "doc long, n long, cid binary, node long, bucket long, tag long, blob binary"


def _sign(batches: Iterator[pa.RecordBatch], width: int, similarity: Similarity, bands: list[Band], buckets: int, key: str, frequent) -> Iterator[pa.RecordBatch]:
    tag = TaskContext.get().partitionId()
    schema_of_key = None
    names = [key, *(f.split()[0] for f in SIGNED.split(", "))]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: dict[bytes, int] = {}
    rows = made = 0
    pack = zstandard.ZstdCompressor(level=1)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal rows
        if not held:
            return
        keys, nodes = (np.concatenate(x) for x in zip(*held))
        held.clear()
        rows = 0
        if not len(keys):
            return
        bucket = (keys >> U(32)) % U(buckets)
        order = np.argsort(bucket << U(32) | keys & U(0xFFFFFFFF))
        bucket, low, nodes = bucket[order], (keys[order] & U(0xFFFFFFFF)).astype(np.uint32), nodes[order].astype(np.uint32)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for i in range(0, len(cuts) - 1, 256):
            spans = list(zip(cuts[i : i + 256], cuts[i + 1 : i + 257]))
            blobs = [pack.compress(np.diff(low[a:b], prepend=np.uint32(0)).tobytes() + nodes[a:b].tobytes()) for a, b in spans]
            k = len(blobs)
            columns = [pa.nulls(k, schema_of_key), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([tag] * k, pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        schema_of_key = batch.schema.field(1).type
        for row, data, offsets in blocks(batch.column(0)):
            values, bounds = sets_in(data, offsets, width)
            n = np.diff(bounds)
            ids = class_ids(values, bounds)
            if len(seen) > 1 << 16:  # copies further apart meet as classes later
                seen.clear()
            nodes, new = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
            for i, c in enumerate(ids):
                if n[i]:
                    if c not in seen:
                        seen[c] = made
                        made += 1
                        new[i] = True
                    nodes[i] = seen[c]
            first = np.flatnonzero(new)
            picked = np.concatenate([np.zeros(0, np.int64), *(np.arange(bounds[i], bounds[i + 1]) for i in first)])
            keys, of = signatures(values[picked], np.concatenate([[0], np.cumsum(n[first])]), bands, similarity, frequent.value)
            held.append((keys, nodes[first][of]))
            rows += len(keys)
            k = len(n)
            none = n == 0
            columns = [batch.column(1).slice(row, k), batch.column(2).slice(row, k), pa.array(n), pa.array([None if e else c for c, e in zip(ids, none)], pa.binary()), pa.array((tag << 32) | nodes, mask=none), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if rows >= FLUSH:
                yield from flush()
    yield from flush()


MET = "a long, b long, key long"


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: candidate pairs (key null) and, for keys of more than FULL sets, rows (a: set, b null, key)."""
    unpack = zstandard.ZstdDecompressor()
    keys, nodes = [], []
    bucket = table.column("bucket")[0].as_py()
    for tag, blob in zip(table.column("tag").to_pylist(), table.column("blob").to_pylist()):
        words = np.frombuffer(unpack.decompress(blob), np.uint32)
        keys.append(np.cumsum(words[: len(words) // 2], dtype=np.uint32))
        nodes.append((tag << 32) | words[len(words) // 2 :].astype(np.int64))
    key, node = np.concatenate(keys), np.concatenate(nodes)
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    edge = np.concatenate([[True], key[1:] != key[:-1], [True]])
    single = edge[1:] & edge[:-1]
    key, node = key[~single], node[~single]  # most keys have one set
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    twice = np.zeros(len(key), bool)
    twice[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
    key, node = key[~twice], node[~twice]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    first, group = np.repeat(start, size), np.repeat(size, size)
    place = np.arange(len(key)) - first
    left, right = [], []
    for back in range(1, FULL):
        at = np.flatnonzero((place >= back) & (group <= FULL))
        left.append(node[at - back])
        right.append(node[at])
    large = np.flatnonzero((place >= 1) & (group > FULL))
    left += [node[first[large]], node[large - 1]]
    right += [node[large], node[large]]
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    rest = np.flatnonzero(group > FULL)
    k, r = len(pairs), len(rest)
    return pa.table(
        {
            "a": pa.array(np.concatenate([pairs[:, 0], node[rest]])),
            "b": pa.array(np.concatenate([pairs[:, 1], np.zeros(r, np.int64)]), mask=np.arange(k + r) >= k),
            "key": pa.array(np.concatenate([np.zeros(k, np.int64), (bucket << 32) | key[rest].astype(np.int64)]), mask=np.arange(k + r) < k),
        }
    )


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """cid and the compressed text of the rows of docs (cid, text); a task gives each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            if len(seen) > 1 << 20:
                seen.clear()
            new = [i for i, c in enumerate(batch.column(0).to_pylist()) if not (c in seen or seen.add(c))]
            rows = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([pack.compress(t) for t in rows.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["cid", "z"])

    return docs.select("cid", text).mapInArrow(tidy(run), "cid binary, z binary")


def _class_texts(own: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid and the compressed text of one row of each wanted class.

    A row is found by its key and the hash of its text, as keys may repeat or be null.
    """
    chosen = rows.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct(F.col("__key").alias("k"), F.col("doc").alias("d"))).alias("__r"))
    chosen = materialize(chosen.select("cid", F.col("__r.k").alias("__k"), F.col("__r.d").alias("__d")), "chosen")
    picked = own.join(if_small(chosen), F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__doc") == F.col("__d"))).select("cid", "__text")
    texts = materialize(_packed(picked, "__text"), "texts")
    whole = texts.count() == chosen.count()
    drop_table(chosen)
    if whole:
        return texts
    once = materialize(texts.groupBy("cid").agg(F.first("z").alias("z")), "texts")  # rows that repeat stood in several tasks
    drop_table(texts)
    return once


def shared_counts(values: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and unions of pairs of sets (numbers a and b); the sets of a pair meet in one sort."""
    size = np.diff(bounds)
    shared = np.zeros(len(a), np.int64)
    at = 0
    while at < len(a):  # slices of bounded size
        to = at + max(1, int(np.searchsorted(np.cumsum(size[a[at:]] + size[b[at:]]), 1 << 20)))
        rows = np.concatenate([a[at:to], b[at:to]])
        n = size[rows]
        pair = np.repeat(np.tile(np.arange(to - at), 2), n)
        index = np.repeat(bounds[:-1][rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # Equal values of one pair become neighbours; the pair number is mixed into the value.
        key = values[index] ^ mix(pair.astype(np.uint64) + M1)
        order = np.argsort(key)
        same = (key[order][1:] == key[order][:-1]) & (pair[order][1:] == pair[order][:-1])
        shared[at:to] = np.bincount(pair[order][1:][same], minlength=to - at)
        at = to
    return shared, size[a] + size[b] - shared


def _text_slices(batch: pa.RecordBatch, unpack: zstandard.ZstdDecompressor, most: int = 4 << 20) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """First row, rows, texts, and the numbers of the two texts of each row, of slices of about ``most`` bytes of text."""
    a, za, zb = (batch.column(i).to_pylist() for i in (0, 2, 3))
    first, size, texts, of_a, of_b, known = 0, 0, [], [], [], {}
    for i, x in enumerate(a):
        if x not in known:  # neighbours often share a
            known[x] = len(texts)
            texts.append(unpack.decompress(za[i]))
            size += len(texts[-1])
        of_a.append(known[x])
        of_b.append(len(texts))
        texts.append(unpack.decompress(zb[i]))
        size += len(texts[-1])
        if size >= most:
            yield first, len(of_a), texts, np.array(of_a), np.array(of_b)
            first, size, texts, of_a, of_b, known = i + 1, 0, [], [], [], {}
    if of_a:
        yield first, len(of_a), texts, np.array(of_a), np.array(of_b)


def _verify(pairs: DataFrame, texts: DataFrame, width: int, similarity: Similarity) -> DataFrame:
    """a, b, shared, total and linked of the candidate pairs (a, b: class ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in _text_slices(batch, unpack):
                at, rows, texts, of_a, of_b = part
                values, bounds = [], [np.zeros(1, np.int64)]
                for _, data, offsets in blocks(pa.array(texts, pa.large_binary())):
                    v, o = sets_in(data, offsets, width)
                    bounds.append(o[1:] + bounds[-1][-1])
                    values.append(v)
                shared, total = shared_counts(np.concatenate(values), np.concatenate(bounds), of_a, of_b)
                linked = similarity.q * shared >= similarity.p * total
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array(shared), pa.array(total), pa.array(linked)], names=["a", "b", "shared", "total", "linked"])

    left = texts.select(F.col("cid").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("cid").alias("b"), F.col("z").alias("zb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "za", "zb")
    return met.mapInArrow(tidy(run), "a binary, b binary, shared long, total long, linked boolean")


#: Shingles of a block of sets, and cells of a matrix of two parts of blocks.
BLOCK, MATRIX = 1 << 20, 1 << 20


def _shared_matrix(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered one and two. Memory follows the shingles of these sets, and slices of 4,096 columns."""
    used = np.unique(np.concatenate([one, two]))
    slot = np.zeros(len(sets), np.int64)
    slot[used] = np.arange(len(used))
    of = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    values = np.concatenate([sets[i] for i in used])
    order = np.argsort(values, kind="stable")
    of, values = of[order], values[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    again = np.append(~new[1:], False) | ~new if len(values) else new  # in two sets or more
    place = np.cumsum(new[again])  # numbers of the shingles that count
    of = of[again]
    shared = np.zeros((len(one), len(two)), np.int64)
    for lo in range(1, int(place[-1]) + 1 if len(place) else 1, 4096):
        a, b = np.searchsorted(place, (lo, lo + 4096))
        part = np.zeros((len(used), 4096), np.float32)
        part[of[a:b], place[a:b] - lo] = 1
        shared += (part[slot[one]] @ part[slot[two]].T).astype(np.int64)
    return shared


def _linked_pairs(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray | None, similarity: Similarity, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of linked pairs, between one and two or (two None) within one. Halves are taken until a part has few shingles."""
    size = np.array([len(s) for s in sets], np.int64)
    large = size[one].sum() + (0 if two is None else size[two].sum()) > most or len(one) * len(one if two is None else two) > MATRIX
    if large and (len(one) > 1 or two is not None and len(two) > 1):
        if two is None:
            x, y = one[: len(one) // 2], one[len(one) // 2 :]
            for p, q in ((x, None), (y, None), (x, y)):
                yield from _linked_pairs(sets, p, q, similarity, most)
        else:
            longer, other = (one, two) if len(one) >= len(two) else (two, one)
            for p in (longer[: len(longer) // 2], longer[len(longer) // 2 :]):
                yield from _linked_pairs(sets, p, other, similarity, most)
        return
    two = one if two is None else two
    shared = _shared_matrix(sets, one, two)
    x, y = np.nonzero(similarity.q * shared >= similarity.p * (size[one][:, None] + size[two][None, :] - shared))
    yield one[x], two[y]


def _block_links(table: pa.Table, width: int, similarity: Similarity) -> pa.Table:
    """Of two blocks of sets (side 0 and 1; side 0 alone: with itself): one link for every two components that are linked."""
    unpack = zstandard.ZstdDecompressor()
    side = np.array(table.column("side").to_pylist())
    cids, comps = table.column("cid").to_pylist(), table.column("comp").to_pylist()
    sets = []
    for z in table.column("z"):
        data = np.frombuffer(unpack.decompress(z.as_py()), np.uint8)
        sets.append(sets_in(data, np.array([0, len(data)]), width)[0])
    number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([number[c] for c in comps])
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    links: dict[tuple[int, int], tuple[int, int]] = {}
    for x, y in _linked_pairs(sets, one, two if len(two) else None, similarity):
        apart = np.flatnonzero(comp[x] != comp[y])
        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            links.setdefault((min(comp[i], comp[j]), max(comp[i], comp[j])), (i, j))
    return pa.table({"a": pa.array([cids[i] for i, _ in links.values()], pa.binary()), "b": pa.array([cids[j] for _, j in links.values()], pa.binary())})


def _across(rest: DataFrame, component: DataFrame, texts: DataFrame, width: int, similarity: Similarity) -> DataFrame:
    """Links between components of the sets of large groups, a and b, found by comparing blocks of sets.

    Sets that large groups tie together are a family. Families that lie in one component are done. The others'
    sets are dealt by size into bands, so that similar sets are in the same or in neighbouring bands, and within a band
    into blocks of about BLOCK shingles: parts of one large component each, or small components together. All pairs
    of blocks of such bands are compared but those inside one large component.
    """
    least = rest.groupBy("key").agg(F.min("cid").alias("b"))
    ties = rest.select("key", F.col("cid").alias("a")).join(least, "key").where("a <> b").select("a", "b").distinct()
    families = connected_components(ties).select(F.col("node").alias("cid"), F.col("component").alias("family"))
    own = rest.select("cid", "n").distinct().join(families, "cid")
    step = math.log(similarity.q / similarity.p) * (1 + 1e-6)  # a little more, for rounding
    band = F.floor(F.log(F.col("n")) / F.lit(step)).cast("long") if step else F.col("n")
    placed = own.join(component.withColumnRenamed("component", "comp"), F.col("cid") == F.col("node"), "left").select("family", "cid", F.coalesce("comp", "cid").alias("comp"), band.alias("band"), "n")
    placed = materialize(placed, "families")
    apart = placed.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("family")
    sizes = placed.groupBy("family", "band", "comp").agg(F.sum("n").alias("size"))
    small = sizes.groupBy("family", "band").agg(F.sum(F.when(F.col("size") < BLOCK // 2, F.col("size")).otherwise(0)).alias("small"))
    known = sizes.join(apart, "family").join(small, ["family", "band"])
    pure = F.col("size") >= BLOCK // 2
    slots = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    name = F.when(pure, F.concat_ws(":", "band", F.hex("comp"), F.pmod(F.xxhash64("cid"), slots(F.col("size"))).cast("string"))).otherwise(F.concat_ws(":", "band", F.pmod(F.xxhash64("comp"), slots(F.col("small"))).cast("string")))
    dealt = materialize(placed.join(known, ["family", "band", "comp"]).select("family", "cid", "comp", "band", name.alias("block"), F.when(pure, F.col("comp")).alias("pure")), "blocks")
    drop_table(placed)
    blocks_of = dealt.select("family", "band", "block", "pure").distinct()
    x, y = (blocks_of.select("family", F.col("band").alias(f"band_{s}"), F.col("block").alias(f"block_{s}"), F.col("pure").alias(f"pure_{s}")) for s in "xy")
    meet = x.join(y, "family").where("abs(band_x - band_y) <= 1 and block_x <= block_y and coalesce(pure_x <> pure_y, true)").select("family", "block_x", "block_y")
    sides = meet.select("*", F.explode(F.when(F.col("block_x") == F.col("block_y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    rows = sides.withColumn("block", F.when(F.col("side") == 0, F.col("block_x")).otherwise(F.col("block_y"))).join(dealt.drop("pure", "band"), ["family", "block"]).join(texts, "cid")
    found = materialize(rows.select("family", "block_x", "block_y", "side", "cid", "comp", "z").groupBy("family", "block_x", "block_y").applyInArrow(tidy_group(lambda t: _block_links(t, width, similarity)), "a binary, b binary"), "across")
    drop_table(dealt)
    return found


def _grouped(docs: DataFrame, key: str, text: str, width: int, similarity: Similarity, deleting: float | None) -> DataFrame:
    """__key, doc (the text's hash), n, __c (the component, null without words) and __least (its smallest key) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    body = F.col(text).cast("string")
    own = docs.select(body.alias("__text"), F.col(key).alias("__key"), F.xxhash64(body).alias("__doc"))
    buckets = max(64, 4 * own.rdd.getNumPartitions())
    total = own.count()
    frequent = spark.sparkContext.broadcast(frequent_cells(own, width, total))
    bands = allot(own, width, similarity, frequent, total)[0] if deleting is None else make_bands(similarity, deleting=deleting)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("__key", kind), *T._parse_datatype_string(SIGNED).fields])
    signed = materialize(own.mapInArrow(tidy(lambda it: _sign(it, width, similarity, bands, buckets, "__key", frequent)), schema), "signatures")
    rows = materialize(signed.where("bucket is null").select("__key", "doc", "n", "cid", "node"), "sets")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("__key").alias("__rep"), F.first("n").alias("n"))

    met = materialize(signed.where("bucket is not null").select("bucket", "tag", "blob").groupBy("bucket").applyInArrow(tidy_group(_meet), MET), "met")
    drop_table(signed)
    nodes = rows.where("node is not null").select("node", "cid", "n").distinct()
    reach = lambda n, m: F.least(n, m) * similarity.q >= F.greatest(n, m) * similarity.p
    left = nodes.select(F.col("node").alias("a"), F.col("cid").alias("ca"), F.col("n").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("cid").alias("cb"), F.col("n").alias("nb"))
    paired = met.where("key is null").select("a", "b").distinct().join(left, "a").join(right, "b").where((F.col("ca") != F.col("cb")) & reach(F.col("na"), F.col("nb")))
    pairs = materialize(paired.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "pairs")
    rest = materialize(met.where("key is not null").select("key", F.col("a").alias("node")).join(nodes, "node").select("key", "cid", "n").distinct(), "rest")
    drop_table(met)

    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).unionByName(rest.select("cid")).distinct()
    texts = _class_texts(own, rows, wanted)
    links = materialize(_verify(pairs, texts, width, similarity), "links")
    drop_table(pairs)
    found = links.where("linked").select("a", "b")
    component = connected_components(found)

    more = _across(rest, component, texts, width, similarity)
    drop_table(texts)
    drop_table(rest)
    if not more.isEmpty():
        first, component = component, connected_components(found.unionByName(more))
        drop_table(first)
    drop_table(links)
    drop_table(more)

    # The smallest key of each component.
    labelled = classes.join(component, classes["cid"] == component["node"], "left").select("cid", "__rep", F.coalesce("component", "cid").alias("__c"))
    smallest = labelled.groupBy("__c").agg(F.min("__rep").alias("__least"))
    final = labelled.join(smallest, "__c").select("cid", "__c", "__least")
    return rows.join(final, "cid", "left").select("__key", "doc", "n", "__c", "__least")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: Similarity = Similarity(80, 100), deleting: float | None = None) -> DataFrame:
    """key, n_shingles and component_id of every row of docs. deleting: the share of one-deletion segments, in place of the cost model's."""
    rows = _grouped(docs, key, text, width, similarity, deleting)
    return rows.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("__least", "__key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: Similarity = Similarity(80, 100)) -> DataFrame:
    """The rows of docs that stay if of each component one does; rows whose text has no words all stay.

    The one with the smallest key stays (no key is the largest); of unlike texts under one key that with the
    smaller text hash; of rows that repeat key and text any one.
    """
    rows = materialize(_grouped(docs, key, text, width, similarity, None).where("__c is not null").select("__key", "doc", "__c"), "grouped")
    name = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("k"), F.col("doc").alias("d"))
    best = materialize(rows.groupBy("__c").agg(F.min(name).alias("__b")), "best")
    marked = rows.join(if_small(best), "__c").groupBy("__key", "doc").agg(F.first(name != F.col("__b")).alias("__gone"), F.count("*").alias("__n"))
    marked = materialize(marked.where("__gone or __n > 1").withColumnRenamed("__key", "__k"), "marked")
    drop_table(rows)
    drop_table(best)
    own = docs.withColumn("__d", F.xxhash64(F.col(text).cast("string")))
    on = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__d") == F.col("doc"))
    left = own.join(if_small(marked.select("__k", "doc")), on, "left_anti").select(*docs.columns)
    again = marked.where("not __gone")
    if again.isEmpty():
        return left
    # Rows that repeat a key and text which stay: one of each. Map-side first, so copies do not meet in full.
    twice = own.join(if_small(again.select("__k", "doc")), on, "left_semi").groupBy(F.col(key).alias("__k"), "__d").agg(F.first(F.struct(*docs.columns)).alias("__r"))
    return left.unionByName(twice.select("__r.*"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=4, similarity=Similarity(85, 100))
