"""Vectorised text primitives over blocks of many texts.

A block is the UTF-8 bytes of an Arrow column laid end to end with the offsets of its texts. Words, word
hashes and byte codes are computed for the whole block with a few numpy passes, so there is no Python
loop per word. Blocks hold at most BLOCK bytes (or one text, if that is longer), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
U = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> U(30))
    x = x * M2
    x ^= x >> U(27)
    x *= M3
    x ^= x >> U(31)
    return x


#: A random odd-looking word for each byte value, and the base of rolling hashes with its inverse.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * M1)
BASE = U(0xD6E8FEB86659FD93)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * U(pow(int(base), done, 1 << 64))
        done += take
    return out[:n]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null is an empty text."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        big = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, where, data = chunk.buffers()
        offsets = np.frombuffer(where, np.int64 if big else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        if chunk.null_count:  # null slots may cover bytes
            size = np.diff(offsets) * chunk.is_valid().to_numpy(zero_copy_only=False)
            if size.sum() != offsets[-1] - offsets[0]:
                data = np.concatenate([data[a : a + n] for a, n in zip(offsets[:-1], size)] or [data[:0]])
                offsets = np.concatenate([[0], np.cumsum(size)])
        a = 0
        while a < len(chunk):
            b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
            b = min(max(b, a + 1), len(chunk))
            yield row + a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b
        row += len(chunk)


def text_of(offsets: np.ndarray) -> np.ndarray:
    """For each byte, the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; words end with their text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum over j < i of BYTE[data[j]] * BASE ** j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the span stands. inverse: powers(INVERSE, ...)."""
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, 64-bit hashes of the words, and the offsets of each text in these arrays."""
    starts, ends = word_bounds(data, offsets)
    prefix = prefix_hash(data)
    hashes = span_hash(prefix, starts, ends, powers(INVERSE, len(data) + 1))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of width-word shingles and the text of each; a shorter text that has words gives one."""
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, full = np.zeros(len(hashes), np.uint64), bounds[1:][text] - np.arange(len(hashes))
    for k in range(min(width, len(hashes))):
        part = np.zeros(len(hashes), np.uint64)
        part[: len(hashes) - k] = hashes[k:]
        value = np.where(full > k, value * BASE + part + M1, value)
    value = mix(value)
    first = np.zeros(len(hashes), bool)
    first[bounds[:-1][(n > 0) & (n < width)]] = True
    keep = (full >= width) | first
    return value[keep], text[keep]


def sets_of(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted within it, and the offsets of the n texts."""
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(n + 1))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets; empty ranges give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype if values.dtype.kind != "b" else np.int64), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]
