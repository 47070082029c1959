"""Vectorised text primitives on Arrow batches: chunking, rolling hashes, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20  # bytes of text per vectorised step; a longer text is a step of its own
BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads low-bit structure (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK + 1)
        for base, name in ((BASE, "_pow"), (_INVERSE, "_inv")):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            globals()[name] = np.cumprod(p)
    return _pow[:n], _inv[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums P with hash(i, j) = (P[j] - P[i]) / BASE**i for any slice of ``buf``."""
    power, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end)."""
    _, inverse = _powers(len(prefix))
    h = (prefix[end] - prefix[start]) * inverse[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def window_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` bytes."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, inverse = _powers(len(prefix))
    return mix((prefix[k:] - prefix[:n]) * inverse[:n])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes together, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integer ids; a null id counts as the largest."""
    return pc.fill_null(column.cast(pa.int64()), (1 << 63) - 1).to_numpy(zero_copy_only=False)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than ASCII white space; runs never cross rows."""
    return runs(~((buf == 32) | ((buf >= 9) & (buf <= 13))), offsets)


def runs(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of marked bytes; runs never cross rows."""
    if not len(ink):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(len(ink) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(ink), bool)
    before[0], before[1:] = False, ink[:-1]
    after = np.empty(len(ink), bool)
    after[-1], after[:-1] = False, ink[1:]
    start = np.flatnonzero(ink & (~before | cut[:-1]))
    end = np.flatnonzero(ink & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Slices of ``buf``, not empty, in ascending order, that don't overlap: the number of each among the distinct ones, and those. Bytes are compared."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(buf[inside])])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of the slices' bytes: unlike a polynomial's, its collisions don't come with the structure of a text."""
    if not len(start):
        return np.zeros(0, np.uint64)
    which, distinct = codes(buf, start, end)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[which]


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-word shingles of each row, A-Z lower-cased, and where each row's begin.

    A row with fewer than n words has its whole sequence as one shingle; without words it has none.
    """
    low = lower_ascii(buf)
    start, end, row = words(low, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    w = word_hash(low, start, end)
    have = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(have)])
    owner = np.repeat(np.arange(rows), have)
    begin = first[owner] + (np.arange(at[-1]) - at[owner])
    size = np.minimum(count, n)[owner]
    h = size.astype(np.uint64)
    for j in range(n):
        live = j < size
        part = np.zeros(len(h), np.uint64)
        part[live] = w[begin[live] + j]
        h = mix(h * BASE + part)
    return h, at
