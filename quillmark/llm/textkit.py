"""Vectorised kernels over the bytes of an Arrow string column.

All of them work on slices of a batch that hold whole documents and a bounded
number of bytes (one very long document forms a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
U64 = np.uint64

#: Bytes that separate words: space, and tab to carriage return.
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_RNG = np.random.default_rng(20240607)
#: A random odd value for every byte, for the polynomial hashes.
BYTE_CODE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_CODE_2 = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_POWERS: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on all of x."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(which: int, n: int) -> np.ndarray:
    if len(_POWERS[which]) < n:
        size = max(n, 1024)
        steps = np.full(size, _BASES[which], dtype=U64)
        steps[0] = 1
        _POWERS[which] = np.multiply.accumulate(steps)
    return _POWERS[which][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        if (np.diff(offs)[~valid] != 0).any():
            return string_buffers(column.fill_null(b""))
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) document positions of slices of about ``limit`` bytes."""
    n = len(offsets) - 1
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte range [starts, ends); the ranges ascend and don't overlap."""
    lengths = ends - starts
    out = np.zeros(len(starts), dtype=U64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    if len(s):
        total = int(n.sum())
        first = np.zeros(len(n), dtype=np.int64)
        np.cumsum(n[:-1], out=first[1:])
        within = np.arange(total, dtype=np.int64) - np.repeat(first, n)
        if total == len(data):
            picked = data
        else:
            picked = data[within + np.repeat(s, n)]
        code = (BYTE_CODE if which == 0 else BYTE_CODE_2)[picked]
        code *= _powers(which, int(n.max()))[within]
        out[full] = np.add.reduceat(code, first)
    out += lengths.astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix64(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of every word in a slice; offsets begin at 0."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    sep = IS_SEP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = sep[:-1]
    before |= edge[:-1]
    starts = np.flatnonzero(before & ~sep)
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = sep[1:]
    after |= edge[1:]
    ends = np.flatnonzero(after & ~sep) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values (len - size + 1 of them)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    acc = np.full(n, size, dtype=U64)
    for j in range(size):
        acc *= U64(0xFF51AFD7ED558CCD)
        acc += hashes[j : j + n]
        acc ^= acc >> U64(29)
    return mix64(acc)


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of every run of ``size`` words within a document.

    A document with fewer words gives its whole sequence as one shingle; one without
    words gives none.
    """
    per_doc = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    parts_d, parts_h = [], []
    if len(hashes) >= size:
        same = doc[: len(doc) - size + 1] == doc[size - 1 :]
        parts_d.append(doc[: len(doc) - size + 1][same])
        parts_h.append(window_hash(hashes, size)[same])
    first = np.zeros(n_docs, dtype=np.int64)
    np.cumsum(per_doc[:-1], out=first[1:])
    for m in range(1, size):
        short = np.flatnonzero(per_doc == m)
        if len(short):
            acc = np.full(len(short), m, dtype=U64)
            for j in range(m):
                acc *= U64(0xFF51AFD7ED558CCD)
                acc += hashes[first[short] + j]
                acc ^= acc >> U64(29)
            parts_d.append(short)
            parts_h.append(mix64(acc))
    if not parts_d:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(parts_d), np.concatenate(parts_h)
