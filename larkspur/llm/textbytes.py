"""Hashes of words and n-grams straight from Arrow's UTF-8 buffers, with numpy, in bounded pieces."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes worked on at a time

_SEED = 0x9E3779B97F4A7C15
_U = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_calls = 0


def release() -> None:
    """Give memory that a reused worker has freed back to the system, now and then."""
    global _calls
    _calls += 1
    if _calls % 4 == 0:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_SEED)) | _U(1)
_B = 0xD6E8FEB86659FD93
_INVERSE = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW.get("n", 0) < n:
        size = max(n, 1 << 16)
        _POW.update(n=size, up=_powers(_B, size), down=_powers(_INVERSE, size))
    return _POW["up"], _POW["down"]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[starts:ends] (polynomial, position-free)."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def groups(offsets: np.ndarray, limit: int = PIECE):
    """Ranges [i, j) of rows whose bytes fit in ``limit`` together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        change = np.concatenate([[0], change])
    if inside[-1]:
        change = np.concatenate([change, [len(inside)]])
    return change[0::2], change[1::2]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the white-space separated words of one piece, A-Z lower-cased."""
    low = LOWER[data]
    s, e = _edges(~WHITE[low])
    return run_hashes(low, s, e), s


def long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, cut into pieces at white space (a longer word stays whole)."""
    out, i = [], 0
    while i < len(data):
        j = min(len(data), i + PIECE)
        if j < len(data):
            back = np.flatnonzero(WHITE[data[i:j]])
            if len(back):
                j = i + int(back[-1]) + 1
            else:
                while j < len(data) and not WHITE[data[j]]:
                    j += 1
        out.append(words(data[i:j])[0])
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def each_words(column: pa.Array):
    """Yield the word hashes of each row in turn."""
    offsets, data = buffers(column)
    for i, j in groups(offsets):
        lo, hi = offsets[i], offsets[j]
        if j == i + 1:
            yield long_words(data[lo:hi])
            continue
        piece = data[lo:hi]
        # a separator between rows: words never run over a row's end
        cuts = offsets[i : j + 1] - lo
        spaced = np.insert(piece, cuts[1:-1], 32)
        h, s = words(spaced)
        at = np.searchsorted(s, cuts + np.arange(len(cuts)))
        for k in range(j - i):
            yield h[at[k] : at[k + 1]]


def shingles(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words: the sequence as one."""
    n = len(word_hashes)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * _U(_B) + word_hashes[k : n - size + 1 + k]
    return np.unique(mix(total + _U(size)))
