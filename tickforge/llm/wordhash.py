"""Words and word n-grams of whole texts as 64-bit hashes, vectorised over UTF-8 bytes.

A word is a run of bytes other than space, tab, LF, VT, FF and CR. Hashing is polynomial over a
random byte table modulo 2^64 with a final mix, computed from prefix sums: no Python step per word.
"""

import numpy as np
import pyarrow as pa

PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at a time; bounds the memory for one very long text.
SEGMENT = 1 << 20

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = TABLE.copy()
LOWER[65:91] = TABLE[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of PRIME and of its inverse."""
    held = _POWERS
    if len(held[0]) < n:
        held[:] = [np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(max(n, 1 << 16), p)))) for p in (PRIME, INVERSE)]
    return held[0][:n], held[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more for the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of each word, and the index of each text's first word (one more for the end)."""
    full = ~SPACE[data]
    before, after = np.empty_like(full), np.empty_like(full)
    if len(full):
        before[1:], after[:-1] = full[:-1], full[1:]
        before[0] = after[-1] = False
        inner = at[(at > 0) & (at < len(full))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(full & ~before)
    ends = np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    table = LOWER if lower else TABLE
    out = np.empty(len(starts), np.uint64)
    first = 0
    powers = inverse = np.ones(1, np.uint64)
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + SEGMENT, side="right")))
        n = int(ends[last - 1] - base)
        if len(powers) < n + 1:
            powers = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n, PRIME))))
            inverse = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n, INVERSE))))
        total = np.concatenate(([np.uint64(0)], np.cumsum(table[data[base : base + n]] * powers[:n])))
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        first = last
    return mix(out)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, and the index of each text's first window.

    A text of fewer words, but one at least, has one window: all its words.
    """
    count = np.diff(first)
    windows = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(windows)))
    begin = np.repeat(first[:-1] - at[:-1], windows) + np.arange(at[-1])
    stop = np.repeat(first[1:], windows)
    out = np.zeros(len(begin), np.uint64)
    for k in range(n):
        i = begin + k
        there = i < stop
        word = h[np.minimum(i, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(there, mix(out * np.uint64(3) + word + np.uint64(k + 1)), out)
    return out, at
