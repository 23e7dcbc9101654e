"""Words of texts as 64-bit hashes, computed on whole byte arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; a hash is the sum of a random
number of each byte times a power of an odd number by its place, mixed with the length.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_LOWER = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _ODD, np.uint64)]), dtype=np.uint64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths in bytes of all words, and the row of each."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = inside
    edge[1:-1] &= ~inside[:-1]
    first = offsets[:-1]
    first = first[first < len(data)]
    edge[first] = inside[first]
    starts = np.flatnonzero(edge[:-1])
    # a word ends at the next space or at the end of its text
    stop = np.zeros(len(data) + 1, bool)
    stop[1:][inside] = True
    stop[:-1][inside] = False
    stop[offsets[1:]] = True
    if len(data):
        stop[0] = False
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        stop &= before
    ends = np.flatnonzero(stop)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends - starts, rows


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the row of each word, in the order of the text."""
    starts, lengths, rows = word_spans(data, offsets)
    return span_hashes(data, starts, lengths, _BYTE_LOWER), rows


def lower_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of given words in order, all of them: what lies between two is white space."""
    return span_hashes(data, starts, lengths, _BYTE_LOWER)


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    gap = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, gap)
    longest = int(lengths.max())
    np.minimum(place, longest - 1, out=place)
    with np.errstate(over="ignore"):
        each = table[data[starts[0] :]] * _powers(longest)[place]
        sums = np.add.reduceat(each, starts - starts[0])
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words; a row with fewer words (but one at least) gives all its words as one."""
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    first = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        long = counts >= size
        n_shingles = np.where(long, counts - size + 1, 0)
        out_rows = np.repeat(np.arange(n_rows), n_shingles)
        at = np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + np.repeat(first, n_shingles)
        value = np.zeros(len(at), np.uint64)
        for k in range(size):
            value = mix(value * _ODD + words[at + k])
        short = np.flatnonzero((counts > 0) & ~long)
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] = mix(extra[has] * _ODD + words[first[short[has]] + k])
        extra = mix(extra + counts[short].astype(np.uint64))
    return np.concatenate([value, extra]), np.concatenate([out_rows, short])
