"""Word shingles of whole Arrow batches of texts, by numpy.

Words are runs without white space ([\x20\x09-\x0D]), A-Z in lower case. A shingle is five
words in a row; a text with fewer words is one shingle as a whole; a text without words
has none. A shingle stands as a 64-bit hash of its words: equal words give equal hashes,
on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number per byte value, and odd factors for positions.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FACTORS = _mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more for the end); null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and at which word each text begins (one more for the end)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[raw]
    inside = ~_BLANK[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]  # a word ends with its text
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    end = np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), np.uint64)
    # Sum of byte numbers times powers, shifted back to the word's start; in parts, as
    # each byte takes eight times its room here.
    step = 1 << 20
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + step, "right")))
        a, b = start[lo], end[hi - 1]
        powers = _powers(_BASE, b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[low[a:b]] * powers, out=sums[1:])
        back = _powers(_INVERSE, b - a)
        s, e = start[lo:hi] - a, end[lo:hi] - a
        hashes[lo:hi] = _mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        lo = hi
    return hashes, np.searchsorted(start, offsets)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order of place, repeats included, and where each text's begin."""
    words, begin = word_hashes(*utf8(texts))
    n_words = np.diff(begin)
    counts = np.where(n_words >= WORDS, n_words - WORDS + 1, (n_words > 0).astype(np.int64))
    where = np.zeros(len(begin), np.int64)
    np.cumsum(counts, out=where[1:])
    out = np.empty(where[-1], np.uint64)
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        windows = words[:n] * _FACTORS[0]
        for k in range(1, WORDS):
            windows += words[k : k + n] * _FACTORS[k]
        windows = _mix(windows)
    long = n_words >= WORDS
    if long.any():
        # Places of the windows that lie in one text.
        at = np.arange(where[-1]) - np.repeat(where[:-1], counts) + np.repeat(begin[:-1], counts)
        full = np.repeat(long, counts)
        out[full] = windows[at[full]]
    for i in np.flatnonzero((n_words > 0) & ~long):
        k = int(n_words[i])
        own = (words[begin[i] : begin[i] + k] * _FACTORS[:k]).sum(dtype=np.uint64)
        out[where[i]] = _mix(np.array([own + np.uint64(k)], np.uint64))[0]
    return out, where


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the distinct shingle hashes, ascending."""
    hashes, where = shingles(texts)
    return [np.unique(hashes[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)]
