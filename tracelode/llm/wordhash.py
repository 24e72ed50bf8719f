"""Vectorised word and shingle hashes of UTF-8 texts.

A word is a run of bytes outside `[\\x20\\x09-\\x0D]`. Its hash is a polynomial over its bytes modulo 2^64, taken as a difference
of running sums and then mixed, so that no word is cut out as a Python string. Equal words have equal hashes in any batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts are taken in slices of about so many bytes, which bounds the memory of the running sums.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64; overwrites nothing."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    source = np.arange(256)
    if lower:
        source[65:91] += 32
    return mix64((source + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, nulls as empty, and n + 1 offsets into them."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray):
    """(first, last + 1) rows of about SLICE_BYTES each; a longer text is alone in its slice."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[data]
    start = solid.copy()
    inner = solid[:-1].copy()
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    inner[cuts - 1] = False  # a word ends with its row
    start[1:] &= ~inner
    end = solid.copy()
    end[:-1] &= ~(solid[1:] & inner)
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool) -> np.ndarray:
    power, inverse = _powers_to(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[lower][data] * power[: len(data)], out=run[1:])
    return mix64((run[e] - run[s]) * inverse[s])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and n + 1 row offsets into them."""
    s, e, rows = word_bounds(data, offsets)
    return hash_spans(data, s, e, lower), rows


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, rows ignored: entry i belongs to the row of word i only if its last word does."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(0xA0761D6478BD642F) + mix64(words[j : len(words) - n + 1 + j] + np.uint64(j + 1))
    return mix64(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles, lower-cased; with fewer words, of the whole sequence."""
    words, rows = word_hashes(data, offsets, True)
    grams, out = ngrams(words, n), []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            # Short sequences are told from shingles and from each other by their length.
            out.append(mix64(ngrams(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
