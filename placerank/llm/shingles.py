"""Hashes of words and word shingles of whole batches of texts, vectorised over their bytes.

A word's hash is the sum, over its bytes, of a random 64-bit number drawn for (place, byte)
(tabulation hashing), mixed with its length; a shingle's hash mixes the hashes of its words in
order. A-Z counts as a-z. Two different shingles agree with probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import give_back

PLACES = 64
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2 ** 64, (PLACES, 256), dtype=np.uint64).ravel()
_FAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2 ** 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
MOST_BYTES = 1 << 19  # bytes hashed at once, but for longer single texts


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and after the last)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    start[firsts] |= word[firsts]
    s = np.flatnonzero(start)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    number = np.cumsum(start, dtype=np.int32)
    place = np.arange(len(raw), dtype=np.int64) - s[np.maximum(number - 1, 0)]
    h = _TABLE[((place & (PLACES - 1)) << 8) | _LOW[raw]]
    far = np.flatnonzero((place >= PLACES) & word)
    if len(far):
        h[far] = mix(h[far] * _FAR[(place[far] >> 6) & 0xFFFF] + (place[far] >> 22).astype(np.uint64))
    h[~word] = 0
    hashes = np.add.reduceat(h, s)
    lengths = np.add.reduceat(word.astype(np.int64), s).astype(np.uint64)
    return mix(hashes + lengths * np.uint64(0xA24BAED4963EE407)), np.searchsorted(s, offsets)


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; runs that reach over a text's end are to be left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + words[i:i + n] * np.uint64(2 * i + 0x165667B19E3779F9))
    return out


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + MOST_BYTES, "right")) - 1)
        yield a, b
        a = b


def texts_shingles(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: (hashes of its words, hashes of its k-word shingles in order). A text with
    fewer than ``k`` words has its whole sequence as its only shingle, one without words none."""
    raw, offsets = _views(texts)
    for a, b in _slices(offsets):
        own = offsets[a:b + 1]
        words, at = word_hashes(raw[own[0]:own[-1]], own - own[0])
        grams = ngrams(words, k)
        for i in range(b - a):
            w = words[at[i]:at[i + 1]]
            if len(w) >= k:
                yield w, grams[at[i]:at[i + 1] - k + 1]
            elif len(w):
                yield w, ngrams(w, len(w)) ^ np.uint64(len(w))
            else:
                yield w, w
    give_back()
