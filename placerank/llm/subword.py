"""Token ids of whole batches of texts by a public tokenizer, encoding each distinct piece once.

Both tokenizers cut a text into pieces by a fixed pattern and encode piece by piece, so a text's
ids are its pieces' ids one after the other. The pieces of a batch are cut by vectorised rules
over its bytes, each distinct one is encoded by the tokenizers library and remembered in the
worker (up to a number), and the ids are gathered. The rules know the characters below
U+0180 and general punctuation; texts with others, or with a special token's opening ``<|``, are
encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back
from .shingles import _views

MOST_REMEMBERED = 600_000
MOST_BYTES = 4 << 20
LEARN = 8192              # new pieces that are given to the library at once
SPACE, LETTER, NUMBER, OTHER = range(4)


def _class(c: int) -> int:
    kind = unicodedata.category(chr(c))[0]
    return SPACE if c in (9, 10, 11, 12, 13, 32) else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


_CLASS = np.array([_class(c) for c in range(0x180)] + [OTHER], dtype=np.int8)
_SUFFIX1, _SUFFIX2 = np.frombuffer(b"stmd", np.uint8), (b"re", b"ve", b"ll")


class Encoder:
    """``lower``: letters are lower-cased, white space goes and every number character is a piece
    (word_bpe); else a space opens the piece behind it (byte_bpe)."""

    def __init__(self, path: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self.most_bytes, self.most_remembered = MOST_BYTES, MOST_REMEMBERED
        self._forget()
        give_back()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]):
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((x for ids in found for x in ids), np.uint32, int(counts.sum()))
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.count[n:n + len(pieces)] = counts
        self.first[n:n + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + len(pieces))))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Places of distinct pieces in the memory; new ones are encoded."""
        if len(self.known) > self.most_remembered:
            self._forget()
        new = [p for p in pieces if p not in self.known]
        for a in range(0, len(new), LEARN):  # the library's results are many times larger than the ids
            self._learn(new[a:a + LEARN])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array):
        """Yield the ids (uint32) of each text; null counts as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        a, n = 0, len(texts)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        while a < n:
            b, total = a + 1, int(sizes[a])
            while b < n and total + sizes[b] <= self.most_bytes:
                total += int(sizes[b])
                b += 1
            yield from self._encode(texts.slice(a, b - a))
            a = b
        give_back()

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        raw, offsets = _views(texts)
        odd = unknown_texts(raw, offsets)
        out: list = [None] * len(texts)
        if odd.any():
            at = np.flatnonzero(odd)
            for i, ids in zip(at, self._whole([texts[int(i)].as_py() for i in at])):
                out[i] = ids
        plain = np.flatnonzero(~odd)
        if len(plain):
            if odd.any():
                texts = texts.take(pa.array(plain))
            if self.lower:
                texts = pc.utf8_lower(texts)
            raw, offsets = _views(texts)
            for i, ids in zip(plain, self._pieced(raw, offsets)):
                out[i] = ids
        return out

    def _pieced(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if not len(raw):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        starts, spaces = cut(raw, offsets, self.lower)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = pieces.dictionary_encode()
        number = self.numbers(coded.dictionary.to_pylist())
        which = number[coded.indices.to_numpy()]
        count, first = self.count[which], self.first[which]
        if self.lower:
            count[spaces] = 0
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]
        cuts = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return [ids[cuts[i]:cuts[i + 1]] for i in range(len(offsets) - 1)]


def unknown_texts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with characters that the rules of :func:`cut` do not cover."""
    bad = (raw >= 0x1C) & (raw <= 0x1F)
    high = np.flatnonzero(raw >= 0xC2)  # lead bytes
    if len(high):
        lead, nxt = raw[high], raw[np.minimum(high + 1, len(raw) - 1)]
        third = raw[np.minimum(high + 2, len(raw) - 1)]
        fine = ((lead == 0xC2) & (nxt > 0xA0)) | (lead == 0xC3) | (lead == 0xC5) | ((lead == 0xC4) & (nxt != 0xB0))
        fine |= (lead == 0xE2) & (nxt == 0x80) & (third >= 0x90) & ((third <= 0xA7) | (third >= 0xB0))
        fine |= (lead == 0xE2) & (nxt == 0x81) & (third <= 0x9E)
        bad[high[~fine]] = True
    if len(raw) > 1:
        bad[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
    return out


def cut(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pieces start, and which of them are white space."""
    n = len(raw)
    kind = _classes(raw) if (raw >= 0x80).any() else _CLASS[raw]
    lead = (raw & 0xC0) != 0x80
    edge = np.zeros(n + 1, bool)         # first byte of a text, or behind the last
    edge[offsets] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:-1]
    run = start.copy()
    if lower:
        start |= (kind == NUMBER) & lead
        attached = np.zeros(n, bool)
    else:
        # a run of white space before a visible character gives up its last one
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]) if n > 1 else np.zeros(0, int)
        start[last] = True
        opens = last[raw[last] == 0x20]
        start[opens + 1] = False
        attached = np.zeros(n, bool)
        attached[opens + 1] = True
    # contractions: an apostrophe that opens a piece, and the letters behind it
    for i in np.flatnonzero((raw == 0x27) & run & ~attached):
        stop = n if i + 1 >= n else int(offsets[np.searchsorted(offsets, i, "right")])
        if i + 1 < stop and raw[i + 1] in _SUFFIX1:
            end = i + 2
        elif i + 2 < stop and raw[i + 1:i + 3].tobytes() in _SUFFIX2:
            end = i + 3
        else:
            continue
        start[i + 1:end] = False
        if end < n:
            start[end] = True
    starts = np.flatnonzero(start)
    return starts, kind[starts] == SPACE


def _classes(raw: np.ndarray) -> np.ndarray:
    """Class of every byte's character."""
    kind = _CLASS[np.minimum(raw, 0x7F)]
    two = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
    kind[two] = kind[two + 1] = _CLASS[((raw[two].astype(np.int32) & 0x1F) << 6) | (raw[two + 1] & 0x3F)]
    three = np.flatnonzero(raw >= 0xE0)
    kind[three] = kind[three + 1] = kind[three + 2] = OTHER
    return kind


_ENCODERS: dict = {}


def encoder(name: str, most_bytes: int = MOST_BYTES, most_remembered: int = MOST_REMEMBERED) -> Encoder:
    """The worker's encoder of a public tokenizer's file. Smaller slices of text and fewer remembered
    pieces cost time and save memory; the ids are the same."""
    if name not in _ENCODERS:
        import public_tokenizers
        _ENCODERS[name] = Encoder(public_tokenizers.path(name), name.startswith("word_"))
    found = _ENCODERS[name]
    found.most_bytes, found.most_remembered = most_bytes, most_remembered
    return found
