"""Periodic runs inside documents, found by seeding and extending diagonals.

A run is a stretch of consecutive words whose smallest period q fits at least ``EXPONENT`` times and
which has ``SHORTEST`` words at least; no neighbouring word extends it. Words q apart are equal on
all of it, so on the diagonal of lag q the document meets itself for at least
max(SHORTEST - q, 3 q) words. Lags are taken by scales: for those from P to 2P - 1 the guaranteed
overlap is k = 3 P words (5 for the lag 1). All k-grams of a document are indexed and each
occurrence is paired with the next one of the same document if their lag belongs to the scale. As k
is no less than the lag, the next occurrence inside a run of period q is exactly q words on:
a nearer one would make its root a power of a shorter one. So pairs of neighbours are enough, there
are fewer of them than words at each scale, and the lag of a pair is the smallest period of what it
seeds. A seed is extended to both sides word by word; a table holds the furthest word covered at
each lag, and seeds before it, which lie in the run already found, are passed over.

k-grams are compared by exact ranks: those of 3 P words by the ranks of their first 2 P and last P
words, which are made by doubling. A place whose gram occurs once in its document can start no
longer gram that occurs twice and is left out from then on.

Work is per document, in Arrow batches, without a shuffle; documents of a batch share the index.

Defined cases: a null or empty text has no runs and collapses to an empty text; rows are judged one
by one, so ids may be null or repeated; other columns are ignored; an empty table gives no rows.
Words differ when their bytes do (no case folding).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SHORTEST, EXPONENT = 6, 4    # fixed values of the contract
BATCH_WORDS = 1 << 19        # words indexed together; a longer document alone


def _ranks(left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Dense ranks of pairs of ranks below ``most``."""
    code = left * np.int64(most) + right
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    new = np.zeros(len(code), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(code), np.int64)
    out[order] = np.cumsum(new)
    return out


class _Grams:
    """Ranks of the grams of one length that occur twice or more in their document: at each place
    the rank, or -1 where the gram occurs once or reaches over its document's end."""

    def __init__(self, ranks: np.ndarray, doc: np.ndarray, length: int):
        self.length = length
        at = np.flatnonzero(ranks >= 0)
        self.ranks = np.full(len(ranks), -1, np.int64)
        self.next = np.full(len(ranks), -1, np.int64)
        if not len(at):
            return
        own = ranks[at]
        code = doc[at] * np.int64(own.max() + 1) + own
        order = np.argsort(code, kind="stable")
        place, key, code = at[order], own[order], code[order]
        same = code[1:] == code[:-1]
        twice = np.zeros(len(place), bool)
        twice[1:] |= same
        twice[:-1] |= same
        self.ranks[place[twice]] = key[twice]
        self.next[place[:-1][same]] = place[1:][same]

    def then(self, other: "_Grams", doc: np.ndarray) -> "_Grams":
        """Grams of this length followed by those of the other."""
        n, k = len(self.ranks), self.length
        out = np.full(n, -1, np.int64)
        if n > k:
            at = np.flatnonzero((self.ranks[:n - k] >= 0) & (other.ranks[k:] >= 0) & (doc[:n - k] == doc[k:]))
            if len(at):
                right = other.ranks[at + k]
                out[at] = _ranks(self.ranks[at], right, int(right.max()) + 1)
        return _Grams(out, doc, k + other.length)


def _seeds(words: np.ndarray, doc: np.ndarray, longest: int):
    """(place, lag, overlap) of all pairs of neighbouring occurrences, scale by scale."""
    one = _Grams(words.astype(np.int64), doc, 1)
    two = one.then(one, doc)
    half, scale = one, 1
    while EXPONENT * scale <= longest:
        whole = half.then(half, doc)                         # 2 P words
        gram = two.then(two, doc).then(one, doc) if scale == 1 else whole.then(half, doc)
        at = np.flatnonzero(gram.next >= 0)
        lag = gram.next[at] - at
        fits = (lag >= scale) & (lag < 2 * scale)
        yield at[fits], lag[fits], gram.length
        if not (whole.ranks >= 0).any():
            return
        half, scale = whole, 2 * scale


def _extent(words: np.ndarray, place: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """First and last word + 1 of the stretch around the seed in which words ``lag`` apart are equal."""
    step, end = 32, place + lag
    while end < high:
        to = min(end + step, high)
        differ = np.flatnonzero(words[end:to] != words[end - lag:to - lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = to, step * 2
    step, start = 32, place
    while start > low:
        to = max(start - step, low)
        differ = np.flatnonzero(words[to:start] != words[to + lag:start + lag])
        if len(differ):
            start = to + int(differ[-1]) + 1
            break
        start, step = to, step * 2
    return start, end


def find_runs(words: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start, then period. ``words`` are
    numbers of the words of all documents, ``starts`` the first of each and the end of the last."""
    sizes = np.diff(starts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if not len(words):
        return found
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for place, lag, overlap in _seeds(words, doc, int(sizes.max())):
        covered: dict[tuple[int, int], int] = {}             # furthest word covered, of (document, lag)
        # in a chain of seeds one word apart all but the first are covered by its extension
        chained = np.zeros(len(place), bool)
        chained[1:] = (place[1:] == place[:-1] + 1) & (lag[1:] == lag[:-1])
        for i, q in zip(place[~chained].tolist(), lag[~chained].tolist()):
            d = int(doc[i])
            if i + q + overlap <= covered.get((d, q), -1):
                continue
            a, e = _extent(words, i, q, int(starts[d]), int(starts[d + 1]))
            covered[d, q] = e
            if e - a >= max(SHORTEST, EXPONENT * q):
                found[d].append((a - int(starts[d]), e - a, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def planted(doc_id, n: int) -> np.ndarray | None:
    """The contract's test repetition: places of the original words, or None where it has none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % p
    return i


OUT = [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
       ("collapsed", pa.string())]
OUT_TYPE = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _emit(ids: list, lists: list, numbers: list, id_type: pa.DataType) -> pa.RecordBatch:
    starts = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
    words = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    rows = []
    for (d, text), number, runs in zip(zip(ids, lists), numbers, find_runs(words, starts)):
        keep = np.ones(len(number), bool)
        for a, length, q in runs:
            keep[a + q:a + length] = False
        left = b" ".join(text) if not runs else b" ".join([text[i] for i in np.flatnonzero(keep)])
        rows.append((d, len(text), [{"start": a, "length": m, "period": q} for a, m, q in runs], left.decode()))
    names, types = zip(("doc_id", id_type), *OUT)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))


def _find(id_type: pa.DataType, rearrange: Callable | None):
    def find(batches):
        number: dict[bytes, int] = {}
        ids, lists, numbers, held = [], [], [], 0
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = (t.as_py() or "").encode().split()    # words of the contract: cut at ASCII white space
                own = np.array([number.setdefault(w, len(number)) for w in text], np.int64)
                order = rearrange(d, len(text)) if rearrange else None
                if order is not None:
                    text, own = [text[i] for i in order], own[order]
                if ids and held + len(text) > BATCH_WORDS:
                    yield _emit(ids, lists, numbers, id_type)
                    ids, lists, numbers, held, keep = [], [], [], 0, text
                    number = {}
                    own = np.array([number.setdefault(w, len(number)) for w in keep], np.int64)
                ids.append(d)
                lists.append(text)
                numbers.append(own)
                held += len(text)
        if ids:
            yield _emit(ids, lists, numbers, id_type)
    return find


def runs(docs: DataFrame, rearrange: Callable | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, runs by start and period, and ``collapsed``, the text
    without the words that a run holds after its first period. ``rearrange(doc_id, n)`` may give the
    places of the words to read instead of the text's own order."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    return docs.select("doc_id", F.col("text").cast("string").alias("text")) \
        .mapInArrow(_find(arrow, rearrange), f"doc_id {id_type}, {OUT_TYPE}")


def digest(found: DataFrame) -> DataFrame:
    """The greatest run of each document by exact length / period, and digests of all runs and of
    the collapsed text. Ratios of whole numbers are compared by their products."""
    better = "x.length * y.period > y.length * x.period"
    tie = "x.length * y.period = y.length * x.period"
    best = F.expr(f"""aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),
        (y, x) -> CASE WHEN y IS NULL OR {better} OR ({tie} AND (x.start < y.start OR (x.start = y.start AND x.period < y.period)))
        THEN x ELSE y END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")) \
        .select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
