"""Substring deduplication: paragraphs under banded MinHash.

Every line of a text is a paragraph, whatever its length, if it has a shingle (``SHINGLE`` words).
A repeated passage is often pasted into the middle of a line, so further paragraphs (windows) are
cut by content: of the 5-word shingles of a text, the one with the least hash in some run of
``SPREAD`` neighbours is an anchor, and the ``WORDS`` words from it on are a window. Any passage of
``SPREAD + WORDS - 1`` words (51) or more has an anchor whose window lies inside it, wherever
it is pasted; a shorter or edited one inside a line has one only by chance.

A paragraph is the set of its 5-word shingles. ``LINE_BANDS`` bands of ``LINE_ROWS`` MinHash values
make two lines of similarity 0.8 meet with probability ``1 - (1 - 0.8^3)^12``, 0.9998; ``BANDS`` bands
of ``ROWS`` values make two windows of it meet with ``1 - (1 - 0.8^2)^4``, 0.983, and a passage holds
several windows. Copies always meet. Paragraphs that meet are verified by their exact
Jaccard similarity (0.8 or more) and joined to components. A component that lies in several
documents is a repeat: its first document (by id) keeps it, in the others it is to be removed.
Each of its paragraphs is held against those of the first document and extended, word by word, to
both sides as far as the words agree, so that a span reaches to the ends of what is repeated. A line
goes whole; of a window that is not equal, what lies outside its first and last common shingle stays.

Equal paragraphs are one node, and a task reports each of its distinct ones once, so a passage
held by a third of all documents reaches a key once for each batch read. Keys are dealt in blocks, so
that a row of the shuffle holds what a batch has for a block, not one key. Similarity compares the
lower 48 bits of each shingle's hash.

Defined cases: null and empty texts and lines of fewer than ``SHINGLE`` words have no paragraphs,
texts of fewer than ``WORDS`` words no windows; a row without id takes no part; rows that repeat an id are one document; repeats within one document
only are left alone; without repeats, or with an empty table, there are no rows. Other columns are
not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .buckets import Field, centred, resolve_keys
from .common import bounded_batches, saved, settled, small_side
from .shingles import _SPACE, _views, mix, texts_shingles

SHINGLE, SPREAD, WORDS = 5, 30, 22
PERCENT = 80
BANDS, ROWS = 4, 2             # of windows
LINE_BANDS, LINE_ROWS = 12, 3
BROADCAST_ROWS = 500_000   # documents broadcast at most to pick texts for verification
GRAMS = WORDS - SHINGLE + 1
BLOCKS = 8                 # of keys, for each shuffle partition
GRAM_BYTES = 6             # of a shingle's hash that similarity compares
GRAM_MASK = np.uint64((1 << 8 * GRAM_BYTES) - 1)
FEW = 8                    # sets of a bucket that are all compared
KEEP_ROWS = 256            # documents that one task holds in a row against one first document

_RNG = np.random.Generator(np.random.PCG64(97))
_XOR = _RNG.integers(0, 2 ** 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(0, 2 ** 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LINE_XOR = _RNG.integers(0, 2 ** 63, LINE_BANDS * LINE_ROWS, dtype=np.uint64)
_LINE_ODD = _RNG.integers(0, 2 ** 62, LINE_BANDS * LINE_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = of(out[:-done], out[done:])
        done *= 2
    return of(out[:len(x) - width + 1], out[width - done:]) if done < width else out


def anchors(grams: np.ndarray, n_words: int) -> np.ndarray:
    """Places (words) at which the paragraphs of a text start."""
    n = n_words - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = grams[:n]
    if n <= SPREAD:
        return np.flatnonzero(value == value.min())
    least = _sliding(value, SPREAD, np.minimum)
    most = _sliding(np.concatenate([np.zeros(SPREAD - 1, np.uint64), least, np.zeros(SPREAD - 1, np.uint64)]),
                    SPREAD, np.maximum)
    return np.flatnonzero(most == value)


def paragraph_grams(grams: np.ndarray, places: np.ndarray) -> np.ndarray:
    return grams[places[:, None] + np.arange(GRAMS)]


def digest(windows: np.ndarray) -> np.ndarray:
    """64-bit digest of each paragraph's shingles."""
    return mix(mix(windows).sum(axis=1, dtype=np.uint64)).astype(np.int64)


def _keys(least: np.ndarray, bands: int, rows: int, first: int) -> np.ndarray:
    keys = []
    for i in range(bands):
        key = np.full(len(least), first + i, dtype=np.uint64)
        for j in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, i * rows + j])
        keys.append(key)
    return np.stack(keys, axis=1).astype(np.int64)


def band_keys(windows: np.ndarray) -> np.ndarray:
    """Keys of the bands, a row for each window."""
    least = np.stack([((windows ^ x) * a).min(axis=1) for x, a in zip(_XOR, _ODD)], axis=1)
    return _keys(least, BANDS, ROWS, 1)


def line_keys(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys of the bands, a row for each line; a line's shingles are those from its start on."""
    least = np.stack([np.minimum.reduceat((grams ^ x) * a, starts) for x, a in zip(_LINE_XOR, _LINE_ODD)], axis=1)
    return _keys(least, LINE_BANDS, LINE_ROWS, BANDS + 1)


def lines(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the lines of a text (bytes) that have a shingle."""
    word = ~_SPACE[raw]
    word[1:] &= ~word[:-1]
    begins = np.flatnonzero(word)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(begins, np.flatnonzero((raw == 10) | (raw == 13))),
                                     [len(begins)]]))
    first, n = cuts[:-1], np.diff(cuts)
    return first[n >= SHINGLE], n[n >= SHINGLE]


BANDED = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("docs", pa.binary()),
                    ("places", pa.binary()), ("words", pa.binary()), ("lines", pa.binary())])
BANDED_DDL = "block int, keys binary, nodes binary, docs binary, places binary, words binary, lines binary"
MET = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("held", pa.int64()), ("doc", pa.int64()),
                 ("place", pa.int32()), ("words", pa.int32()), ("line", pa.bool_())])
MET_DDL = "key long, digest long, held long, doc long, place int, words int, line boolean"


def _distinct(keys, own, line, n_keys=None):
    """(keys, digests) of the distinct paragraphs ``own``, of whose keys ``n_keys`` hold. ``keys``: from
    the distinct ones' numbers. A key's last bit says whether it is a line's."""
    own, first = np.unique(own, return_index=True)
    key = (keys(first) & ~np.int64(1)) | np.int64(line)
    held = np.ones(key.shape, bool) if n_keys is None else np.arange(key.shape[1])[None, :] < n_keys[first, None]
    return key[held], np.repeat(own, held.sum(axis=1))


def _windows_banded(found: list):
    doc, place, window = (np.concatenate(x) for x in zip(*found))
    own = digest(window)
    return _distinct(lambda first: band_keys(window[first]), own, False), \
        (own, doc, place, np.full(len(doc), WORDS, dtype=np.int32), np.zeros(len(doc), np.uint8))


def _lines_banded(found: list):
    doc, place, words, grams = (np.concatenate(x) for x in zip(*found))
    n = words - SHINGLE + 1
    ends = np.cumsum(n, dtype=np.int64)
    own = mix(np.add.reduceat(mix(grams), ends - n)).astype(np.int64)

    def keys(first):
        size = n[first].astype(np.int64)
        start = np.cumsum(size) - size
        picked = np.repeat(ends[first] - size - start, size) + np.arange(size.sum())
        return line_keys(grams[picked], start)

    # sets of up to 3 elements are similar only to equal ones, which share every band
    return _distinct(keys, own, True, np.where(n < 4, 1, LINE_BANDS)), (own, doc, place, words, np.ones(len(doc), np.uint8))


def _banded(batches, blocks: int):
    """Of each batch of texts, a row for each block of keys, with the keys and digests of its distinct
    paragraphs, and a row without keys with all its places."""
    for batch in batches:
        windows, whole = [], []
        raw, offsets = _views(batch.column("text"))
        for i, (doc, (words, grams)) in enumerate(zip(batch.column("doc_id").to_pylist(),
                                                      texts_shingles(batch.column("text"), SHINGLE))):
            at = anchors(grams, len(words))
            if len(at):
                windows.append((np.full(len(at), doc, dtype=np.int64), at.astype(np.int32), paragraph_grams(grams, at)))
            at, n = lines(raw[offsets[i]:offsets[i + 1]]) if len(words) >= SHINGLE else ([], [])
            if len(at):
                whole.append((np.full(len(at), doc, dtype=np.int64), at.astype(np.int32), n.astype(np.int32),
                              np.concatenate([grams[a:a + k - SHINGLE + 1] for a, k in zip(at.tolist(), n.tolist())])))
        parts = [f(x) for f, x in ((_windows_banded, windows), (_lines_banded, whole)) if x]
        if not parts:
            continue
        keys, nodes = (np.concatenate(x) for x in zip(*(p[0] for p in parts)))
        block = ((keys.view(np.uint64) >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        keys, nodes, block = keys[order], nodes[order], block[order]
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
        out = [(int(block[a]), keys[a:b].tobytes(), nodes[a:b].tobytes(), None, None, None, None)
               for a, b in zip(cuts, [*cuts[1:], len(block)])]
        own, *places = (np.concatenate(x).tobytes() for x in zip(*(p[1] for p in parts)))
        out.append((int(mix(keys[:1].view(np.uint64))[0] % np.uint64(blocks)), None, own, *places))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), BANDED)], schema=BANDED)


def _met(keys: list, nodes: list) -> pa.RecordBatch:
    """Distinct (key, digest) of the keys of a block that at least two digests hold, and how many do."""
    key, node = (np.frombuffer(b"".join(x), dtype=np.int64) for x in (keys, nodes))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node = key[new], node[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    held = np.diff(np.concatenate([starts, [len(key)]]))
    held = np.repeat(held, held)
    out = held > 1
    return pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, node, held)]
                                      + [pa.nulls(int(out.sum()), f.type) for f in list(MET)[3:]], schema=MET)


def _meeting(batches):
    """Of rows in the order of their blocks, the members of keys that two digests hold, and all places."""
    now, keys, nodes = None, [], []
    for batch in batches:
        for block, *found in zip(*(c.to_pylist() for c in batch.columns)):
            if found[0] is None:
                own, doc, place, words, line = (np.frombuffer(x, dtype=d) for x, d in
                                                zip(found[1:], (np.int64, np.int64, np.int32, np.int32, np.uint8)))
                none = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(own), none, *map(pa.array, (doc, place, words)),
                                                  pa.array(line.astype(bool))], schema=MET)
                continue
            if block != now:
                if keys:
                    yield _met(keys, nodes)
                now, keys, nodes = block, [], []
            keys.append(found[0])
            nodes.append(found[1])
    if keys:
        yield _met(keys, nodes)


def meeting_paragraphs(docs: DataFrame) -> DataFrame:
    """Stored (key, digest, held, doc, place, words, line): a row with key for each digest under a key that
    several (``held``) have, a row without key for each place of a paragraph. Keys meet in blocks; a row of
    the shuffle is what a batch of texts has for a block."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                   F.col("text").cast("string").alias("text"))
    blocks = BLOCKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = rows.mapInArrow(lambda batches: _banded(batches, blocks), BANDED_DDL)
    return saved(banded.repartition("block").sortWithinPartitions("block").mapInArrow(_meeting, MET_DDL), "paragraphs")


def _packed(grams: np.ndarray) -> bytes:
    """The lower ``GRAM_BYTES`` bytes of each shingle's hash."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]).tobytes()


def unpacked(packed) -> np.ndarray:
    own = np.zeros((len(packed) // GRAM_BYTES, 8), np.uint8)
    own[:, :GRAM_BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, GRAM_BYTES)
    return own.view("<u8").ravel()


def _sets(batches):
    """Of documents with the paragraphs asked of them, the distinct shingles of each, ascending."""
    schema = pa.schema([("digest", pa.int64()), ("grams", pa.binary())])
    for batch in batches:
        asked = batch.column("wanted")
        held = np.diff(asked.offsets.to_numpy())
        digests, place, words = (asked.flatten().field(c).to_numpy() for c in ("digest", "place", "words"))
        sizes, grams = zip(*((len(w), g) for w, g in texts_shingles(batch.column("text"), SHINGLE)))
        n_grams = np.array([len(g) for g in grams])
        of = np.repeat(np.arange(len(held)), held)
        there = place + words <= np.array(sizes)[of]  # an id may have several texts
        digests, place, n, of = digests[there], place[there], words[there].astype(np.int64) - SHINGLE + 1, of[there]
        if not len(of):
            continue
        ends = np.cumsum(n)
        at = (np.cumsum(n_grams) - n_grams)[of] + place
        value = np.concatenate(grams)[np.repeat(at - (ends - n), n) + np.arange(ends[-1])]
        same = mix(np.add.reduceat(mix(value), ends - n)).astype(np.int64) == digests
        which, value = np.repeat(np.arange(len(n)), n), value & GRAM_MASK
        order = np.lexsort((value, which))
        which, value = which[order], value[order]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (value[1:] != value[:-1])]) & same[which]
        which, value = which[new], value[new]
        count = np.bincount(which, minlength=len(n))
        offsets = np.concatenate([[0], np.cumsum(count[same])]) * GRAM_BYTES
        packed = pa.Array.from_buffers(pa.binary(), int(same.sum()), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()),
                                                                      pa.py_buffer(_packed(value))])
        yield pa.RecordBatch.from_arrays([pa.array(digests[same]), packed], schema=schema)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _similar(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist()):
            keep.append(similar(unpacked(a), unpacked(b)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
            pa.array(keep, pa.bool_()))


class GramField(Field):
    """Exact: similar sets share one of their first elements, as many as the sets may differ in
    and one more, so only nodes that do are compared."""

    def __init__(self, rows):
        super().__init__(rows)
        packed = list(rows["grams"])
        grams, ends = unpacked(b"".join(packed)).tolist(), np.cumsum([len(g) // GRAM_BYTES for g in packed]).tolist()
        self.sets = [grams[a:b] for a, b in zip([0, *ends], ends)]
        self.whole = [frozenset(s) for s in self.sets]
        self.opening: dict[int, list[int]] = {}
        if len(self.sets) > FEW:
            for i in range(len(self.sets)):
                for g in self.first(i):
                    self.opening.setdefault(g, []).append(i)

    def first(self, i):
        own = self.sets[i]
        return own[:len(own) - -(-PERCENT * len(own) // 100) + 1]

    def likely(self, i, js):
        if not self.opening:
            return js
        met = {j for g in self.first(i) for j in self.opening[g] if j > i}
        return np.array(sorted(met.intersection(js.tolist())), dtype=np.int64) if met else js[:0]

    def linked(self, i, j):
        a, b = self.whole[i], self.whole[j]
        common = len(a & b)
        return 100 * common >= PERCENT * (len(a) + len(b) - common)


def clusters(docs: DataFrame) -> DataFrame:
    """Stored (doc, place, words, line, digest, cluster, keep) of the paragraphs whose cluster lies in
    several documents; keep: the first of these. A row for each time that a paragraph was read."""
    bounded_batches(docs.sparkSession)
    return settled(lambda: _clusters(docs), "clusters")


def _clusters(docs: DataFrame) -> DataFrame:
    hits = meeting_paragraphs(docs)
    shared = centred(hits.where("key IS NOT NULL").select("key", F.col("digest").alias("node"), "held"))
    places = hits.where("key IS NULL").drop("key", "held")
    # of each node, one place: any has its shingles
    nodes = shared.groupBy(F.col("node").alias("_n")).agg(F.max(F.col("key") % 2 != 0).alias("line_met"),
                                                          F.max(F.col("key") % 2 == 0).alias("window_met"))
    first = places.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("doc", "place", "words")])
    wanted = first.join(nodes.select("_n").hint("merge"), F.col("digest") == F.col("_n")).groupBy(F.col("doc").alias("_d")) \
        .agg(F.collect_list(F.struct("place", "words", "digest")).alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = wanted.join(texts.hint("merge"), F.col("doc_id") == F.col("_d")).select("text", "wanted")

    def labelled() -> DataFrame:
        sets = saved(picked.mapInArrow(_sets, "digest long, grams binary"), "sets")
        if sets.count() > nodes.count():  # ids that repeat
            sets = saved(sets.dropDuplicates(["digest"]), "sets")

        def test(pairs: DataFrame) -> DataFrame:
            return pairs.join(sets.select(F.col("digest").alias("a"), F.col("grams").alias("grams_a")).hint("merge"), "a") \
                .join(sets.select(F.col("digest").alias("b"), F.col("grams").alias("grams_b")).hint("merge"), "b") \
                .mapInArrow(_similar, "a long, b long").distinct()

        return resolve_keys(shared, test, sets.withColumnRenamed("digest", "node"), GramField)

    label = settled(labelled, "label").withColumnRenamed("node", "_c")
    # lines and windows take part if their like occurs again or meets another
    held = places.groupBy("digest").agg(*[f(F.when(F.col("line") == kind, F.col("doc"))).alias(f"{name}_{is_a}")
                                          for is_a, kind in (("line", True), ("window", False))
                                          for f, name in ((F.min, "lo"), (F.max, "hi"), (F.count, "n"))])

    def takes(kind):
        return (F.col(f"n_{kind}") > 1) | F.coalesce(f"{kind}_met", F.lit(False))

    def over(of, name):
        return of(*[F.when(takes(kind), F.col(f"{name}_{kind}")) for kind in ("line", "window")])

    held = held.join(nodes.hint("merge"), F.col("digest") == F.col("_n"), "left") \
        .join(label.hint("merge"), F.col("digest") == F.col("_c"), "left") \
        .withColumns({"lines": takes("line"), "windows": takes("window"), "lo": over(F.least, "lo"),
                      "hi": over(F.greatest, "hi")}).where("lo IS NOT NULL AND (component IS NOT NULL OR lo <> hi)") \
        .select("digest", F.coalesce("component", "digest").alias("cluster"), "lines", "windows", "lo", "hi")
    held = saved(held, "held")
    repeat = held.groupBy("cluster").agg(F.min("lo").alias("keep"), F.max("hi").alias("_last")).where("keep <> _last") \
        .select(F.col("cluster").alias("_c"), "keep")
    kept = held.join(repeat.hint("merge"), F.col("cluster") == F.col("_c")) \
        .select(F.col("digest").alias("_g"), "cluster", "keep", "lines", "windows")
    # nothing that needs a digest's rows together may follow: the places of a frequent one are many
    return places.join(kept.hint("merge"), F.col("digest") == F.col("_g")) \
        .where(F.when(F.col("line"), F.col("lines")).otherwise(F.col("windows"))) \
        .select("doc", "place", "words", "line", "digest", "cluster", "keep")


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def spans_of(found) -> list[dict]:
    """Word spans (end exclusive) that these spans cover."""
    out: list[dict] = []
    for start, end in sorted(set(found)):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


@F.arrow_udf(SPANS)
def _spans(found: pa.Array) -> pa.Array:
    return pa.array([spans_of((s["start"], s["end"]) for s in f) for f in found.to_pylist()], pa.list_(SPAN))


def _places(grams: np.ndarray, units: tuple) -> list[tuple]:
    """(cluster, place, words, line) of the paragraphs (``units``: arrays of cluster, place, words, line, digest)
    that this text really holds; an id may have several texts."""
    cluster, at, words, line, digests = units
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams), dtype=np.uint64)])
    end = at + words - SHINGLE + 1
    own = mix(sums[np.minimum(end, len(grams))] - sums[np.minimum(at, len(grams))]).astype(np.int64)  # as ``digest``
    held = (end <= len(grams)) & (own == digests)
    return list(zip(*(x[held].tolist() for x in (cluster, at, words, line))))


class Agreement:
    """Where the words of two texts agree, place by place, under a shift of one against the other."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.breaks, self.last = a, b, {}, {}

    def run(self, i: int, j: int) -> tuple[int, int]:
        """How many words before and from (i, j) on agree without a break."""
        shift = i - j
        if shift in self.last:
            low, end = self.last[shift]
            if low <= i < end:
                return i - low, end - i
        first, last = max(0, shift), min(len(self.a), len(self.b) + shift)
        if shift not in self.breaks:
            self.breaks[shift] = first + np.flatnonzero(self.a[first:last] != self.b[first - shift:last - shift])
        cut = self.breaks[shift]
        at = bisect_left(cut, i)
        low, end = int(cut[at - 1]) + 1 if at else first, int(cut[at]) if at < len(cut) else last
        self.last[shift] = low, end
        return i - low, end - i


def _firsts(grams: list) -> dict:
    """Where each shingle is first."""
    return dict(zip(reversed(grams), range(len(grams) - 1, -1, -1)))


def extended(a: tuple, b: tuple) -> tuple[set, set]:
    """Spans (start, end) in two texts, each (words, shingles, places), of the paragraphs of the same
    cluster, extended to both sides while the words agree."""
    own: dict[int, list] = {}
    for cluster, *place in b[2]:
        own.setdefault(cluster, []).append(place)
    agreement, here, there = Agreement(a[0], b[0]), set(), set()
    grams_a, grams_b = a[1].tolist(), b[1].tolist()
    first: dict[tuple, dict] = {}  # of a place in b: where each shingle is first
    last: dict[int, tuple] = {}  # of each shift, the stretch without a break that was added last
    for cluster, p, n, line_a in sorted(a[2], key=lambda unit: unit[1]):
        met, x, first_x = line_a, None, None
        for q, m, line_b in own.get(cluster, ()):
            low, end = last.get(p - q, (0, 0))
            if n == m and low <= p and p + n <= end:  # all its words agree and lie in what was added
                met = True
                continue
            if x is None:
                x = grams_a[p:p + n - SHINGLE + 1]
            equal = n == m and x == grams_b[q:q + m - SHINGLE + 1]
            if equal:
                head, tail = (0, 0), (n - SHINGLE, n - SHINGLE)
            else:
                if first_x is None:
                    first_x = _firsts(x)
                if (q, m) not in first:
                    first[q, m] = _firsts(grams_b[q:q + m - SHINGLE + 1])
                first_y = first[q, m]
                common = [(i, first_y[g]) for g, i in first_x.items() if g in first_y]
                if not common:  # tied by others of the cluster only
                    continue
                head, tail = min(common), max(common)
            met = True
            before = agreement.run(p + head[0], q + head[1])[0]
            beyond = agreement.run(p + tail[0], q + tail[1])[1]
            low, end = p + head[0] - before, p + tail[0] + beyond
            here.add((low, end))
            if equal:
                last[p - q] = low, end
            if head[1] - before < tail[1] + beyond:
                there.add((q + head[1] - before, q + tail[1] + beyond))
        if not met:
            here.add((p, p + n))
    return here, there


SPANS_OUT = pa.schema([("doc", pa.int64()), ("keep", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
SPANS_DDL = "doc long, keep long, start int, end int"


def _extended(batches):
    """Of rows in the order (keep, deal, first document before others), the extended spans of both sides."""
    state, texts, kept = None, [], set()

    def out(rows):
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, SPANS_OUT)],
                                          schema=SPANS_OUT)

    for batch in batches:
        found, units = [], batch.column("units")
        at, units = units.offsets.to_numpy(), units.values
        units = [units.field(c).to_numpy(zero_copy_only=False) for c in ("cluster", "place", "words", "line", "digest")]
        for keep, deal, doc, low, high, (words, grams) in zip(*(batch.column(c).to_pylist() for c in ("keep", "deal", "doc")),
                                                              at[:-1].tolist(), at[1:].tolist(),
                                                              texts_shingles(batch.column("text"), SHINGLE)):
            if (keep, deal) != state:
                found += [(state[0], state[0], s["start"], s["end"]) for s in spans_of(kept)] if kept else []
                state, texts, kept = (keep, deal), [], set()
            side = (words, grams, _places(grams, tuple(c[low:high] for c in units)))
            if doc == keep:
                texts.append(side)
                continue
            spans = set()
            for text in texts:
                here, there = extended(side, text)
                spans |= here
                kept |= there
            found += [(doc, keep, s["start"], s["end"]) for s in spans_of(spans)]
        if found:
            yield out(found)
    if kept:
        yield out([(state[0], state[0], s["start"], s["end"]) for s in spans_of(kept)])


def extended_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc, keep, start, end): repeated passages in ``found`` (doc, place, words, line, digest,
    cluster, keep) to their ends, in each document and (keep = doc) in the first one. A first document of many is
    dealt to several tasks, ``KEEP_ROWS`` of its documents each on average."""
    units = saved(found.groupBy("doc", "keep").agg(F.collect_set(F.struct("cluster", "place", "words", "line",
                                                                                      "digest"))
                                                   .alias("units")), "units")
    deals = units.where("doc <> keep").groupBy("keep").agg(F.ceil(F.count(F.lit(1)) / KEEP_ROWS).cast("int").alias("deals")) \
        .withColumnRenamed("keep", "_k")
    dealt = units.join(deals.hint("merge"), F.col("keep") == F.col("_k")).drop("_k")
    deal = F.when(F.col("doc") == F.col("keep"), F.sequence(F.lit(0), F.col("deals") - 1)) \
        .otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("deals")).cast("int")))
    texts = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text"))
    rows = dealt.join(texts.hint("merge"), F.col("doc") == F.col("_d")).drop("_d") \
        .select("keep", F.explode(deal).alias("deal"), "doc", "units", "text") \
        .repartition("keep", "deal").sortWithinPartitions("keep", "deal", F.col("doc") != F.col("keep"))
    return rows.mapInArrow(_extended, SPANS_DDL)


def repeats(docs: DataFrame) -> DataFrame:
    """One row for each document with a passage that another document repeats: doc_id,
    n_paragraphs, repeated and removed (word spans), repeated_words, removed_words, keep_ids (the
    documents that keep what is removed here)."""
    found = clusters(docs)
    whole = extended_spans(docs, found).select("doc", F.struct("start", "end").alias("span"), "keep",
                                               F.lit(False).alias("own"), F.lit(True).alias("used"))
    span = F.struct(F.col("place").alias("start"), (F.col("place") + F.col("words")).alias("end"))
    found = found.select("doc", span.alias("span"), "keep", F.lit(True).alias("own"), F.col("line").alias("used")) \
        .unionByName(whole)
    gone = F.col("keep") != F.col("doc")
    per = found.groupBy("doc").agg(
        F.size(F.collect_set(F.when(F.col("own"), F.col("span")))).cast("long").alias("n_paragraphs"),
        F.collect_set(F.when(F.col("used"), F.col("span"))).alias("_all"),
        F.collect_set(F.when(F.col("used") & gone, F.col("span"))).alias("_gone"),
        F.array_sort(F.collect_set(F.when(gone, F.col("keep")))).alias("keep_ids"))
    spans = per.withColumn("repeated", _spans("_all")).withColumn("removed", _spans("_gone"))

    def words(col):
        return F.aggregate(col, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])

    return spans.select(F.col("doc").alias("doc_id"), "n_paragraphs", "repeated", "removed",
                        words("repeated").alias("repeated_words"), words("removed").alias("removed_words"), "keep_ids")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list) -> str:
    """A text without the words of the spans and the white space between them."""
    if not spans:
        return text
    ends = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at:ends[s["start"]][0]])
        at = ends[s["end"] - 1][1]
    return "".join(out) + text[at:]


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([t if s is None or t is None else cut_words(t, s)
                     for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns; removed passages are cut out of ``text``."""
    found = saved(repeats(docs).where(F.size("removed") > 0).select(
        F.col("doc_id").alias("_llm_id"), F.col("removed").alias("_llm_spans")), "repeats")
    found = small_side(found, found.count(), BROADCAST_ROWS)
    return docs.join(found, F.col("doc_id").cast("long") == F.col("_llm_id"), "left") \
        .withColumn("text", _cut("text", "_llm_spans")).select(*docs.columns)
