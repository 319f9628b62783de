"""Near-duplicate documents by SetSketch registers.

A document is the set of its shingles of some words. Every register takes the minimum of exponentially
distributed hashes of the set's elements on a logarithmic scale, ``1 - log_b(minimum)`` truncated
to an integer in [0, q + 1]: such sketches merge by maximum, and two registers agree with a
probability close to the sets' Jaccard similarity. Runs of registers are the bands; of
documents that share a band the similarity is estimated from both sketches and set sizes by
maximum likelihood, candidates clearly below the threshold go, and the rest is confirmed on the
full sets. Confirmed links join documents to components.

Documents with the same set are one class and one node throughout, so that thousands of copies cost
one. A node's number is the class's smallest id, so that among equals the oldest document is the
centre of its copies; where an id has several texts, all its classes but one are numbered by a hash
instead. Such an id ties its classes at the end, and a component is named by its smallest id. The shingles' words and the threshold are arguments: :class:`Rule` takes the bands
from the threshold, so that a pair at it is missed by all of them with probability ``MISSED`` at most
(at 85 % 40 bands of 6 registers, 6e-9; at 80 % 48 of 5, 5e-9); the margin of the estimate is five
standard deviations.

Defined cases: a null text or one without words has an empty set and is linked with nothing; a
text of fewer words than a shingle has its sequence as its only shingle; repeated rows of an id are
one node; a row without id is linked with nothing, its component is null and it is kept; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import Field, resolve, shared_buckets
from .common import bounded_batches, give_back, saved, small_side
from .shingles import texts_shingles

SHINGLE = 3
PERCENT = 85               # linked where 100 * intersection >= PERCENT * union
REGISTERS = 240
MISSED = 1e-8              # probability that a pair at the threshold shares no band, at most
BASE, RATE, TOP = 1.001, 20.0, 65534   # b, a and q of the sketch
BROADCAST_IDS = 500_000    # ids broadcast at most to pick documents for confirmation

_RNG = np.random.Generator(np.random.PCG64(41))
_XOR = _RNG.integers(0, 2 ** 32, REGISTERS, dtype=np.uint32)
_ODD = _RNG.integers(0, 2 ** 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BLOCK = 512


class Rule:
    """Threshold with the bands and the margin (below it, for the estimate) that follow from it."""

    def __init__(self, percent: int):
        self.percent, j = percent, percent / 100
        self.rows = max(r for r in range(1, REGISTERS + 1)
                        if REGISTERS % r == 0 and (r == 1 or (1 - j ** r) ** (REGISTERS // r) <= MISSED))
        self.bands = REGISTERS // self.rows
        self.least = j - 5 * (j * (1 - j) / REGISTERS) ** 0.5


def registers(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes (uint16)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), _BLOCK):
        h = x[None, i:i + _BLOCK] ^ _XOR[:, None]
        h *= _ODD[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0 ** 32
    exponential = -np.log1p(-uniform) / RATE
    k = np.floor(1 - np.log(exponential) / np.log(BASE))
    return np.clip(k, 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 201)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches (rows) with known set sizes that makes the numbers
    of larger, smaller and equal registers likeliest."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = _GRID[None, :] * np.minimum(u / v, v / u)[:, None]
    c = (BASE - 1) / BASE

    def larger(x):
        return -np.log1p(-np.clip(x, 1e-9, 1) * c) / np.log(BASE)

    up, down = larger(u[:, None] - v[:, None] * j), larger(v[:, None] - u[:, None] * j)
    equal = np.clip(1 - up - down, 1e-9, 1)
    ll = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(equal)
    return j[np.arange(len(j)), np.argmax(ll, axis=1)]


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()),
                    ("regs", pa.binary())])


def _digest(own: np.ndarray) -> tuple[int, int]:
    d0, d1 = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
    return int(d0), int(d1)


def _sketches(batches, shingle):
    for batch in batches:
        rows = []
        for _, grams in texts_shingles(batch.column("text"), shingle):
            own = np.unique(grams)
            rows.append((len(own), *_digest(own), registers(own).tobytes() if len(own) else None))
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(list(c), type=f.type) for c, f in zip(cols, list(SKETCH)[1:])]],
            schema=SKETCH)


def _sets(batches, shingle):
    schema = pa.schema([("n", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("grams", pa.binary())])
    for batch in batches:
        sets = [np.unique(g) for _, g in texts_shingles(batch.column("text"), shingle)]
        d0, d1 = zip(*[_digest(own) for own in sets]) if sets else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array([len(own) for own in sets], pa.int64()), pa.array(d0, pa.int64()),
                                          pa.array(d1, pa.int64()), pa.array([own.tobytes() for own in sets], pa.binary())], schema=schema)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _kept(batch, keep):
    keep = pa.array(keep, pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=PAIRS).filter(keep)


def _likely(batches, rule):
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                for c in ("regs_a", "regs_b"))
        n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
        # an estimate holds a row of the grid for each pair: a few pairs at a time
        found = [estimate(a[i:i + _BLOCK], b[i:i + _BLOCK], n_a[i:i + _BLOCK], n_b[i:i + _BLOCK])
                 for i in range(0, len(a), _BLOCK)]
        yield _kept(batch, np.concatenate(found) >= rule.least)
    give_back()


def _confirmed(batches, rule):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("grams_a"), batch.column("grams_b")):
            a, b = (np.frombuffer(x.as_py(), dtype=np.uint64) for x in (a, b))
            common = intersection(a, b)
            keep.append(100 * common >= rule.percent * (len(a) + len(b) - common))
        yield _kept(batch, keep)
    give_back()


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


class SketchField(Field):
    def __init__(self, rows, rule):
        super().__init__(rows)
        self.rule = rule
        self.n = rows["n"].to_numpy(dtype=np.float64)
        self.regs = np.frombuffer(b"".join(rows["regs"]), dtype=np.uint16).reshape(-1, REGISTERS)
        self.sets = [np.frombuffer(g, dtype=np.uint64) for g in rows["grams"]]

    def likely(self, i, js):
        js = js[100 * np.minimum(self.n[js], self.n[i]) >= self.rule.percent * np.maximum(self.n[js], self.n[i])]
        # equal registers bound the estimate: only pairs with enough of them are worth a likelihood
        equal = (self.regs[js] == self.regs[i]).sum(axis=1)
        js = js[equal >= REGISTERS * self.rule.least]
        if not len(js):
            return js
        own = np.broadcast_to(self.regs[i], (len(js), REGISTERS))
        j = estimate(own, self.regs[js], np.broadcast_to(self.n[i], len(js)), self.n[js])
        order = np.argsort(-j, kind="stable")
        return js[order[j[order] >= self.rule.least]]

    def linked(self, i, j):
        common = intersection(self.sets[i], self.sets[j])
        return 100 * common >= self.rule.percent * (len(self.sets[i]) + len(self.sets[j]) - common)


def sketches(docs: DataFrame, shingle=SHINGLE) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_sketches, shingle=shingle), "doc_id long, n long, d0 long, d1 long, regs binary")


def near_duplicates(docs: DataFrame, shingle=SHINGLE, percent=PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    rule = Rule(percent)
    bounded_batches(docs.sparkSession)
    rows = saved(sketches(docs, shingle), "sketches")
    able = rows.where("n > 0 AND doc_id IS NOT NULL")
    same_id = Window.partitionBy("first_id").orderBy("n", "d0", "d1")
    other = F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("n", "d0", "d1"), 2)
    classes = able.groupBy("n", "d0", "d1").agg(F.min("doc_id").alias("first_id"))
    classes = saved(classes.withColumn("node", F.when(F.row_number().over(same_id) == 1, F.col("first_id")).otherwise(other)), "classes")
    # ids with several texts tie the classes of these
    named = able.select("doc_id", "n", "d0", "d1").join(classes, ["n", "d0", "d1"]).select("doc_id", "node")
    named = saved(named.distinct(), "named")
    ties = named.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("_m")).where("b <> _m") \
        .join(named, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")

    nodes = saved(able.join(classes.withColumnRenamed("first_id", "doc_id"), ["doc_id", "n", "d0", "d1"])
                  .select("node", "n", "regs").dropDuplicates(["node"]), "nodes")
    width = 2 * rule.rows
    bands = nodes.select("node", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(rule.bands)])).alias("key"))
    shared = shared_buckets(bands)
    wanted = saved(shared.select("node").distinct().join(classes, "node"), "wanted")
    n_wanted = wanted.count()
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(small_side(wanted.select(F.col("first_id").alias("doc_id")).distinct(), n_wanted, BROADCAST_IDS), "doc_id", "left_semi")
    found = picked.mapInArrow(partial(_sets, shingle=shingle), "n long, d0 long, d1 long, grams binary")
    sets = saved(found.join(small_side(wanted.select("n", "d0", "d1", "node"), n_wanted, BROADCAST_IDS), ["n", "d0", "d1"])
                 .select("node", "grams"), "sets")

    def test(pairs: DataFrame) -> DataFrame:
        with_n = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"),
                                         F.col("regs").alias("regs_a")), "a") \
            .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b")), "b") \
            .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        likely = saved(with_n.mapInArrow(partial(_likely, rule=rule), "a long, b long").distinct(), "likely")
        return likely.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b") \
            .join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a") \
            .mapInArrow(partial(_confirmed, rule=rule), "a long, b long").distinct()

    payload = nodes.select("node", "n", "regs").join(
        sets.select(F.col("node").alias("_n"), "grams"), F.col("node") == F.col("_n")).drop("_n")
    label = resolve(shared, test, payload, partial(SketchField, rule=rule))
    if not ties.isEmpty():
        from .components import components
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(ties))
    # a component's smallest id, from the classes, of which each holds its own smallest
    rooted = classes.join(label.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"), "left") \
        .select("node", "first_id", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy(F.col("root").alias("_r")).agg(F.min("first_id").alias("_c"))
    told = saved(rooted.join(least, F.col("root") == F.col("_r")).select(F.col("node").alias("_n"), "_c"), "told")
    where = named.join(told, F.col("node") == F.col("_n")).groupBy(F.col("doc_id").alias("_id")).agg(F.min("_c").alias("_c"))
    found = rows.select("doc_id", "n").join(where, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce(F.col("_c"), F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, shingle=SHINGLE, percent=PERCENT) -> DataFrame:
    """``docs`` with all its columns: one document of each component stays."""
    gone = saved(near_duplicates(docs, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("_llm_id")).distinct(), "repeats")
    n = gone.count()
    if not n:
        return docs
    return docs.join(small_side(gone, n, BROADCAST_IDS), F.col("doc_id").cast("long") == F.col("_llm_id"), "left_anti")
