"""Language-model scoring by deleted interpolation of n-gram estimates.

The probability of a token is a mixture of the maximum-likelihood estimates of all orders up to
``order`` and of the uniform distribution over the vocabulary and one unknown word:

    P(w | u) = l2(b) c(u w) / c(u) + l1(b) c(w) / N + l0(b) / (V + 1)      (order 2)

where ``b`` is the bucket of the context's frequency, floor(log2 c(u)) + 1, or 0 for a context that
was not seen. The weights are learned by expectation-maximisation: one part of the training
documents is deleted from the counts and serves as held-out text for the counts of the others.
Scoring then uses the counts of the whole training set.

Work is dealt by blocks. A block is some 8 MB of text of documents of one part; it is kept as
numbers into its own vocabulary. Of every order a block sends each different n-gram once, as sorted
64-bit hashes cut into ranges, so a frequent n-gram is one entry a block and no key holds more than
that. A range is summed in one group, whose size the number of ranges bounds, and the sums go back
in the order in which the hashes came, without the hashes. All n-grams are counted, whatever their
number. Two different n-grams agree with probability 2^-64.

Defined cases: a null or empty text is one end token; documents without an id are learned from;
repeated rows count and are scored row by row; without training tokens the only estimate is the
uniform one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved
from .shingles import _slices, _views, mix, word_hashes

ORDER = 2
BLOCK_BYTES = 8 << 20        # text of a block; a longer document is a block of its own
RANGE_ENTRIES = 1 << 19      # hashes that meet in one group, about
TEST, DELETED, KEPT = 0, 1, 2
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
ROUNDS, STILL = 25, 1e-3     # expectation-maximisation: most rounds; change of a weight at which it ends
PRIOR = 5.0                  # tokens' worth of the weights of all buckets that each bucket starts with
LEAST = 1e-9                 # least weight of an estimate that can be had
ADDED = 0.1                  # of the base score


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes of the smallest width that holds them."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{width}").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def runs_of(ordered: np.ndarray) -> np.ndarray:
    """Start of every run of equal values."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text mod 10; null without an id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10


def part_of(doc_id: str = "doc_id") -> Column:
    """TEST documents are never learned from, DELETED ones are held out while weights are learned."""
    return F.coalesce(F.when(remainder(doc_id) == 0, TEST).when(remainder(doc_id) == 1, DELETED), F.lit(KEPT))


def _token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts, each with its end token; tokens before each text and after the last)."""
    raw, offsets = _views(texts)
    words, counts = [], []
    for a, b in _slices(offsets):
        own = offsets[a:b + 1]
        w, at = word_hashes(raw[own[0]:own[-1]], own - own[0])
        words.append(w)
        counts.append(np.diff(at))
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    tokens = np.full(starts[-1], END, np.uint64)
    plain = np.ones(len(tokens), bool)
    plain[starts[1:] - 1] = False
    tokens[plain] = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return tokens, starts


def _block_row(block: int, part: int, ids: list, texts: list) -> dict:
    tokens, starts = _token_hashes(pa.concat_arrays(texts))
    order = np.argsort(tokens)
    ordered = tokens[order]
    first = runs_of(ordered)
    places = np.empty(len(tokens), np.uint64)
    places[order] = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(tokens))))
    return {"block": block, "part": part, "n_docs": len(starts) - 1, "n_tokens": int(starts[-1]),
            "doc_ids": pa.concat_arrays(ids), "sizes": pack(np.diff(starts).astype(np.uint64)),
            "vocabulary": pack_sorted(ordered[first]), "tokens": pack(places)}


def _block_batch(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    ids = pa.ListArray.from_arrays(pa.array([0, len(row["doc_ids"])], pa.int32()), row["doc_ids"])
    return pa.RecordBatch.from_arrays([ids if f.name == "doc_ids" else pa.array([row[f.name]], f.type) for f in schema], schema=schema)


def _make_blocks(id_type: pa.DataType):
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                        ("doc_ids", pa.list_(id_type)), ("sizes", pa.binary()), ("vocabulary", pa.binary()),
                        ("tokens", pa.binary())])

    def make(batches):
        number = TaskContext.get().partitionId() << 32
        held = {p: ([], [], 0) for p in (TEST, DELETED, KEPT)}
        for b in batches:
            parts = b.column("part").to_numpy(zero_copy_only=False)
            for part in held:
                at = np.flatnonzero(parts == part)
                if not len(at):
                    continue
                own = b.take(pa.array(at))
                ids, texts = own.column("doc_id"), own.column("text")
                ends = np.cumsum(np.array([0] + [t or 0 for t in own.column("n_bytes").to_pylist()]))
                a = 0
                while a < len(at):
                    kept_ids, kept_texts, size = held[part]
                    # as many as fit, at least one into an empty block
                    to = int(np.searchsorted(ends, ends[a] + BLOCK_BYTES - size, "right")) - 1
                    to = max(to, a if kept_ids else a + 1)
                    if to > a:
                        kept_ids.append(ids.slice(a, to - a))
                        kept_texts.append(texts.slice(a, to - a))
                        size += int(ends[to] - ends[a])
                    held[part] = (kept_ids, kept_texts, size)
                    if to < len(at) or size >= BLOCK_BYTES:
                        yield _block_batch(_block_row(number, part, kept_ids, kept_texts), schema)
                        number += 1
                        held[part] = ([], [], 0)
                    a = to
        for part, (ids, texts, _) in held.items():
            if ids:
                yield _block_batch(_block_row(number, part, ids, texts), schema)
                number += 1
    return make


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents as saved blocks of numbered tokens."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    probe = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    return saved(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.octet_length("text").alias("n_bytes"), part_of().alias("part"))
                 .mapInArrow(_make_blocks(probe), "block long, part int, n_docs long, n_tokens long, "
                             f"doc_ids array<{id_type.simpleString()}>, sizes binary, vocabulary binary, tokens binary"), "ngram-blocks")


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])


def grams(words: np.ndarray, starts: np.ndarray, order: int):
    """Hashes of the n-grams that end at each token, order by order; before a document's first
    token there are start marks."""
    here = words
    yield here
    for k in range(2, order + 1):
        before = np.empty_like(here)
        before[1:] = here[:-1]
        before[starts[:-1]] = START
        here = mix(mix(before + np.uint64(k)) + words)
        yield here


def _send(order: int, bits: int):
    schema = pa.schema([("order", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("part", pa.int32()),
                        ("hashes", pa.binary()), ("times", pa.binary())])

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                words = unpack_sorted(row["vocabulary"])[unpack(row["tokens"]).astype(np.int64)]
                for k, own in enumerate(grams(words, _starts(unpack(row["sizes"])), order), 1):
                    own = np.sort(own)
                    first = runs_of(own)
                    times = np.diff(np.append(first, len(own))).astype(np.uint64)
                    own = own[first]
                    top = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
                    cut = runs_of(top)
                    out = {c: [] for c in schema.names}
                    for a, to in zip(cut, np.append(cut[1:], len(own))):
                        for c, v in (("order", k), ("range", int(top[a])), ("block", row["block"]), ("part", row["part"]),
                                     ("hashes", pack_sorted(own[a:to])), ("times", pack(times[a:to]))):
                            out[c].append(v)
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
    return send


RETURNED = pa.schema([("block", pa.int64()), ("order", pa.int32()), ("range", pa.int64()), ("seen", pa.binary()),
                      ("deleted", pa.binary()), ("different", pa.int64())])


def _sum_range(table: pa.Table) -> pa.Table:
    """Training occurrences of every n-gram of a range, and those in the deleted part, sent back to
    each block in the order of its own hashes."""
    rows = table.select(["block", "part", "hashes", "times"]).to_pylist()
    hashes = [unpack_sorted(r["hashes"]) for r in rows]
    at = _starts(np.array([len(h) for h in hashes]))
    every = np.concatenate(hashes)
    times = np.concatenate([unpack(r["times"]) for r in rows]).astype(np.int64)
    part = np.repeat(np.array([r["part"] for r in rows]), np.diff(at))
    order = np.argsort(every)
    first = runs_of(every[order])
    seen = np.add.reduceat(np.where(part != TEST, times, 0)[order], first)
    gone = np.add.reduceat(np.where(part == DELETED, times, 0)[order], first)
    group = np.empty(len(every), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(every))))
    out = {c: [] for c in RETURNED.names}
    for i, r in enumerate(rows):
        own = group[at[i]:at[i + 1]]
        for c, v in (("block", r["block"]), ("order", table["order"][0].as_py()), ("range", table["range"][0].as_py()),
                     ("seen", pack(seen[own])), ("deleted", pack(gone[own]) if r["part"] == DELETED else None),
                     ("different", int((seen > 0).sum()) if i == 0 else 0)):
            out[c].append(v)
    return pa.Table.from_pydict(out, schema=RETURNED)


def counted(blocks: DataFrame, order: int, n_tokens: int) -> DataFrame:
    """Counts of all n-grams of all blocks, a saved row for each block, order and range of hashes."""
    bits = max(0, math.ceil(math.log2(max(1, n_tokens * order / RANGE_ENTRIES))))
    return saved(blocks.select("block", "part", "sizes", "vocabulary", "tokens")
                 .mapInArrow(_send(order, bits), "order int, range long, block long, part int, hashes binary, times binary")
                 .groupBy("order", "range").applyInArrow(_sum_range, "block long, order int, range long, seen binary, "
                                                         "deleted binary, different long"), "ngram-counts")


def level(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for none, else floor(log2) + 1."""
    return np.where(counts > 0, np.frexp(counts.astype(np.float64))[1], 0)


class Block:
    """A block with the counts of its n-grams, token by token."""

    def __init__(self, row: dict, counts: list[dict], order: int, totals: dict, without_deleted: bool):
        self.starts = _starts(unpack(row["sizes"]))
        words = unpack_sorted(row["vocabulary"])[unpack(row["tokens"]).astype(np.int64)]
        docs = totals["docs"] - (totals["deleted_docs"] if without_deleted else 0)
        total = totals["tokens"] - (totals["deleted_tokens"] if without_deleted else 0)
        by_order: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["order"], r["range"])):
            own = unpack(r["seen"]).astype(np.int64)
            by_order.setdefault(r["order"], []).append(own - unpack(r["deleted"]).astype(np.int64) if without_deleted else own)
        self.seen, self.estimates, self.bucket = None, [], np.zeros(len(words), np.int64)
        before = None
        for k, own in enumerate(grams(words, self.starts, order), 1):
            sorting = np.argsort(own)
            first = runs_of(own[sorting])
            here = np.empty(len(own), np.int64)
            here[sorting] = np.repeat(np.concatenate(by_order[k]), np.diff(np.append(first, len(own))))
            if k == 1:
                self.seen, context = here, np.full(len(own), total, np.int64)
            else:
                context = np.empty_like(here)
                context[1:] = before[:-1]
                context[self.starts[:-1]] = docs
                self.bucket = self.bucket * 64 + level(context)
            self.estimates.append(np.divide(here, context, out=np.zeros(len(own)), where=context > 0))
            before = here


def _evidence(order: int, totals: dict):
    names = ["bucket", *[f"p{k}" for k in range(1, order + 1)], "n"]
    schema = pa.schema([(names[0], pa.int64()), *[(c, pa.float64()) for c in names[1:-1]], ("n", pa.int64())])

    def evidence(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        got = [Block(r, counts.to_pylist(), order, totals, True) for r in blocks.to_pylist()]
        out = [[] for _ in names]
        for b in got:
            columns = [b.bucket, *b.estimates]
            sorting = np.lexsort(columns)
            columns = [c[sorting] for c in columns]
            new = np.ones(len(sorting), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            first = np.flatnonzero(new)
            for o, c in zip(out, [*[c[first] for c in columns], np.diff(np.append(first, len(sorting)))]):
                o.append(c)
        return pa.Table.from_arrays([pa.array(np.concatenate(o) if o else [], f.type) for o, f in zip(out, schema)], schema=schema)
    return evidence, "bucket long, " + ", ".join(f"p{k} double" for k in range(1, order + 1)) + ", n long"


def available(bucket: int, order: int, tokens: int) -> np.ndarray:
    """Estimates that exist in a bucket: the uniform one, order 1 if anything was learned, and each
    higher order whose context was seen."""
    levels = [(bucket >> (6 * (order - k))) & 63 for k in range(2, order + 1)]
    return np.array([True, tokens > 0, *[x > 0 for x in levels]])


def weights_of(share: np.ndarray, can: np.ndarray) -> np.ndarray:
    w = np.where(can, np.maximum(share, LEAST), 0.0)
    return w / w.sum()


def learn(evidence: DataFrame, order: int, totals: dict) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Weights of each bucket and of all buckets together, by expectation-maximisation over the
    deleted part. A bucket is one level a context: their number does not depend on the data's size."""
    spark, uniform = evidence.sparkSession, 1.0 / (totals["vocabulary"] + 1)
    kept = totals["tokens"] - totals["deleted_tokens"]
    seen = {r["bucket"]: r["n"] for r in evidence.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    overall = np.full(order + 1, 1.0 / (order + 1))
    weights = {b: weights_of(overall, available(b, order, kept)) for b in seen}
    columns = [F.lit(uniform), *[F.col(f"p{k}") for k in range(1, order + 1)]]
    for _ in range(ROUNDS if seen else 0):
        table = spark.createDataFrame([(b, *map(float, w)) for b, w in weights.items()],
                                      "bucket long, " + ", ".join(f"w{k} double" for k in range(order + 1)))
        parts = [F.col(f"w{k}") * c for k, c in enumerate(columns)]
        whole = sum(parts[1:], parts[0])
        rows = evidence.join(F.broadcast(table), "bucket").groupBy("bucket") \
            .agg(*[F.sum(F.col("n") * p / whole).alias(f"s{k}") for k, p in enumerate(parts)]).collect()
        sums = {r["bucket"]: np.array([r[f"s{k}"] for k in range(order + 1)]) for r in rows}
        overall = sum(sums.values()) / sum(seen.values())
        new = {b: weights_of((s + PRIOR * overall) / (s.sum() + PRIOR), available(b, order, kept)) for b, s in sums.items()}
        still = max(np.abs(new[b] - weights[b]).max() for b in new) < STILL
        weights = new
        if still:
            break
    return weights, overall


def _scored(order: int, totals: dict, weights: dict[int, np.ndarray], overall: np.ndarray, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("part", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])
    n, v = totals["tokens"], totals["vocabulary"]

    def scored(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        ids_of = blocks.column("doc_ids")
        for i, row in enumerate(blocks.drop_columns(["doc_ids"]).to_pylist()):
            b = Block(row, counts.to_pylist(), order, totals, False)
            buckets, at = np.unique(b.bucket, return_inverse=True)
            w = np.array([weights_of(weights.get(int(x), overall), available(int(x), order, n)) for x in buckets])[at]
            p = w[:, 0] / (v + 1)
            for k, e in enumerate(b.estimates, 1):
                p += w[:, k] * e
            first = b.starts[:-1]
            out.append(pa.Table.from_arrays([
                ids_of[i].values.cast(id_type), pa.array(np.full(len(first), row["part"], np.int32)),
                pa.array(np.diff(b.starts)), pa.array(np.add.reduceat((b.seen > 0).astype(np.int64), first)),
                pa.array(np.add.reduceat(np.log10((b.seen + ADDED) / (n + ADDED * (v + 1))), first)),
                pa.array(np.add.reduceat(np.log10(p), first))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()
    return scored


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    id_arrow = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    blocks = blocks_of(docs)
    parts = {r["part"]: r for r in blocks.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).collect()}
    total = {p: (parts[p]["d"], parts[p]["t"]) if p in parts else (0, 0) for p in (TEST, DELETED, KEPT)}
    counts = counted(blocks, order, sum(t for _, t in total.values()))
    totals = {"docs": total[KEPT][0] + total[DELETED][0], "tokens": total[KEPT][1] + total[DELETED][1],
              "deleted_docs": total[DELETED][0], "deleted_tokens": total[DELETED][1],
              "vocabulary": counts.where(F.col("order") == 1).agg(F.coalesce(F.sum("different"), F.lit(0))).first()[0]}
    by_block = counts.select("block", "order", "range", "seen", "deleted")
    tell, evidence_schema = _evidence(order, totals)
    held = blocks.where(F.col("part") == DELETED).select("block", "sizes", "vocabulary", "tokens")
    evidence = saved(held.groupBy("block").cogroup(by_block.where("deleted IS NOT NULL").groupBy("block"))
                     .applyInArrow(tell, evidence_schema), "ngram-evidence")
    weights, overall = learn(evidence, order, totals)
    return blocks.groupBy("block").cogroup(by_block.groupBy("block")) \
        .applyInArrow(_scored(order, totals, weights, overall, id_arrow),
                      f"doc_id {id_type}, part int, n_tokens long, n_known long, base_score double, score double") \
        .select("doc_id", (F.col("part") == TEST).alias("held_out"), "n_tokens", "n_known",
                F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
