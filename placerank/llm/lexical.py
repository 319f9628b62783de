"""Ranked lexical search by scoring bags once.

For a set of items (queries) every document is ranked by

    sum over the item's terms of  w(term) * ((10^9 tf) div (1000 tf + 8 m)),
    w = floor(1000 ln((2 N + 2) / (2 df + 1))),   m = 10 + (90 n N) div L

in whole numbers. A document's scores depend only on its term frequencies within the items'
vocabulary and on ``m``. So documents are cut down to that vocabulary; those with the same vector and
the same m are a class, found by a hash of both and verified by comparing the bytes. A class is
scored once for all items; its members follow by ascending doc_id. Of a class only the first ``k``
members can be among an item's ``k`` best, which the window takes before it shuffles, and of a task's
classes only the ``k`` best of each item: what is left out has ``k`` documents in front of it.

Items are searched in blocks of about ``BLOCK_PAIRS`` (item, term) pairs and ``BLOCK_ITEMS`` items,
dealt by a hash of the item's id. The terms of one block are what goes to the tasks, so this is bounded whatever the number
of items; each block reads the documents anew.

Defined cases: a document without terms, or a null text, is not counted and not found; an item without
terms, or in whose terms no document scores above 0, gives no rows; rows with the same item id are
one item with the terms of all; repeated documents count each and are listed each; null ids come
last among equal scores; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved

BEST = 10
BLOCK_PAIRS, BLOCK_ITEMS = 200_000, 1_000
CLASSES_AT_ONCE = 2048
LAST = np.iinfo(np.int64).max
#: ASCII letters and digits and everything beyond ASCII belong to terms; A-Z counts as a-z.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text with repeats, in order."""
    return text.encode().translate(_FOLD).split() if text else []


def _item_terms(batches):
    for b in batches:
        ids, terms = [], []
        for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
            own = sorted(set(terms_of(text)))
            ids += [i] * len(own)
            terms += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("item_id").type), pa.array(terms, pa.binary())],
                                         names=["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of all items, terms as UTF-8 bytes."""
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string").alias("text")) \
        .mapInArrow(_item_terms, f"item_id {kind}, term binary").distinct()


def _bags(vocabulary: dict[bytes, int]):
    def bags(batches):
        for b in batches:
            sizes, vectors = [], []
            for text in b.column("text"):
                words = terms_of(text.as_py())
                known = [v for v in map(vocabulary.get, words) if v is not None]
                term, tf = np.unique(np.array(known, np.uint32), return_counts=True)
                sizes.append(len(words))
                vectors.append(np.stack([term, tf.astype(np.uint32)]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary())],
                                             names=["doc_id", "n", "vector"])
    return bags


def _terms_of_vectors(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of all vectors."""
    flat = [np.frombuffer(v, np.uint32).reshape(2, -1) for v in data]
    row = np.repeat(np.arange(len(flat)), [f.shape[1] for f in flat])
    both = np.concatenate(flat, axis=1) if flat else np.zeros((2, 0), np.uint32)
    return row, both[0].astype(np.int64), both[1].astype(np.int64)


def _holders(batches):
    """Documents of this task that hold each term."""
    total = np.zeros(0, np.int64)
    for b in batches:
        own = np.bincount(_terms_of_vectors(b.column("vector").to_pylist())[1])
        if len(own) > len(total):
            own[:len(total)] += total
            total = own
        else:
            total[:len(own)] += own
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": at, "df": total[at]})


def classes_of(bags: DataFrame, documents: int, terms: int, k: int) -> DataFrame:
    """The first ``k`` members of each class, saved: bag (a hash), variant (told apart by the bytes
    where hashes agree), doc_id, place; the first one carries vector and m."""
    every = bags.where(F.length("vector") > 0) \
        .withColumn("m", F.expr(f"10 + (90 * n * {documents}L) div {max(terms, 1)}L")) \
        .withColumn("bag", F.xxhash64("vector", "m"))
    members = every.withColumn("place", F.row_number().over(Window.partitionBy("bag", "vector", "m").orderBy(F.col("doc_id").asc_nulls_last()))) \
        .where(F.col("place") <= k)
    told = members.withColumn("variant", F.dense_rank().over(Window.partitionBy("bag").orderBy("vector", "m")))
    first = F.col("place") == 1
    return saved(told.select("bag", "variant", F.col("doc_id"), "place", F.when(first, F.col("vector")).alias("vector"),
                             F.when(first, F.col("m")).alias("m")), "lexical-classes")


class Index:
    """The items of a block by term: ``items[starts[t]:starts[t + 1]]`` are those that hold term t."""

    def __init__(self, pairs: list[tuple[int, int]], n_terms: int, n_items: int):
        item, term = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(term, kind="stable")
        self.items = item[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.n_items = n_items

    def scores(self, vectors: list[bytes], m: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole-number scores, a row for each vector and a column for each item."""
        out = np.zeros((len(vectors), self.n_items), np.int64)
        row, term, tf = _terms_of_vectors(vectors)
        part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        order = np.argsort(term, kind="stable")
        row, term, part = row[order], term[order], part[order]
        cut = np.flatnonzero(np.diff(term, prepend=-1))
        for a, e in zip(cut, np.append(cut[1:], len(term))):
            t = term[a]
            out[np.ix_(row[a:e], self.items[self.starts[t]:self.starts[t + 1]])] += part[a:e, None]
        return out


CANDIDATES = pa.schema([("item", pa.int32()), ("score", pa.int64()), ("bag", pa.int64()), ("variant", pa.int32()), ("first_id", pa.int64())])


def _search(index: Index, weight: np.ndarray, k: int):
    def search(batches):
        best = np.zeros((index.n_items, 0, 4), np.int64)     # score, first id, bag, variant
        for b in batches:
            for a in range(0, b.num_rows, CLASSES_AT_ONCE):
                own = b.slice(a, CLASSES_AT_ONCE)
                scores = index.scores(own.column("vector").to_pylist(), own.column("m").to_numpy(), weight)
                ids = own.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)
                bag, variant = own.column("bag").to_numpy(), own.column("variant").to_numpy()
                by_id = np.argsort(ids, kind="stable")
                found = []
                for i in range(index.n_items):
                    mine = scores[by_id, i]
                    top = by_id[np.argsort(-mine, kind="stable")[:k]] if (mine > 0).any() else by_id[:0]
                    all_rows = np.concatenate([best[i], np.stack([scores[top, i], ids[top], bag[top], variant[top]], axis=1)])
                    all_rows = all_rows[np.lexsort((all_rows[:, 1], -all_rows[:, 0]))[:k]]
                    found.append(np.concatenate([all_rows, np.zeros((k - len(all_rows), 4), np.int64)]))
                best = np.stack(found) if found else best
        item, place = np.nonzero(best[:, :, 0] > 0)
        rows = best[item, place]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((item, rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 1]), CANDIDATES)],
                                         schema=CANDIDATES)
    return search


def _block(docs: DataFrame, pairs: list, k: int) -> DataFrame | None:
    """Best documents of the items in ``pairs``, all (item_id, term) of one block."""
    spark = docs.sparkSession
    names = sorted({r["item_id"] for r in pairs}, key=lambda x: (x is None, x))
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in pairs}))}
    number = {x: i for i, x in enumerate(names)}
    index = Index([(number[r["item_id"]], vocabulary[bytes(r["term"])]) for r in pairs], len(vocabulary), len(names))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bags = saved(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                 .mapInArrow(_bags(vocabulary), f"doc_id {id_type}, n long, vector binary"), "lexical-bags")
    size = bags.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holders = bags.select("vector").mapInArrow(_holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = np.zeros(len(vocabulary), np.int64)
    for r in holders:                                        # a row for each term of the block
        weight[r["term"]] = math.floor(1000 * math.log((2 * size["documents"] + 2) / (2 * r["df"] + 1)))
    members = classes_of(bags, size["documents"], size["terms"], k)
    found = members.where("place = 1").select("doc_id", "bag", "variant", "vector", "m") \
        .mapInArrow(_search(index, weight, k), "item int, score long, bag long, variant int, first_id long")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "first_id"))).where(F.col("place") <= k)
    listed = best.select("item", "score", "bag", "variant").join(members.select("bag", "variant", "doc_id"), ["bag", "variant"])
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))) \
        .where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item int, item_id {pairs[0]['item_type']}")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank from 1, doc_id, score."""
    bounded_batches(docs.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pairs = saved(item_terms(items).withColumn("item_type", F.lit(kind)), "lexical-items")
    size = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.xxhash64("item_id")).alias("items")).first()
    blocks = math.ceil(max(size["pairs"] / BLOCK_PAIRS, size["items"] / BLOCK_ITEMS))
    out = None
    for i in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()  # one block, bounded above
        if own:
            part = _block(docs, own, k)
            out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {id_type}, score long") if out is None else out
