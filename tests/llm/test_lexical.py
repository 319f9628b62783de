"""Ranked search against scores of every document and item."""

import math
import random
import re

import pytest

from placerank.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return TERM.findall((text or "").translate(low))


def brute(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    out = []
    for item in sorted({i for i, _ in items}, key=repr):
        own = {t for i, text in items if i == item for t in terms(text)}
        scores = []
        for d, t in held:
            m = 10 + (90 * len(t) * n_docs) // length
            total = 0
            for x in own & set(t):
                df = sum(x in set(u) for _, u in held)
                total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10 ** 9 * t.count(x)) // (1000 * t.count(x) + 8 * m))
            if total > 0:
                scores.append((-total, math.inf if d is None else d, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    words = ["alpha", "Beta", "g4mma", "délta", "Ωmega", "x", "y", "common"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6))) + rng.choice(["", ".", " _ "])) for i in range(90)]
    docs += [(i, "alpha common y") for i in range(200, 240)] + [(5, "alpha x"), (5, "alpha x"), (None, "alpha x Beta"), (300, None),
             (301, ""), (302, "- ! _"), (303, "ÉCOLE alpha"), (304, "common " * 3000 + "rare")]
    items = [(1, "Alpha, beta!"), (2, "rare DÉLTA"), (3, "nothing here matches"), (4, None), (5, ""), (6, "common x"), (6, "y"),
             (7, "Ωmega-g4mma"), (None, "école École")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, score int").repartition(5),
            spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, rank string"))


def test_ranks_equal_brute_force(spark, tables):
    docs, items = frames(spark, *tables)
    got = lexical.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(*tables)


def test_blocks_of_items_and_few_best(spark, tables, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(lexical, "CLASSES_AT_ONCE", 7)
    got = lexical.search(*frames(spark, *tables), k=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(*tables, k=3)


def test_classes_hold_equal_bags_only(spark, tables):
    docs, _ = frames(spark, *tables)
    vocabulary = {t: i for i, t in enumerate(sorted({x.encode() for _, t in tables[0] for x in terms(t)}))}
    bags = docs.select("doc_id", "text").mapInArrow(lexical._bags(vocabulary), "doc_id long, n long, vector binary")
    classes = lexical.classes_of(bags, 100, 400, 10).collect()
    copies = [r for r in classes if r["doc_id"] is not None and 200 <= r["doc_id"] < 240]
    assert sorted(r["place"] for r in copies) == list(range(1, 11)) and min(r["doc_id"] for r in copies) >= 200
    assert len({(r["bag"], r["variant"]) for r in copies}) == 1
    assert all((r["vector"] is not None) == (r["place"] == 1) for r in classes)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == [] and lexical.search(docs, some).collect() == []
    assert lexical.search(some.withColumnRenamed("item_id", "doc_id"), items).collect() == []
