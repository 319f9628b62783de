"""Periodic runs against their definition, tried at every start and period."""

import hashlib
import random

import numpy as np
import pytest

from placerank.llm import periodic


def brute(words):
    """All runs by the definition: for each period the maximal stretches, kept where no shorter period fits."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            a, e = i, j + q
            if e - a >= max(6, 4 * q) and not any(all(words[t] == words[t + p] for t in range(a, e - p)) for p in range(1, q)):
                out.add((a, e - a, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(lists):
    number = {}
    flat = np.array([number.setdefault(w, len(number)) for x in lists for w in x], np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


def make(rng):
    kind = rng.random()
    if kind < 0.4:
        return [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 60))]
    out = []
    for _ in range(rng.randint(1, 4)):
        out += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
        root = [rng.choice("abx") for _ in range(rng.randint(1, 14))]
        out += (root * 9)[:rng.randint(1, 6 * len(root))]
    return out


def test_runs_equal_their_definition():
    rng = random.Random(5)
    lists = [make(rng) for _ in range(700)]
    # roots that hold each of their short grams twice: neighbours of short grams are too near
    lists += [list("aabbaabbccddccdd") * 5, list("aaaaab") * 6 + list("aaaaab"), ["a"] * 400, list("ab") * 100 + ["a"] * 9]
    flat, starts = numbered(lists)
    for words, got in zip(lists, periodic.find_runs(flat, starts)):
        assert got == brute(words), words


def expected(doc_id, text):
    words = (text or "").encode().split()
    order = periodic.planted(doc_id, len(words))
    words = words if order is None else [words[i] for i in order]
    found = brute(words)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    texts = [" ".join(make(rng)) for _ in range(120)] + [None, "", " \t\n", "a b   a b", "A a " * 6, "x" * 5000]
    return [(i, t, "z") for i, t in enumerate(texts)] + [(None, "a " * 9, "z"), (3, texts[3], "z"), (3, texts[3], "z")]


def test_query_columns_and_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(map(tuple, periodic.digest(periodic.runs(docs, periodic.planted)).collect()), key=repr)
    assert got == sorted((expected(d, t) for d, t, _ in rows), key=repr)


def test_collapsed_text_and_small_batches(spark, rows, monkeypatch):
    monkeypatch.setattr(periodic, "BATCH_WORDS", 40)
    lists = [(t or "").encode().split() for _, t, _ in rows]
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])})
    out = [r for b in periodic._find(pa.int64(), None)([batch]) for r in b.to_pylist()]
    assert [(r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]]) for r in out] == \
        [(len(w), brute(w)) for w in lists]


def test_planted_follows_the_rule():
    import zlib
    for d in range(200):
        h, n = zlib.crc32(str(d).encode()), 37
        order = periodic.planted(d, n)
        if h % 10:
            assert order is None
            continue
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        assert list(order) == [i if i < a else a + (i - a) % p for i in range(n)]
    assert periodic.planted(7, 0) is None and periodic.planted(None, 5) is None


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digest(periodic.runs(docs)).count() == 0
