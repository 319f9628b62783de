"""Deleted interpolation against a model of plain dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from placerank.llm import interpolated

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
S, E = "<s>", "<e>"


def tokens(text):
    return [w.decode() for w in (text or "").translate(LOW).encode().split()] + [E]


def part(d):
    return 9 if d is None else zlib.crc32(str(d).encode()) % 10


def counts(docs, order):
    c, ctx = Counter(), Counter()
    for _, t in docs:
        w = [S] * (order - 1) + tokens(t)
        for i in range(order - 1, len(w)):
            for k in range(1, order + 1):
                c[tuple(w[i - k + 1:i + 1])] += 1
                ctx[tuple(w[i - k + 1:i])] += 1
    return c, ctx


def estimates(w, i, order, c, ctx):
    """(levels of the contexts' frequencies, estimates of all orders) of the token at i."""
    levels, out = [], []
    for k in range(1, order + 1):
        n = ctx[tuple(w[i - k + 1:i])]
        out.append(c[tuple(w[i - k + 1:i + 1])] / n if n else 0.0)
        if k > 1:
            levels.append(n.bit_length())
    return tuple(levels), out


def brute(docs, order):
    train = [r for r in docs if part(r[0]) != 0]
    gone = [r for r in train if part(r[0]) == 1]
    c, ctx = counts(train, order)
    n, v = ctx[()], sum(len(g) == 1 for g in c)
    kept, kept_ctx = counts([r for r in train if part(r[0]) != 1], order)
    seen = Counter()
    for _, t in gone:
        w = [S] * (order - 1) + tokens(t)
        for i in range(order - 1, len(w)):
            b, p = estimates(w, i, order, kept, kept_ctx)
            seen[b, (1 / (v + 1), *p)] += 1

    def norm(w, b, m):
        w = np.where([True, m > 0, *[x > 0 for x in b]], np.maximum(w, interpolated.LEAST), 0)
        return w / w.sum()

    overall = np.full(order + 1, 1 / (order + 1))
    weights = {b: norm(overall, b, kept_ctx[()]) for b, _ in seen}
    for _ in range(interpolated.ROUNDS if seen else 0):
        sums = {b: np.zeros(order + 1) for b in weights}
        for (b, p), times in seen.items():
            post = weights[b] * p
            sums[b] += times * post / post.sum()
        overall = sum(sums.values()) / sum(seen.values())
        new = {b: norm((s + interpolated.PRIOR * overall) / (s.sum() + interpolated.PRIOR), b, kept_ctx[()]) for b, s in sums.items()}
        still = max(np.abs(new[b] - weights[b]).max() for b in new) < interpolated.STILL
        weights = new
        if still:
            break
    out = []
    for d, t in docs:
        w = [S] * (order - 1) + tokens(t)
        base = score = known = 0
        for i in range(order - 1, len(w)):
            b, p = estimates(w, i, order, c, ctx)
            own = norm(weights.get(b, overall), b, n)
            score += math.log10(own @ [1 / (v + 1), *p])
            base += math.log10((c[(w[i],)] + 0.1) / (n + 0.1 * (v + 1)))
            known += c[(w[i],)] > 0
        out.append((d, part(d) == 0, len(w) - order + 1, known, n, base, score))
    return out


def same(got, want):
    key = lambda r: (repr(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    words = ["The", "the", "cat", "dog", "sat", "on", "mat", "é", "ÉA", *[f"w{i}" for i in range(40)]]
    out = [(i, " ".join(rng.choices(words, [8, 8, 4, 4, 3, 3, 3, 1, 1] + [.3] * 40, k=rng.randint(0, 25)))) for i in range(260)]
    return out + [(400, None), (401, ""), (402, " \n\t"), (None, "the cat"), (7, out[7][1]), (7, "other the"), (403, "the " * 4000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string").repartition(3)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_dictionaries(spark, docs, order):
    same(interpolated.score(frame(spark, docs), order).collect(), brute(docs, order))


def test_small_blocks_and_ranges_change_nothing(spark, docs, monkeypatch):
    tokens_all = sum(len(tokens(t)) for _, t in docs)
    blocks = interpolated.blocks_of(frame(spark, docs))
    monkeypatch.setattr(interpolated, "RANGE_ENTRIES", 200)
    counts_ = interpolated.counted(blocks, 2, tokens_all)
    assert counts_.select("range").distinct().count() > 8
    same(interpolated.score(frame(spark, docs)).collect(), brute(docs, 2))


def test_blocks_close_at_their_size(docs, monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace
    monkeypatch.setattr(interpolated, "BLOCK_BYTES", 300)
    monkeypatch.setattr(interpolated, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    rows = [(d, t, len((t or "").encode()), 2) for d, t in docs]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a:a + 50]), (pa.int64(), pa.string(), pa.int32(), pa.int32()))],
                                          names=["doc_id", "text", "n_bytes", "part"]) for a in range(0, len(rows), 50)]
    out = [r for b in interpolated._make_blocks(pa.int64())(batches) for r in b.to_pylist()]
    assert [i for r in out for i in r["doc_ids"]] == [d for d, _ in docs]
    assert len({r["block"] for r in out}) == len(out) > 10
    assert sum(r["n_tokens"] for r in out) == sum(len(tokens(t)) for _, t in docs)
    size = dict(((d, t), len((t or "").encode())) for d, t in docs)
    at = 0
    for r in out:
        own = docs[at:at + len(r["doc_ids"])]
        at += len(own)
        assert len(own) == 1 or sum(size[x] for x in own) <= 300


def test_nothing_to_learn_from_and_empty_table(spark):
    held = [(d, "a b") for d in range(200) if part(d) == 0][:3]
    same(interpolated.score(frame(spark, held)).collect(), brute(held, 2))
    assert interpolated.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for top in (1, 200, 70_000, 1 << 40, 1 << 63):
        a = rng.integers(0, top, 1000, dtype=np.uint64)
        assert (interpolated.unpack(interpolated.pack(a)) == a).all()
        assert (interpolated.unpack_sorted(interpolated.pack_sorted(np.sort(a))) == np.sort(a)).all()
    assert len(interpolated.unpack(interpolated.pack(a[:0]))) == 0
