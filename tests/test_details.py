"""Joins for hot keys and large dictionaries, halo windows, density clusters, profile parts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placerank.functions.text import to_array
from placerank.operators import agg, density, joins
from placerank.operators.rank import context_window


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_join_equals_a_plain_join_and_spreads_the_hot_key(spark, how):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice(["hot"] * 6 + list("abcdefg") + [None]), i) for i in range(3000)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("z", 4), (None, 5)], "k string, v int")
    if how == "left_semi" or how == "left_anti":
        right = right.select("k").distinct()
    assert pairs(joins.heavy_join(left, right, "k", how)) == pairs(left.join(right, "k", how))


def test_contained_names_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abcd é😀") for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(900, None), (901, "")]
    names = ["".join(rng.choice("abcd é😀") for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["", None, "abc", "a.c"]
    got = joins.contained_names(spark.createDataFrame(texts, "id int, t string"), "id", "t",
                                spark.createDataFrame([(n,) for n in names], "name string"), "name")
    want = sorted({(i, n) for i, t in texts for n in names if n and t and n in t}, key=repr)
    assert pairs(got) == want


def test_many_names(spark):
    """100,000 names are one join, not 100,000 searches a text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(100_000)]
    texts = [(i, " ".join(rng.choice(words)[:rng.randint(5, 7)] for _ in range(40))) for i in range(60)]
    held = set(words)
    want = sorted((i, t[a:a + 7]) for i, t in texts for a in range(len(t)) if t[a:a + 7] in held)
    got = joins.contained_names(spark.createDataFrame(texts, "id int, t string"), "id", "t",
                                spark.createDataFrame([(w,) for w in words], "name string"), "name")
    assert pairs(got) == sorted(set(want), key=repr)


def test_few_names_are_found_where_the_texts_are_read(spark):
    """No gram of a text is shuffled; the rows are those of the join, also for keys that repeat or are null."""
    rng = random.Random(5)
    texts = [(rng.choice([None, *range(60)]), "".join(rng.choice("abcd éè") for _ in range(rng.randint(0, 60)))) for _ in range(150)] + [(900, None)]
    names = ["".join(rng.choice("abcd éè") for _ in range(rng.randint(1, 12))) for _ in range(300)] + [t[3:18] for _, t in texts[:40]]
    args = spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(n,) for n in names], "name string"), "name"
    got, met = joins.contained_names(*args), joins.contained_names(*args, small=0)
    assert pairs(got) == pairs(met) and len(pairs(met)) > 1000
    single = joins.contained_names(args[0].where("id = 900").unionByName(spark.createDataFrame([(1, "abcd")], "id int, t string")), *args[1:])
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan


def near(rows, k):
    out = []
    for g in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == g], key=lambda r: r[1])
        out += [r for i, r in enumerate(own) if any(x[2] for x in own[max(0, i - k):i + k + 1])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, block", [(1, 4), (3, 5), (2, 2), (7, 3), (0, 4)])
def test_context_window_over_blocks(spark, k, block):
    rng = random.Random(4)
    rows = [(g, 3 * i, rng.random() < 0.1) for g, n in (("hot", 200), ("a", 3), ("b", 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, p int, hit boolean").repartition(5)
    assert pairs(context_window(df, "g", "p", "hit", k, block=block)) == near(rows, k)
    dense = [(g, p // 3, h) for g, p, h in rows]
    df = spark.createDataFrame(dense, "g string, p int, hit boolean").repartition(5)
    assert pairs(context_window(df, "g", "p", "hit", k, dense=True, block=block)) == near(dense, k)


def test_context_window_of_a_group_of_a_million_rows_is_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.col("id").alias("p"), (F.col("id") % 1000 == 0).alias("hit"))
    got = context_window(df, "g", "p", "hit", 1, dense=True)
    assert got.count() == 2999
    home = df.select(F.floor(F.col("p") / 10_000).alias("b")).distinct().count()
    assert home == 100  # windows of one group


def brute_density(points, eps, least):
    near_ = {a: [b for b, q in points.items() if b != a and math.dist(p, q) <= eps] for a, p in points.items()}
    cores = {a for a, n in near_.items() if len(n) + 1 >= least}
    root = {}
    for a in sorted(cores):
        if a not in root:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = a
                    todo += [b for b in near_[x] if b in cores]
    return {a: root[a] if a in cores else min((root[b] for b in near_[a] if b in cores), default=-1) for a in points}


def test_density_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    centres = [(0, 0), (1, 1), (-1, .5)]
    points = {i: tuple(c + rng.gauss(0, .12) for c in rng.choice(centres)) if i % 4 else (rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(220)}
    points |= {500: (0.0, 0.0), 501: (0.0, 0.0)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(600, None, 1.0)], "id long, x double, y double")
    for eps, least in ((0.1, 4), (0.25, 3), (0.05, 1)):
        got = dict(map(tuple, density.density_clusters(df, "id", ["x", "y"], eps, least).collect()))
        assert got == brute_density(points, eps, least) | {600: -1}


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(400)]
    both = spark.createDataFrame(links + [(b, a) for a, b in links], "a long, b long")
    nodes = spark.createDataFrame([(n,) for n in {x for p in links for x in p} | {5000}], "node long")
    got = dict(map(tuple, density.connected(nodes, both).collect()))
    assert got == {n: 0 if n <= 300 else 5000 if n == 5000 else 1000 for n in got} and len(got) == 703


def test_describe_and_code_lengths(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "bb"), (4.0, None), (None, "cc")], "x double, c string")
    r = agg.describe_numbers(df, ["x"]).first()
    assert (r["n"], r["min"], r["q1"], r["median"], r["q3"], r["max"]) == (3, 1.0, 1.5, 2.0, 3.0, 4.0)
    assert pairs(agg.code_lengths(df, ["c"])) == [("c", 1, 1), ("c", 2, 2)]
    assert pairs(agg.type_counts(df)) == [(4, "double", 1), (4, "string", 1)]


def test_list_items_of_any_length(spark):
    long = "x" * 1_000_000
    rows = [(f"['{long}', 'b\\'c']",), (f'["{long}"]',), (f"['{chr(92)}n{'y' * 9000}']",), (f"['{long}",), ("['a', \"b\", ]",)]
    got = [r["a"] for r in spark.createDataFrame(rows, "s string").select(to_array("s").alias("a")).collect()]
    assert got[0] == [long, "b'c"] and got[1] == [long] and got[2] == ["n" + "y" * 9000] and got[4] == ["a", "b"]
    assert got[3] is None
