import math
import random

import numpy as np
import os

import pytest
from pyspark.sql import functions as F

from placerank.operators.agg import (ensure_min_members, explode_sum, fill_half_min, profile, quantile_exact,
                                     richness_score, select_top_quantile, shannon, value_counts)
from placerank.operators.rank import (cap_per_key, first_by, global_index, nth_per_group, rank_columns, rank_min,
                                      row_rank, top_k)


def data(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("abc"), float(rnd.randint(0, 20)) if rnd.random() > 0.1 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id int, g string, v double"), rows


def brute_rank_min(rows, by):
    out = {}
    for i, g, v in rows:
        if v is None:
            out[i] = None
            continue
        peers = [w for _, h, w in rows if (h == g or not by) and w is not None]
        out[i] = 1 + sum(1 for w in peers if w > v)
    return out


@pytest.mark.parametrize("path", ["small", "large"])
def test_rank_min_and_row_rank(spark, request, path):
    if path == "large":
        request.getfixturevalue("large_path")
    df, rows = data(spark)
    for by in (None, "g"):
        got = {r["id"]: r["r"] for r in rank_min(df, "v", "r", by=by).collect()}
        assert got == brute_rank_min(rows, by)
    rr = {r["id"]: r["rr"] for r in row_rank(df, "v", "rr", tiebreak="id").collect()}
    order = sorted(rows, key=lambda t: (t[2] is None, -(t[2] or 0), t[0]))
    assert rr == {t[0]: k + 1 for k, t in enumerate(order)}
    rg = {r["id"]: r["rr"] for r in row_rank(df, "v", "rr", tiebreak="id", by="g").collect()}
    for g in "abc":
        sub = sorted([t for t in rows if t[1] == g], key=lambda t: (t[2] is None, -(t[2] or 0), t[0]))
        assert [rg[t[0]] for t in sub] == list(range(1, len(sub) + 1))


def test_global_index_is_a_permutation(spark):
    df, rows = data(spark, 500)
    idx = global_index(df, [F.col("v").asc_nulls_last(), F.col("id").asc()], partitions=7).collect()
    assert sorted(r["_gidx"] for r in idx) == list(range(1, 501))
    order = sorted(rows, key=lambda t: (t[2] is None, t[2] or 0, t[0]))
    assert [r["id"] for r in sorted(idx, key=lambda r: r["_gidx"])] == [t[0] for t in order]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables not present")
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_positions_of_many_wide_rows(spark, large_path, reuse):
    from placerank.operators.clean import assign_cyclic
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
        n = orders.count()
        ranked = row_rank(orders, "o_totalprice", "r", tiebreak="o_orderkey").select("r")
        assert ranked.agg(F.count_distinct("r"), F.min("r"), F.max("r")).first() == (n, 1, n)
        labels = assign_cyclic(orders, ["o_totalprice", "o_orderkey"], ["a", "b", "c"]).select("o_orderkey", "label")
        order = orders.select("o_orderkey", "o_totalprice").toPandas().sort_values(["o_totalprice", "o_orderkey"])
        want = dict(zip(order.o_orderkey, ("abc"[i % 3] for i in range(n))))
        assert {r.o_orderkey: r.label for r in labels.collect()} == want
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_rank_columns_and_topk(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 7.0, 1.0), (3, 5.0, None)], "k int, a double, b double")
    out = {r["k"]: (r["ra"], r["rb"]) for r in rank_columns(df, "k", {"a": "ra", "b": "rb"}).collect()}
    assert out == {1: (2, 1), 2: (1, 1), 3: (2, None)}
    assert [r["k"] for r in top_k(df, "a", 2, tiebreak="k").collect()] == [2, 1]


def test_cap_nth_first(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["x", "y"]), i, rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, id int, t double")
    order = [F.col("t").asc(), F.col("id").asc()]
    got = sorted((r["key"], r["id"]) for r in cap_per_key(df, "key", order, 3, salts=16).collect())
    want = []
    for k in {r[0] for r in rows}:
        want += [(k, r[1]) for r in sorted([r for r in rows if r[0] == k], key=lambda r: (r[2], r[1]))[:3]]
    assert got == sorted(want)
    third = {r["key"]: r["id"] for r in nth_per_group(df, "key", order, 3).collect()}
    assert third == {k: sorted([r for r in rows if r[0] == k], key=lambda r: (r[2], r[1]))[2][1] for k in third}
    assert len(first_by(df, "key", order).collect()) == 3


@pytest.mark.parametrize("path", ["small", "large"])
def test_quantile_exact(spark, request, path):
    if path == "large":
        request.getfixturevalue("large_path")
    df, rows = data(spark, 200)
    got = {r["g"]: (r["q1"], r["q3"]) for r in quantile_exact(df, "v", {"q1": 0.25, "q3": 0.75}, by="g").collect()}
    for g in "abc":
        xs = [v for _, h, v in rows if h == g and v is not None]
        assert abs(got[g][0] - np.quantile(xs, 0.25)) < 1e-9 and abs(got[g][1] - np.quantile(xs, 0.75)) < 1e-9
    one = quantile_exact(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double"), "v", {"m": 0.75}).first()
    assert one["m"] == 4.75


def test_shannon_and_richness(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("b", None), (None, "x")],
                               "k string, c string")
    h = {r["k"]: (r["n_items"], r["diversity"]) for r in shannon(df, "k", "c").collect()}
    p = np.array([2 / 3, 1 / 3])
    assert h["a"][0] == 3 and abs(h["a"][1] - float(-(p * np.log(p)).sum())) < 1e-12
    assert h["b"] == (1, 0.0) and None not in h
    r = {x["k"]: x["richness"] for x in richness_score(df, "k", "c", distinct=True).collect()}
    assert abs(r["a"] - 2 * (1 + math.log(2))) < 1e-12


def test_quantile_selection_and_min_members(spark):
    rows = [("g1", i, float(i)) for i in range(8)] + [("g2", 100, 1.0), ("g2", 101, 0.5), ("g3", 200, 2.0)]
    df = spark.createDataFrame(rows, "g string, id int, m double")
    sel = select_top_quantile(df, "g", "m", 0.75, 0.85, keep=["g3"])
    ids = sorted(r["id"] for r in sel.collect())
    assert ids == [6, 7, 100, 200]  # g1: Q3 = 5.25; global 85 % = 5.5
    out = sorted(r["id"] for r in ensure_min_members(sel, df, "g", "m", 2, tiebreak="id").collect())
    assert out == [6, 7, 100, 101, 200]  # g2 gains its 2nd row, g3 has no 2nd row


def test_fill_counts_profile_explode(spark):
    df = spark.createDataFrame([(1, 4.0), (2, None), (3, 2.0)], "k int, x double")
    assert {r["k"]: r["x"] for r in fill_half_min(df, "x").collect()} == {1: 4.0, 2: 1.0, 3: 2.0}
    vc = value_counts(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string"), "c").collect()
    assert [(r["c"], r["count"]) for r in vc] == [("a", 2), ("b", 1)]
    pr = {r["column"]: r for r in profile(df).collect()}
    assert pr["x"]["n_missing"] == 1 and pr["x"]["min"] == 2.0 and pr["k"]["n_rows"] == 3
    ex = spark.createDataFrame([("['a', 'b']", "10"), ("a", "x"), (None, "3")], "r string, m string")
    got = {r["region"]: (r["total"], r["mean"]) for r in explode_sum(ex, "r", "m").collect()}
    assert got == {"a": (10.0, 5.0), "b": (10.0, 10.0)}


def hot(n=160_000):
    """A group with most rows, in which one value has a third of all, and small groups."""
    rnd = random.Random(6)
    return [(i, "hot" if i % 20 else rnd.choice("xyz"), 7.0 if i % 3 == 0 else rnd.gauss(7, 1e-4) if i % 3 == 1 else rnd.expovariate(1e-3))
            for i in range(n)]


def test_ranks_and_quantiles_of_a_hot_group_with_heavy_ties(spark):
    import pandas as pd
    rows = hot()
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "g", "v"])).repartition(6)
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
    for by in (None, "g"):
        want = (pdf.groupby("g").v if by else pdf.v).rank(method="min", ascending=False).astype("int64")
        got = rank_min(df, "v", "r", by=by).select("id", "r").toPandas().set_index("id").r
        assert (got.sort_index().to_numpy() == want.to_numpy()).all()
        order = pdf.sort_values(["v", "id"], ascending=[False, True], kind="stable")
        want = (order.groupby("g").cumcount() + 1 if by else pd.Series(range(1, len(pdf) + 1), index=order.index)).sort_index()
        got = row_rank(df, "v", "r", tiebreak="id", by=by).select("id", "r").toPandas().set_index("id").r
        assert (got.sort_index().to_numpy() == want.to_numpy()).all()
    qs = {"a": 0.0, "b": 0.2503, "c": 0.5, "d": 0.85, "e": 1.0}
    for r in quantile_exact(df, "v", qs, by="g").collect():
        xs = pdf[pdf.g == r["g"]].v
        assert all(abs(r[k] - xs.quantile(q)) <= 1e-9 * max(1, abs(xs.quantile(q))) for k, q in qs.items())
    one = quantile_exact(df, "v", qs).first()
    assert all(abs(one[k] - pdf.v.quantile(q)) <= 1e-9 * max(1, pdf.v.quantile(q)) for k, q in qs.items())


def test_ranges_spread_the_rows_and_no_job_runs_while_plans_are_built(spark):
    import pandas as pd
    from placerank.operators.ranges import row_hash, sort_key, with_range
    df = spark.createDataFrame(pd.DataFrame(hot(), columns=["id", "g", "v"])).repartition(6)
    key = sort_key(df, [(F.col("v"), False), (row_hash(df), True)])
    sizes = [r["count"] for r in with_range(df, key, 32).groupBy("_range").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * sum(sizes) / 32
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        rank_min(df, "v", "r", by="g"), row_rank(df, "v", "r", tiebreak="id"), quantile_exact(df, "v", {"m": 0.5}, by="g")
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_orders_of_every_type_both_ways(spark):
    import datetime as dt
    from decimal import Decimal
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, rnd.randint(-5, 5)]), rnd.choice([None, rnd.uniform(-1, 1)]), rnd.choice([None, "a", "ab", "b", "é", ""]),
             rnd.choice([None, dt.date(2020, 1, rnd.randint(1, 9))]), rnd.choice([None, dt.datetime(2020, 1, 1, rnd.randint(0, 9))]),
             rnd.choice([None, Decimal(rnd.randint(-99, 99)) / 10]), rnd.choice([None, True, False])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, l long, d double, s string, t date, u timestamp, e decimal(5,1), b boolean")
    for j, c in enumerate(df.columns[1:], 1):
        for ascending in (True, False):
            got = [r["id"] for r in global_index(df, [(c, ascending), ("id", True)], partitions=5).orderBy("_gidx").collect()]
            by_id = sorted(rows, key=lambda r: r[0])
            value = (lambda r: r[j].encode()) if c == "s" else (lambda r: r[j])
            want = sorted([r for r in by_id if r[j] is not None], key=value, reverse=not ascending)
            if not ascending:  # reversed() keeps ties in order of the id
                want = sorted([r for r in by_id if r[j] is not None], key=lambda r: r[0])
                want = sorted(want, key=value, reverse=True)
            assert got == [r[0] for r in want] + [r[0] for r in by_id if r[j] is None], (c, ascending)


def test_empty_and_null_groups(spark):
    none = spark.createDataFrame([], "id int, g string, v double")
    assert rank_min(none, "v", "r", by="g").collect() == [] and row_rank(none, "v", "r").collect() == []
    assert quantile_exact(none, "v", {"m": 0.5}).collect() == [(None,)] and quantile_exact(none, "v", {"m": 0.5}, by="g").collect() == []
    some = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0), (3, "a", None)], "id int, g string, v double")
    assert {r["id"]: r["r"] for r in rank_min(some, "v", "r", by="g").collect()} == {1: 2, 2: 1, 3: None}
    assert {r["id"]: r["r"] for r in row_rank(some, "v", "r", by="g").collect()} == {1: 2, 2: 1, 3: 1}
    assert [tuple(r) for r in quantile_exact(some, "v", {"m": 0.5}, by="g").collect()] == [(None, 2.5)]


def test_stats_row(spark):
    from placerank.operators.agg import stats_row
    df = spark.createDataFrame([(1.0, None), (4.0, None), (2.0, None)], "a double, b double")
    r = stats_row(df, ["a", "b"]).first()
    assert (r["a_median"], r["a_min"], r["a_max"]) == (2.0, 1.0, 4.0) and abs(r["a_mean"] - 7 / 3) < 1e-12
    assert r["b_median"] is None and r["b_std"] is None
