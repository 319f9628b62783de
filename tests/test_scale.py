import math

from placerank.operators.scale import display_scale, scale, scale_many
from placerank.plans.composite import percent_of_max


def vals(df, c, key="k"):
    return {r[key]: r[c] for r in df.collect()}


def frame(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k int, x double")


def test_minmax_basic_and_constant(spark):
    out = vals(scale(frame(spark, [1.0, 3.0, None, 5.0]), "x", "s"), "s")
    assert out == {0: 0.0, 1: 50.0, 2: None, 3: 100.0}
    const = vals(scale(frame(spark, [2.0, 2.0, None]), "x", "s", constant=0.0), "s")
    assert const == {0: 0.0, 1: 0.0, 2: None}


def test_sc2_reverse_zero_missing_all_rows(spark):
    sc2 = dict(method="minmax", reverse=True, zero_missing=True, rounding=3, constant=50.0, all_missing=50.0,
               degenerate_all_rows=True)
    out = vals(scale(frame(spark, [0.0, 10.0, 20.0, 40.0]), "x", "s", **sc2), "s")
    assert out == {0: None, 1: 100.0, 2: 66.667, 3: 0.0}
    flat = vals(scale(frame(spark, [5.0, 5.0, None]), "x", "s", **sc2), "s")
    assert flat == {0: 50.0, 1: 50.0, 2: 50.0}
    empty = vals(scale(frame(spark, [None, 0.0]), "x", "s", **sc2), "s")
    assert empty == {0: 50.0, 1: 50.0}


def test_zcdf_family(spark):
    xs = [1.0, 2.0, 4.0, 8.0]
    mu = sum(xs) / 4
    sd = math.sqrt(sum((x - mu) ** 2 for x in xs) / 4)
    phi = [0.5 * math.erfc(-((x - mu) / sd) / math.sqrt(2)) for x in xs]
    df = scale_many(frame(spark, xs), [dict(c="x", out="a", method="zcdf", constant=50.0),
                                       dict(c="x", out="b", method="zcdf_squeezed", rounding=2),
                                       dict(c="x", out="c", method="zcdf_margin", eps=0.5, constant=50.0,
                                            degenerate_all_rows=True)])
    got = {r["k"]: r for r in df.collect()}
    for i, p in enumerate(phi):
        assert abs(got[i]["a"] - 100 * p) < 1e-9
        e = 0.5 / 4
        assert got[i]["b"] == round(((1 - 2 * e) * min(max(p, 1e-9), 1 - 1e-9) + e) * 100, 2)
        assert abs(got[i]["c"] - (0.5 + min(max(p, 0.005), 0.995) * 99.0)) < 1e-9
    # minimum of the margin score is 0.995 (the margin applied twice)
    assert min(r["c"] for r in got.values()) >= 0.995 - 1e-12
    flat = vals(scale(frame(spark, [3.0, 3.0]), "x", "s", "zcdf_margin", constant=50.0, degenerate_all_rows=True), "s")
    assert flat == {0: 50.0, 1: 50.0}


def test_tscore_sigmoid_relative(spark):
    xs = [10.0, 20.0, 30.0]
    df = scale_many(frame(spark, xs), [dict(c="x", out="t", method="tscore", ddof=1, constant=50.0),
                                       dict(c="x", out="g", method="sigmoid", ddof=1, z_out="z"),
                                       dict(c="x", out="r", method="mean_relative")])
    got = {r["k"]: r for r in df.collect()}
    assert [round(got[i]["t"], 9) for i in range(3)] == [40.0, 50.0, 60.0]
    assert abs(got[2]["g"] - 100 / (1 + math.exp(-1.0))) < 1e-9 and got[1]["z"] == 0.0
    assert [got[i]["r"] for i in range(3)] == [25.0, 50.0, 75.0]
    const = scale(frame(spark, [4.0, 4.0]), "x", "g", "sigmoid", ddof=1, z_out="z").collect()
    assert all(r["g"] == 50.0 and r["z"] == 0.0 for r in const)


def test_grouped_scaling(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0), ("b", 7.0)], "g string, x double")
    out = sorted((r["g"], r["x"], r["s"]) for r in scale(df, "x", "s", by="g").collect())
    assert out == [("a", 1.0, 0.0), ("a", 3.0, 100.0), ("b", 7.0, 0.0), ("b", 7.0, 0.0)]


def test_percent_and_display(spark):
    df = frame(spark, [150.0, None])
    assert [r[0] for r in df.select(percent_of_max("x", 10.0)).collect()] == [15.0, None]
    a = spark.createDataFrame([(1, 1.0), (2, 100.0)], "k int, v double")
    b = spark.createDataFrame([(3, 10.0), (4, None)], "k int, v double")
    la, lb = display_scale([a, b], "v", log=True)
    va, vb = vals(la, "display_value"), vals(lb, "display_value")
    assert va == {1: 0.0, 2: 1.0} and abs(vb[3] - 0.5) < 1e-12 and vb[4] is None
    assert [r["no_data"] for r in lb.orderBy("k").collect()] == [False, True]
