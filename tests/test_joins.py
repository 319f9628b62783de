import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placerank.operators import joins
from placerank.operators.joins import (EARTH_RADIUS_M, append_missing, bridge_mean, coalesce_from,
                                       complete_domain, cross_terms, join_all, radius_join, resolve_alias,
                                       weighted_distance)


def hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    x = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(d) - math.radians(b)) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(x))


def test_grid_join_equals_brute_force(spark):
    rnd = random.Random(11)
    for lat0, span in ((37.5, 0.2), (69.0, 0.3)):  # mid and high latitude
        left = [(i, lat0 + rnd.random() * span, 127 + rnd.random() * span) for i in range(120)]
        right = [(j, lat0 + rnd.random() * span, 127 + rnd.random() * span) for j in range(400)]
        # points exactly on cell borders
        dlat = 2000 / (math.pi * EARTH_RADIUS_M / 180)
        right += [(1000 + k, math.floor(lat0 / dlat + k) * dlat, 127.1) for k in range(5)]
        ldf = spark.createDataFrame(left, "pid int, lat double, lng double")
        rdf = spark.createDataFrame(right, "qid int, p_lat double, p_lng double")
        got = sorted((r["pid"], r["qid"]) for r in radius_join(ldf, rdf, 2000.0, right_lat="p_lat", right_lng="p_lng",
                                                               max_abs_lat=lat0 + span).collect())
        want = sorted((a, b) for a, la, lo in left for b, pa, po in right if hav(la, lo, pa, po) <= 2000.0)
        assert got == want and len(want) > 0


@pytest.mark.parametrize("lat0, span, lng0, width, radius", [
    (-0.1, 0.2, 179.9, 0.2, 3000.0), (-45.2, 0.3, -180.2, 0.4, 5000.0), (89.7, 0.3, -180.0, 360.0, 20000.0),
    (-90.0, 0.2, -180.0, 360.0, 8000.0), (86.0, 0.4, 170.0, 20.0, 9000.0), (-80.0, 160.0, -180.0, 360.0, 4.0e6)])
def test_grid_join_at_poles_and_date_line(spark, lat0, span, lng0, width, radius):
    rnd = random.Random(5)

    def points(n):
        return [(i, lat0 + rnd.random() * span, (lng0 + rnd.random() * width + 180) % 360 - 180) for i in range(n)]

    left = points(60) + [(900, lat0, 180.0), (901, lat0, -180.0)]
    right = points(200) + [(902, lat0 + span, 180.0), (903, lat0 + span, -180.0), (904, lat0, 179.9999)]
    ldf, rdf = spark.createDataFrame(left, "pid int, lat double, lng double"), \
        spark.createDataFrame(right, "qid int, p_lat double, p_lng double")
    got = sorted((r["pid"], r["qid"]) for r in radius_join(ldf, rdf, radius, right_lat="p_lat", right_lng="p_lng").collect())
    want = sorted((a, b) for a, la, lo in left for b, pa, po in right if hav(la, lo, pa, po) <= radius)
    assert got == want and len(want) > 0


def test_weighted_distance_semantics(spark):
    places = spark.createDataFrame([("p", 37.5, 127.0), ("far", 10.0, 10.0)], "name string, lat double, lng double")
    pts = spark.createDataFrame([(37.5, 127.001, 2.0), (37.5, 127.005, 0.0)], "p_lat double, p_lng double, w double")
    out = {(r["name"], r["radius_m"]): r for r in weighted_distance(places, pts, "name", [100.0, 1000.0], "w").collect()}
    d1 = hav(37.5, 127.0, 37.5, 127.001)
    assert out[("p", 100.0)]["n_points"] == 1 and abs(out[("p", 100.0)]["weighted_dist_m"] - d1) < 1e-6
    assert out[("p", 1000.0)]["n_points"] == 2 and out[("p", 1000.0)]["weight_sum"] == 2.0
    assert out[("far", 1000.0)]["n_points"] == 0 and out[("far", 1000.0)]["weighted_dist_m"] is None
    zero = spark.createDataFrame([(37.5, 127.001, 0.0)], "p_lat double, p_lng double, w double")
    z = weighted_distance(places, zero, "name", [1000.0], "w").filter(F.col("name") == "p").first()
    assert z["n_points"] == 0 and z["weighted_dist_m"] is None  # no weight: reported as zero points


def test_radius_sums_equal_all_pairs(spark, monkeypatch):
    """Cells cut into many blocks, more groups than are summed at once, null, NaN and infinite weights, null groups."""
    monkeypatch.setattr(joins, "PAIR_ROWS", 7)
    rnd = random.Random(3)
    places = [(i % 50, rnd.uniform(-0.03, 0.03), (rnd.uniform(179.97, 180.03) + 180) % 360 - 180) for i in range(60)] + [(77, None, 1.0)]
    spots = [(rnd.uniform(-0.03, 0.03), (rnd.uniform(179.97, 180.03) + 180) % 360 - 180) for _ in range(90)]
    odd = {5: None, 6: float("nan"), 7: float("inf")}
    points = [(rnd.choice([None, *range(20)]), *spots[i % 90], odd.get(i, rnd.random())) for i in range(600)] + [(1, None, 2.0, 1.0)]
    radii = [700.0, 2000.0, 1500.0]
    got = joins.radius_sums(spark.createDataFrame(places, "k int, lat double, lng double"),
                            spark.createDataFrame(points, "g int, p_lat double, p_lng double, w double"), "k", radii, "w", by_right="g").collect()
    want: dict = {}
    for k, la, lo in places:
        for g, pa_, po, w in points:
            d = hav(la, lo, pa_, po) if la is not None and pa_ is not None else math.inf
            if d <= 2000.0:
                sums = want.setdefault((k, g), [0, 0.0, 0.0] * 3)
                for i, r in enumerate(radii):
                    if d <= r:
                        sums[3 * i] += 1
                        sums[3 * i + 1] += w or 0.0
                        sums[3 * i + 2] += (w or 0.0) * d
    assert len(got) == len(want) > 100
    for r in got:
        assert list(r[2:]) == pytest.approx(want[r["k"], r["g"]], rel=1e-9, nan_ok=True)


def test_radius_sums_take_each_distance_once(monkeypatch):
    """50 places and 5,000 points of 5 groups at 40 spots: 2,000 distances, not 250,000."""
    taken, own = [], joins._distances
    monkeypatch.setattr(joins, "_distances", lambda *x: taken.append(len(x[0]) * len(x[2])) or own(*x))
    left = pa.table({"k": list(range(50)), "_lat": [37.5] * 50, "_lng": [127.0] * 50})
    right = pa.table({"g": [i % 5 for i in range(200)], "_lat": [37.5 + i // 5 * 1e-5 for i in range(200)], "_lng": [127.0] * 200,
                      "_n": [25] * 200, "_w": [1.0] * 200})
    out = joins._summing(["k"], ["g"], [1000.0])(left, right)
    assert out.num_rows == 250 and set(out.column("_n_0").to_pylist()) == {1000} and sum(taken) == 2000


def test_weighted_distance_makes_no_row_of_a_pair(spark):
    """300 places and 3,000 points at one spot are 900,000 pairs; no operator of the plan gives out as many rows."""
    places = spark.range(300).selectExpr("id AS k", "37.5D AS lat", "127.0D AS lng")
    points = spark.range(3000).selectExpr("37.5D AS p_lat", "127.0D AS p_lng", "1.0D AS w")
    out = weighted_distance(places, points, "k", [500.0], "w")
    assert {r["n_points"] for r in out.collect()} == {3000}

    def most(plan):
        name, sub = plan.getClass().getSimpleName(), plan.children()
        own = plan.metrics().get("numOutputRows")
        below = [sub.apply(i) for i in range(sub.size())]
        below += [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
        return max([own.get().value() if own.isDefined() else 0, *map(most, below)])

    assert most(out._jdf.queryExecution().executedPlan()) < 50_000


def test_domain_bridge_append(spark):
    dim = spark.createDataFrame([(k,) for k in range(5)], "k int")
    s = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 10.0), (9, 4.0)], "k int, score double")
    got = {r["k"]: r["score"] for r in complete_domain(s, dim, "k", "score").collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 10.0, 3: 3.5, 4: 3.5, 9: 4.0}
    bridge = spark.createDataFrame([("A", [0, 1]), ("B", [7]), ("C", [2, 8])], "e string, rs array<int>")
    bm = {r["e"]: r["score"] for r in bridge_mean(bridge, s, "e", "rs", ["score"], region_key="k").collect()}
    assert bm == {"A": 2.0, "B": 0.0, "C": 10.0}
    am = {r["k"]: r["score"] for r in append_missing(s, dim, "k", "score", half_min=True).collect()}
    assert am[3] == 0.5 and am[4] == 0.5 and len(am) == 6


def test_outer_fill_precedence_terms(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int")
    b = spark.createDataFrame([(2, 5), (3, 7)], "k int, b int")
    got = sorted(tuple(r) for r in join_all([a, b], "k", "full", fill=0).select("k", "a", "b").collect())
    assert got == [(1, 2, 0), (2, 3, 5), (3, 0, 7)]
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    other = spark.createDataFrame([(2, 9.0)], "k int, v double")
    assert {r["k"]: r["v"] for r in coalesce_from(base, other, "k", ["v"]).collect()} == {1: 1.0, 2: 9.0}
    t = cross_terms(spark.createDataFrame([("park",)], "n string"), "n", ["a", "b"]).collect()
    assert sorted(r["search_query"] for r in t) == ["park a", "park b"]


def test_resolve_alias(spark):
    targets = spark.createDataFrame([("북서울꿈의숲",), ("서울숲",), ("없는공원",)], "t string")
    aliases = spark.createDataFrame([("북서울꿈의숲", "꿈의숲"), ("북서울꿈의숲", "북서울 꿈의 숲")], "canonical string, alias string")
    master = spark.createDataFrame([(1, "꿈의숲"), (2, "서울 숲"), (3, "서울숲")], "o int, name string")
    m, u = resolve_alias(targets, aliases, master, "t", "name", "o")
    assert {r["t"]: r["o"] for r in m.collect()} == {"북서울꿈의숲": 1, "서울숲": 2}
    assert [r["t"] for r in u.collect()] == ["없는공원"]


def test_safety_index_completion(spark):
    from placerank.plans.composite import safety_index
    dom = spark.createDataFrame([(k,) for k in range(4)], "k int")
    a = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 40.0), (7, 5.0)], "k int, A_score double")
    b = spark.createDataFrame([(0, None), (1, None)], "k int, B_score double")  # no value at all
    got = {r["k"]: (r["A_score"], r["B_score"], r["s"]) for r in
           safety_index({"A": a, "B": b}, "k", dom, weights={"A": 1.0, "B": 1.0}, out="s").collect()}
    # domain members get A's median (20) and keep a missing B; key 7 is not in every pillar
    assert got == {0: (10.0, None, None), 1: (20.0, None, None), 2: (40.0, None, None), 3: (15.0, None, None)}
