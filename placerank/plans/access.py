"""Accessibility pillar on the test tables: suppliers are the places, customers the
population points (coordinates derived from keys, weight from the balance).

radius join (JN5) → weighted distance (AG7) → pivot (RS1) → reversed min-max
(SC2) → parking rule (CI4) → composites (CI5, CI6, CI7).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import normal_cdf_sql
from ..operators.joins import weighted_distance
from ..operators.reshape import pivot_wide
from ..operators.scale import scale_many
from ..operators.joins import maybe_broadcast
from ..session import cut_lineage
from . import sqlkit as Q
from .composite import (access_final, parking_score, population_score, region_scores,
                        weighted_composites)
from .indicators import _LAT, _LNG, _hav
from .registry import load, query

RADII = [500, 1000, 2000]
POP = {r: f"pop_{r}" for r in RADII}


def access_base(spark, sf):
    """Per place: distances per radius, population scores, walking and parking scores."""
    s = load(spark, sf, "supplier")
    places = s.select("s_suppkey", F.expr(_LAT.format(k="s_suppkey")).alias("lat"),
                      F.expr(_LNG.format(k="s_suppkey")).alias("lng"))
    c = load(spark, sf, "customer")
    points = c.select(F.expr(_LAT.format(k="c_custkey")).alias("p_lat"),
                      F.expr(_LNG.format(k="c_custkey")).alias("p_lng"), (F.col("c_acctbal") + 1000).alias("w"))
    wd = weighted_distance(places, points, "s_suppkey", [float(r) for r in RADII], "w")
    wd = wd.withColumn("radius", F.col("radius_m").cast("int"))
    wide = pivot_wide(wd, "s_suppkey", "radius", "weighted_dist_m", RADII, fmt="dist_{v}m")
    n = load(spark, sf, "nation")
    base = (s.join(maybe_broadcast(n.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(wide, "s_suppkey")
            .select("s_suppkey", "n_name", "s_acctbal", *[f"dist_{r}m" for r in RADII],
                    F.when(F.col("s_acctbal") >= 0, F.abs(F.col("s_acctbal")) % 40 + 3).alias("minutes"),
                    F.when(F.col("s_acctbal") > 5000, F.lit("yes")).when(F.col("s_acctbal") < 0, F.lit("no"))
                     .alias("has_text"),
                    (F.col("s_suppkey") % 6).cast("string").alias("lots_text"),
                    (F.col("s_acctbal") / 10).alias("spaces")))
    base = cut_lineage(base)  # place-level table reused by every statistic below
    sc2 = dict(method="minmax", reverse=True, zero_missing=True, rounding=3, constant=50.0,
               all_missing=50.0, degenerate_all_rows=True)
    base = scale_many(base, [dict(c=f"dist_{r}m", out=POP[r], **sc2) for r in RADII]
                      + [dict(c="minutes", out="walk_score", **sc2)])
    base = base.withColumn("acc_text", F.lit("no")).withColumn("ext_text", F.lit(None).cast("string"))
    return parking_score(base, "has_text", "lots_text", "spaces", "acc_text", "ext_text", None)


def _sc2(col):
    nz = f"(CASE WHEN {col} <> 0 THEN {col} END)"
    return (f"CASE WHEN count({nz}) OVER () = 0 OR max({nz}) OVER () = min({nz}) OVER () THEN 50.0 "
            f"WHEN {nz} IS NULL THEN NULL ELSE round_even((1.0 - ({nz} - min({nz}) OVER ()) / "
            f"(max({nz}) OVER () - min({nz}) OVER ())) * 100.0, 3) END")


_BASE_SQL = f"""
pl AS (SELECT s_suppkey, s_nationkey, s_acctbal, {_LAT.format(k='s_suppkey')} AS lat, {_LNG.format(k='s_suppkey')} AS lng
       FROM supplier),
pt AS (SELECT {_LAT.format(k='c_custkey')} AS p_lat, {_LNG.format(k='c_custkey')} AS p_lng, c_acctbal + 1000 AS w FROM customer),
pairs AS (SELECT pl.s_suppkey, pt.w, {_hav('lat', 'lng', 'p_lat', 'p_lng')} AS d FROM pl CROSS JOIN pt),
rad AS (SELECT * FROM (VALUES (500.0), (1000.0), (2000.0)) AS r(radius_m)),
agg AS (SELECT s_suppkey, radius_m, sum(w) AS ws, sum(w * d) AS wd FROM pairs JOIN rad ON d <= radius_m
        GROUP BY s_suppkey, radius_m),
wdist AS (SELECT p.s_suppkey, CAST(r.radius_m AS INTEGER) AS radius,
            CASE WHEN coalesce(a.ws, 0) > 0 THEN a.wd / a.ws END AS dist
          FROM (SELECT DISTINCT s_suppkey FROM pl) p CROSS JOIN rad r
          LEFT JOIN agg a ON a.s_suppkey = p.s_suppkey AND a.radius_m = r.radius_m),
wide AS (SELECT s_suppkey, {", ".join(f"max(CASE WHEN radius = {r} THEN dist END) AS dist_{r}m" for r in RADII)}
         FROM wdist GROUP BY s_suppkey),
base AS (
  SELECT pl.s_suppkey, n.n_name, pl.s_acctbal, {", ".join(f"w.dist_{r}m" for r in RADII)},
    CASE WHEN pl.s_acctbal >= 0 THEN abs(pl.s_acctbal) % 40 + 3 END AS minutes,
    CASE WHEN pl.s_acctbal > 5000 THEN 'yes' WHEN pl.s_acctbal < 0 THEN 'no' END AS has_text,
    CAST(pl.s_suppkey % 6 AS VARCHAR) AS lots_text, pl.s_acctbal / 10 AS spaces
  FROM pl JOIN nation n ON pl.s_nationkey = n.n_nationkey JOIN wide w ON w.s_suppkey = pl.s_suppkey),
sc AS (
  SELECT *, {", ".join(f"{_sc2(f'dist_{r}m')} AS pop_{r}" for r in RADII)}, {_sc2('minutes')} AS walk_score,
    least(greatest(
      (CASE WHEN has_text = 'no' THEN 0.0 WHEN has_text = 'yes' THEN 20.0 ELSE 10.0 END)
      + (CASE WHEN TRY_CAST(lots_text AS DOUBLE) IS NULL THEN 0.0 ELSE least(greatest(TRY_CAST(lots_text AS DOUBLE), 0.0), 5.0) * 8.0 END)
      + (CASE WHEN spaces IS NULL THEN 0.0 ELSE least(greatest(spaces, 0.0), 1000.0) / 1000.0 * 40.0 END), 0.0), 100.0)
      AS parking_score
  FROM base)
"""


def _access_final_sql(key: str, walk_w: float, park_w: float, pop_w: float, by: str | None) -> str:
    comps = ["walk_score", "parking_score"] + [POP[r] for r in RADII]
    src = "sc"
    pre = ""
    if by:
        pre = (f", g AS (SELECT {by}, {', '.join(f'avg({c}) AS {c}' for c in comps)} FROM sc "
               f"WHERE {by} IS NOT NULL AND {by} <> '' GROUP BY {by})")
        src = "g"
        key = by
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in comps)
    totals = ", ".join(
        f"coalesce({POP[r]}, m_{POP[r]}) * {pop_w} + coalesce(walk_score, m_walk_score) * {walk_w} + "
        f"coalesce(parking_score, m_parking_score) * {park_w} AS total_{r}m" for r in RADII)
    phi = normal_cdf_sql("((total - mu) / sd * 1.0)")
    return f"""WITH {_BASE_SQL}{pre},
m AS (SELECT {med} FROM {src}),
t AS (SELECT {src}.*, {totals} FROM {src} CROSS JOIN m),
o AS (SELECT *, {Q.row_weighted_mean({f'total_{r}m': w for r, w in zip(RADII, [0.6, 0.3, 0.1])})} AS total FROM t),
s AS (SELECT *, avg(total) OVER () AS mu, stddev_pop(total) OVER () AS sd, count(total) OVER () AS nv FROM o),
f AS (SELECT *, CASE WHEN nv = 0 OR sd IS NULL OR sd = 0 THEN 50.0
                     ELSE 0.5 + {Q.clip(phi, 0.5 / 100.0, 1.0 - 0.5 / 100.0)} * (100.0 - 2.0 * 0.5) END AS total_100 FROM s)
SELECT {key}, {", ".join(f"total_{r}m" for r in RADII)}, total, total_100,
  CAST(CASE WHEN total_100 IS NULL THEN NULL ELSE rank() OVER (ORDER BY total_100 DESC NULLS LAST) END AS BIGINT) AS rank
FROM f"""


_FINAL_DOUBLES = [f"total_{r}m" for r in RADII] + ["total", "total_100"]


@query("access_score", _access_final_sql("s_suppkey", 1.0, 1.5, 0.5, None), doubles=_FINAL_DOUBLES, digits=6)
def access_score(spark, sf):
    """CI6 per place: weights walk 1.0 / parking 1.5 / population 0.5, radius weights
    .6/.3/.1, z-CDF with margin, competition rank."""
    b = access_base(spark, sf)
    res = access_final(b, "s_suppkey", POP, "walk_score", "parking_score", 1.0, 1.5, 0.5)
    return res.select("s_suppkey", *[f"total_{r}m" for r in RADII], "total", "total_100", "rank")


@query("access_district", _access_final_sql("n_name", 0.6, 0.2, 0.2, "n_name"), doubles=_FINAL_DOUBLES, digits=6)
def access_district(spark, sf):
    """CI6 per district: components averaged by district first, weights .6/.2/.2."""
    b = access_base(spark, sf)
    res = access_final(b, "s_suppkey", POP, "walk_score", "parking_score", 0.6, 0.2, 0.2, by="n_name")
    return res.select("n_name", *[f"total_{r}m" for r in RADII], "total", "total_100", "rank")


def _pop_sql(region: bool) -> str:
    wm = Q.row_weighted_mean({POP[r]: w for r, w in zip(RADII, [0.6, 0.3, 0.1])})
    phi = normal_cdf_sql("((pw - mu) / sd)")
    core = f"""WITH {_BASE_SQL},
a AS (SELECT s_suppkey, n_name, {wm} AS pw0 FROM sc),
b AS (SELECT *, coalesce(pw0, coalesce(min(pw0) OVER (), 0.0) * 0.5) AS pw FROM a),
s AS (SELECT *, avg(pw) OVER () AS mu, stddev_pop(pw) OVER () AS sd FROM b),
z AS (SELECT *, CASE WHEN sd IS NULL OR sd = 0 THEN 50.0 ELSE {phi} * 100.0 END AS pop_weighted_std FROM s)"""
    if not region:
        return core + """
SELECT s_suppkey, pw AS pop_weighted, pop_weighted_std,
  CAST(row_number() OVER (ORDER BY pop_weighted_std DESC NULLS LAST, s_suppkey) AS BIGINT) AS rank_pop FROM z"""
    return core + """,
d AS (SELECT n_name, avg(pop_weighted_std) AS pop_weighted_std_mean FROM z WHERE n_name IS NOT NULL GROUP BY n_name)
SELECT n_name, pop_weighted_std_mean,
  CAST(row_number() OVER (ORDER BY pop_weighted_std_mean DESC NULLS LAST, n_name) AS BIGINT) AS rank_pop_region FROM d"""


@query("population_score", _pop_sql(False), doubles=["pop_weighted", "pop_weighted_std"], digits=6)
def population_score_q(spark, sf):
    """CI7 per place: radius-weighted population score, half-minimum fill, z-CDF, sequential rank."""
    b = access_base(spark, sf)
    s, _ = population_score(b, "s_suppkey", POP)
    return s.select("s_suppkey", "pop_weighted", "pop_weighted_std", "rank_pop")


@query("population_region", _pop_sql(True), doubles=["pop_weighted_std_mean"], digits=6)
def population_region(spark, sf):
    """CI7 per region: mean standardised population score and its sequential rank."""
    b = access_base(spark, sf)
    _, d = population_score(b, "s_suppkey", POP, region="n_name")
    return d


def _region_scores_sql() -> str:
    comps = ["walk_score", "parking_score"] + [POP[r] for r in RADII]
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in comps)
    totals = ", ".join(
        f"coalesce({POP[r]}, coalesce(m_{POP[r]}, 0.0)) * 0.2 + coalesce(walk_score, coalesce(m_walk_score, 0.0)) * 0.6 + "
        f"coalesce(parking_score, coalesce(m_parking_score, 0.0)) * 0.2 AS total_{r}m" for r in RADII)
    aggs = ["avg(walk_score) AS walk_score_mean", "avg(parking_score) AS parking_score_mean"]
    for r in RADII:
        aggs += [f"avg(total_{r}m) AS total_{r}m_mean", f"max(total_{r}m) AS total_{r}m_max"]
    ranks = []
    for r in RADII:
        for k in ("mean", "max"):
            c = f"total_{r}m_{k}"
            ranks.append(f"CAST(CASE WHEN {c} IS NULL THEN NULL ELSE rank() OVER (ORDER BY {c} DESC NULLS LAST) END AS BIGINT) AS {c}_rank")
    return f"""WITH {_BASE_SQL},
m AS (SELECT {med} FROM sc),
t AS (SELECT sc.*, {totals} FROM sc CROSS JOIN m),
g AS (SELECT n_name, {", ".join(aggs)} FROM t WHERE n_name IS NOT NULL AND n_name <> '' GROUP BY n_name)
SELECT *, {", ".join(ranks)} FROM g"""


@query("region_scores", _region_scores_sql(),
       doubles=["walk_score_mean", "parking_score_mean"] + [f"total_{r}m_{k}" for r in RADII for k in ("mean", "max")],
       digits=6)
def region_scores_q(spark, sf):
    """CI1 per-radius totals (median fill, 0 when none) then CI5 district means, maxima and ranks."""
    b = access_base(spark, sf)
    b = weighted_composites(b, {f"total_{r}m": {POP[r]: 0.2, "walk_score": 0.6, "parking_score": 0.2} for r in RADII},
                            all_missing=0.0)
    return region_scores(b, "n_name", ["walk_score", "parking_score"], [f"total_{r}m" for r in RADII])
