"""Registered queries: indicators, scalers, ranks and composite indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rowwise import row_mean
from ..operators.agg import group_stats
from ..operators.rank import rank_min
from ..operators.scale import scale, scale_many  # noqa: F401
from ..operators.joins import maybe_broadcast
from ..session import cut_lineage
from . import sqlkit as Q
from .registry import load, query

# ------------------------------------------------------------------ region_indicator

_RI_SQL = f"""
WITH per_cust AS (
  SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey),
g AS (
  SELECT n.n_name, CAST(sum(p.n) AS BIGINT) AS n_orders, sum(p.s) AS total_price,
         sum(p.s) / sum(p.n) AS avg_price
  FROM per_cust p JOIN customer c ON p.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE n.n_name IS NOT NULL
  GROUP BY n.n_name),
s AS (
  SELECT *, {Q.minmax('n_orders', 'n_orders_score')}, {Q.minmax('total_price', 'total_price_score')},
         {Q.minmax('avg_price', 'avg_price_score')} FROM g),
m AS (SELECT *, {Q.row_mean(['n_orders_score', 'total_price_score', 'avg_price_score'])} AS score FROM s)
SELECT *, CAST(CASE WHEN score IS NULL THEN NULL ELSE rank() OVER (ORDER BY score DESC NULLS LAST) END AS BIGINT) AS rank
FROM m
"""


def region_indicator_frame(orders, customer, nation):
    """AG1 → SC1 per indicator → AG11 row mean → WN1 rank, by nation.

    Orders are pre-aggregated per customer before the join (the join then sees
    one row per customer instead of one per order).
    """
    per_cust = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    cn = customer.select("c_custkey", "c_nationkey").join(
        maybe_broadcast(nation.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    j = per_cust.join(cn, per_cust.o_custkey == cn.c_custkey)
    g = group_stats(j, "n_name", n_orders=F.sum("n").cast("long"), total_price=F.sum("s"),
                    avg_price=F.sum("s") / F.sum("n"))
    g = cut_lineage(g)  # entity-level table, reused by every statistic below
    cols = ["n_orders", "total_price", "avg_price"]
    g = scale_many(g, [dict(c=c, out=f"{c}_score", method="minmax", constant=0.0) for c in cols])
    g = g.withColumn("score", row_mean([f"{c}_score" for c in cols]))
    return rank_min(g, "score", "rank")


@query("region_indicator", _RI_SQL,
       doubles={"total_price": 2, "avg_price": 6, "n_orders_score": 6, "total_price_score": 6, "avg_price_score": 6,
                "score": 6})
def region_indicator(spark, sf):
    return region_indicator_frame(load(spark, sf, "orders"), load(spark, sf, "customer"), load(spark, sf, "nation"))


# ------------------------------------------------------------------ scaler families

def _w(over):
    return f"OVER ({over})"


_SMM_SQL = """
WITH s AS (
  SELECT s_suppkey, s_nationkey, s_acctbal,
    CASE WHEN s_nationkey % 5 = 0 THEN 7.0 ELSE s_acctbal END AS flat,
    CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS gap
  FROM supplier),
n AS (SELECT *, CASE WHEN flat <> 0 THEN flat END AS nz FROM s),
a AS (
  SELECT *,
    CASE WHEN flat IS NULL THEN NULL WHEN max(flat) OVER w = min(flat) OVER w THEN 0.0
         ELSE (flat - min(flat) OVER w) / (max(flat) OVER w - min(flat) OVER w) * 100.0 END AS sc1,
    CASE WHEN count(nz) OVER w = 0 THEN 50.0 WHEN max(nz) OVER w = min(nz) OVER w THEN 50.0
         WHEN nz IS NULL THEN NULL
         ELSE round_even((1.0 - (nz - min(nz) OVER w) / (max(nz) OVER w - min(nz) OVER w)) * 100.0, 3) END AS sc2,
    CASE WHEN flat IS NULL THEN NULL WHEN max(flat) OVER w = min(flat) OVER w THEN 0.0
         ELSE (flat - min(flat) OVER w) / (max(flat) OVER w - min(flat) OVER w) * 1.0 END AS sc3,
    CASE WHEN flat IS NULL THEN NULL WHEN stddev_pop(flat) OVER w = 0 OR stddev_pop(flat) OVER w IS NULL THEN 0.0
         ELSE (flat - avg(flat) OVER w) / stddev_pop(flat) OVER w END AS z,
    CASE WHEN gap IS NULL THEN NULL WHEN max(gap) OVER w = min(gap) OVER w THEN 0.0
         ELSE (gap - min(gap) OVER w) / (max(gap) OVER w - min(gap) OVER w) * 100.0 END AS sc5
  FROM n WINDOW w AS (PARTITION BY s_nationkey))
SELECT s_suppkey, s_nationkey, s_acctbal, flat, gap, sc1, sc2, sc3, z, sc5,
  CASE WHEN z IS NULL THEN NULL WHEN max(z) OVER w = min(z) OVER w THEN 0.0
       ELSE (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) * 100.0 END AS sc4
FROM a WINDOW w AS (PARTITION BY s_nationkey)
"""


@query("scale_minmax_variants", _SMM_SQL,
       doubles=["s_acctbal", "flat", "gap", "sc1", "sc2", "sc3", "z", "sc5", "sc4"], digits=5)
def scale_minmax_variants(spark, sf):
    """SC1 min-max 0–100, SC2 reversed/zero-missing/rounded/constant-50, SC3 0–1,
    SC4 z-score then min-max, SC5 with missing values — per nation, one group constant."""
    s = load(spark, sf, "supplier").select(
        "s_suppkey", "s_nationkey", "s_acctbal",
        F.when(F.col("s_nationkey") % 5 == 0, F.lit(7.0)).otherwise(F.col("s_acctbal")).alias("flat"),
        F.when(F.col("s_acctbal") < 0, F.lit(None).cast("double")).otherwise(F.col("s_acctbal")).alias("gap"))
    s = scale_many(s, [
        dict(c="flat", out="sc1", method="minmax", constant=0.0),
        dict(c="flat", out="sc2", method="minmax", reverse=True, zero_missing=True, rounding=3,
             constant=50.0, all_missing=50.0, degenerate_all_rows=True),
        dict(c="flat", out="sc3", method="minmax", top=1.0, constant=0.0),
        dict(c="flat", out="z", method="zscore", constant=0.0),
        dict(c="gap", out="sc5", method="minmax", constant=0.0)], by="s_nationkey")
    return scale(s, "z", "sc4", "minmax", by="s_nationkey", constant=0.0)


def _zcdf_sql():
    phi_z = Q.normal_cdf_sql("z")
    phi_z0 = Q.normal_cdf_sql("z0")
    sc7 = f"round_even(((1.0 - 2.0 * (0.5 / n_rows)) * {Q.clip(phi_z0, 1e-9, 1.0 - 1e-9)} + 0.5 / n_rows) * 100.0, 2)"
    sc8 = f"0.5 + {Q.clip(phi_z, 0.5 / 100.0, 1.0 - 0.5 / 100.0)} * (100.0 - 2.0 * 0.5)"
    return f"""
WITH b AS (
  SELECT c_custkey, c_mktsegment, c_acctbal,
    avg(c_acctbal) OVER w AS mu, stddev_pop(c_acctbal) OVER w AS sd, count(*) OVER w AS n_rows
  FROM customer WINDOW w AS (PARTITION BY c_mktsegment)),
z AS (
  SELECT *, (c_acctbal - mu) / sd AS z,
    CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (c_acctbal - mu) / sd END AS z0,
    (sd IS NULL OR sd = 0) AS degenerate FROM b)
SELECT c_custkey, c_mktsegment,
  CASE WHEN degenerate THEN 50.0 ELSE {phi_z} * 100.0 END AS sc6,
  CASE WHEN c_acctbal IS NULL THEN NULL ELSE {sc7} END AS sc7,
  CASE WHEN degenerate THEN 50.0 ELSE {sc8} END AS sc8
FROM z
"""


@query("scale_zcdf_variants", _zcdf_sql(), doubles=["sc6", "sc7", "sc8"])
def scale_zcdf_variants(spark, sf):
    """SC6 z-CDF, SC7 z-CDF squeezed by group size (rounded 2), SC8 z-CDF with margin — per segment."""
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    s = scale_many(c, [
        dict(c="c_acctbal", out="sc6", method="zcdf", constant=50.0),
        dict(c="c_acctbal", out="sc7", method="zcdf_squeezed", rounding=2, clip_p=1e-9),
        dict(c="c_acctbal", out="sc8", method="zcdf_margin", eps=0.5, constant=50.0, all_missing=50.0,
             degenerate_all_rows=True)], by="c_mktsegment")
    return s.select("c_custkey", "c_mktsegment", "sc6", "sc7", "sc8")


@query("scale_tscore_sigmoid", f"""
WITH t AS (SELECT c_nationkey AS n_nationkey, sum(c_acctbal) AS total FROM customer GROUP BY 1),
s AS (SELECT *, avg(total) OVER () AS mu, stddev_samp(total) OVER () AS sd FROM t),
z AS (SELECT *, CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (total - mu) / sd END AS z FROM s)
SELECT n_nationkey, total,
  CASE WHEN sd IS NULL OR sd = 0 THEN 50.0 ELSE 50.0 + 10.0 * (total - mu) / sd END AS t_score,
  z, 100.0 / (1.0 + exp(-z)) AS sig,
  CASE WHEN mu = 0 THEN 50.0 ELSE {Q.clip('50.0 * total / mu', 0.0, 100.0)} END AS rel,
  total / (100.0 * 10.0) * 100.0 AS pct
FROM z
""", doubles=["total", "t_score", "z", "sig", "rel", "pct"])
def scale_tscore_sigmoid(spark, sf):
    """SC9 T-score, SC10 z + sigmoid (sample σ), SC11 mean-relative, SC12 percent of maximum."""
    from .composite import percent_of_max
    t = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.sum("c_acctbal").alias("total"))
    t = scale_many(t, [
        dict(c="total", out="t_score", method="tscore", ddof=1, constant=50.0, degenerate_all_rows=True),
        dict(c="total", out="sig", method="sigmoid", ddof=1, z_out="z"),
        dict(c="total", out="rel", method="mean_relative", constant=50.0)])
    return t.withColumn("pct", percent_of_max("total", 10.0)).select(
        "n_nationkey", "total", "t_score", "z", "sig", "rel", "pct")


@query("display_scale", """
WITH pc AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
cnt AS (SELECT c.c_nationkey AS nk, CAST(sum(pc.n) AS BIGINT) AS n_orders FROM pc JOIN customer c ON pc.o_custkey = c.c_custkey
        GROUP BY 1),
g AS (SELECT n.n_name, n.n_regionkey, CASE WHEN n.n_nationkey IN (3, 17) THEN NULL ELSE cnt.n_orders END AS n_orders
      FROM nation n LEFT JOIN cnt ON n.n_nationkey = cnt.nk),
nl AS (SELECT 'nation' AS layer, n_name AS name, n_orders FROM g),
rl AS (SELECT 'region' AS layer, r.r_name AS name, CAST(sum(g.n_orders) AS BIGINT) AS n_orders
       FROM g JOIN region r ON g.n_regionkey = r.r_regionkey GROUP BY r.r_name),
u AS (SELECT * FROM nl UNION ALL SELECT * FROM rl),
b AS (SELECT min(ln(greatest(n_orders, 1.0))) AS llo, max(ln(greatest(n_orders, 1.0))) AS lhi,
             min(CAST(n_orders AS DOUBLE)) AS lo, max(CAST(n_orders AS DOUBLE)) AS hi FROM u)
SELECT layer, name, n_orders,
  CASE WHEN n_orders IS NULL THEN NULL WHEN lhi - llo > 0 THEN (ln(greatest(n_orders, 1.0)) - llo) / (lhi - llo) ELSE 0.0 END AS display_log,
  CASE WHEN n_orders IS NULL THEN NULL WHEN hi - lo > 0 THEN (n_orders - lo) / (hi - lo) ELSE 0.0 END AS display_linear,
  n_orders IS NULL AS no_data
FROM u CROSS JOIN b
""", doubles=["display_log", "display_linear"])
def display_scale_q(spark, sf):
    """SC13 shared display scale (log with floor 1, and linear) over a nation and a region layer."""
    from ..operators.scale import display_scale
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = load(spark, sf, "customer")
    cnt = (o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nk"))
           .agg(F.sum("n").cast("long").alias("n_orders")))
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    # two nations are without data, whatever their counts
    g = n.join(cnt, n.n_nationkey == cnt.nk, "left").select(
        "n_name", "n_regionkey", F.when(~F.col("n_nationkey").isin(3, 17), F.col("n_orders")).alias("n_orders"))
    nl = g.select(F.lit("nation").alias("layer"), F.col("n_name").alias("name"), "n_orders")
    rl = (g.join(r, g.n_regionkey == r.r_regionkey)
          .groupBy(F.col("r_name").alias("name")).agg(F.sum("n_orders").cast("long").alias("n_orders"))
          .select(F.lit("region").alias("layer"), "name", "n_orders"))
    a, b = display_scale([nl, rl], "n_orders", out="display_log", log=True)
    a, b = display_scale([a.drop("no_data"), b.drop("no_data")], "n_orders", out="display_linear")
    return a.unionByName(b)


# ------------------------------------------------------------------ ranking

@query("rank_variants", """
SELECT o_orderkey,
  CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST) AS BIGINT) AS rank_in_priority,
  CAST(row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS BIGINT) AS row_rank_global
FROM orders
""")
def rank_variants(spark, sf):
    """WN1 competition rank per group, WN2 global sequential rank with tie-break."""
    from ..operators.rank import row_rank
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ranked = rank_min(o, "o_totalprice", "rank_in_priority", by="o_orderpriority")
    numbered = row_rank(o.select("o_orderkey", "o_totalprice"), "o_totalprice", "row_rank_global", tiebreak="o_orderkey")
    return ranked.join(numbered, "o_orderkey").select("o_orderkey", "rank_in_priority", "row_rank_global")


@query("top_orders", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20
""", doubles=["o_totalprice"])
def top_orders(spark, sf):
    """WN5 multi-key sort and WN6 top-k (a top-20 report)."""
    from ..operators.rank import top_k
    return top_k(load(spark, sf, "orders"), "o_totalprice", 20, tiebreak="o_orderkey").select("o_orderkey", "o_totalprice")


@query("per_key_cap", """
WITH r AS (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, 'cap' AS kind FROM r WHERE rn <= 2
UNION ALL SELECT o_custkey, o_orderkey, 'third' AS kind FROM r WHERE rn = 3
""")
def per_key_cap(spark, sf):
    """WN8 first k per key, WN3 n-th row per group (skew-safe two-level cut)."""
    from ..operators.rank import cap_per_key, nth_per_group
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    order = [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    cap = cap_per_key(o, "o_custkey", order, 2).withColumn("kind", F.lit("cap"))
    third = nth_per_group(o, "o_custkey", order, 3).withColumn("kind", F.lit("third"))
    return cap.unionByName(third).select("o_custkey", "o_orderkey", "kind")


# ------------------------------------------------------------------ composites

@query("composite_median", """
WITH a AS (
  SELECT l_suppkey,
    avg(CASE WHEN l_quantity >= 49 AND l_returnflag = 'R' THEN l_extendedprice / 1000.0 END) AS comp_a,
    avg(CASE WHEN l_tax > 0.07 THEN l_discount * 100.0 END) AS comp_b,
    avg(CASE WHEN l_tax > 1 THEN l_tax END) AS comp_c
  FROM lineitem GROUP BY l_suppkey),
f AS (SELECT s.s_suppkey, a.comp_a, a.comp_b, a.comp_c FROM supplier s LEFT JOIN a ON s.s_suppkey = a.l_suppkey),
m AS (SELECT quantile_cont(comp_a, 0.5) AS ma, quantile_cont(comp_b, 0.5) AS mb, quantile_cont(comp_c, 0.5) AS mc FROM f)
SELECT s_suppkey, comp_a, comp_b, comp_c,
  coalesce(comp_a, coalesce(ma, 0.0)) * 0.5 + coalesce(comp_b, coalesce(mb, 0.0)) * 0.3 + coalesce(comp_c, coalesce(mc, 0.0)) * 0.2 AS ci1,
  coalesce(comp_a, ma) * 0.6 + coalesce(comp_b, mb) * 0.4 AS ci2,
  coalesce(comp_a, ma) * 0.5 + coalesce(comp_c, mc) * 0.5 AS ci2_null
FROM f CROSS JOIN m
""", doubles=["comp_a", "comp_b", "comp_c", "ci1", "ci2", "ci2_null"])
def composite_median(spark, sf):
    """CI1 weighted composite with median imputation (0 when no value), CI2 without the
    0 fallback (an all-missing input leaves the total missing)."""
    from .composite import weighted_composites
    li = load(spark, sf, "lineitem")
    a = li.groupBy("l_suppkey").agg(
        F.avg(F.when((F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R"), F.col("l_extendedprice") / 1000.0)).alias("comp_a"),
        F.avg(F.when(F.col("l_tax") > 0.07, F.col("l_discount") * 100.0)).alias("comp_b"),
        F.avg(F.when(F.col("l_tax") > 1, F.col("l_tax"))).alias("comp_c"))
    f = load(spark, sf, "supplier").select("s_suppkey").join(a, F.col("s_suppkey") == F.col("l_suppkey"), "left").drop("l_suppkey")
    f = cut_lineage(f)
    return weighted_composites(f, {"ci1": {"comp_a": 0.5, "comp_b": 0.3, "comp_c": 0.2}, "ci2": {"comp_a": 0.6, "comp_b": 0.4},
                                   "ci2_null": {"comp_a": 0.5, "comp_c": 0.5}}, all_missing={"ci1": 0.0, "ci2": None, "ci2_null": None})


_FPT_SQL = """
WITH lei AS (SELECT c_nationkey AS n_nationkey, avg(c_acctbal) / 100.0 AS LEI_score FROM customer GROUP BY 1),
acc AS (SELECT s_nationkey AS n_nationkey, avg(CASE WHEN s_acctbal > 2000 THEN s_acctbal END) / 100.0 AS ACC_score FROM supplier GROUP BY 1),
saf AS (SELECT c.c_nationkey AS n_nationkey, sum(CASE WHEN c.c_acctbal > 3000 THEN o.n END) / 10.0 AS SAF_score
        FROM (SELECT o_custkey, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS n FROM orders GROUP BY 1) o
        JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1),
nat AS (SELECT c_nationkey AS n_nationkey, CAST(count(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 END) AS DOUBLE) AS NAT_score
        FROM customer GROUP BY 1),
j AS (SELECT n_nationkey, coalesce(LEI_score, 0.0) AS LEI_score, coalesce(ACC_score, 0.0) AS ACC_score,
             coalesce(SAF_score, 0.0) AS SAF_score, coalesce(NAT_score, 0.0) AS NAT_score
      FROM lei FULL JOIN acc USING (n_nationkey) FULL JOIN saf USING (n_nationkey) FULL JOIN nat USING (n_nationkey)),
r AS (SELECT *, LEI_score * 2.0 + ACC_score * 2.0 + SAF_score * 3.0 + NAT_score * 3.0 AS raw_total FROM j),
s AS (SELECT *, avg(raw_total) OVER () AS mu, stddev_samp(raw_total) OVER () AS sd FROM r),
z AS (SELECT *, CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (raw_total - mu) / sd END AS z_score FROM s)
SELECT n_nationkey, LEI_score, ACC_score, SAF_score, NAT_score, raw_total,
  raw_total / (100.0 * 10.0) * 100.0 AS score_theoretical, z_score, 100.0 / (1.0 + exp(-z_score)) AS score_z_transformed
FROM z
"""


@query("four_pillar_total", _FPT_SQL,
       doubles=["LEI_score", "ACC_score", "SAF_score", "NAT_score", "raw_total", "score_theoretical", "z_score",
                "score_z_transformed"])
def four_pillar_total(spark, sf):
    """CI18: four pillar scores outer-joined (missing → 0), weights 2:2:3:3, percent of
    the theoretical maximum, z (sample σ) and sigmoid."""
    from .composite import overall_score
    c, s = load(spark, sf, "customer"), load(spark, sf, "supplier")
    lei = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.avg("c_acctbal") / 100.0).alias("LEI_score"))
    acc = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        (F.avg(F.when(F.col("s_acctbal") > 2000, F.col("s_acctbal"))) / 100.0).alias("ACC_score"))
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n"))
    saf = (o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("n_nationkey"))
           .agg((F.sum(F.when(F.col("c_acctbal") > 3000, F.col("n"))) / 10.0).alias("SAF_score")))
    nat = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count_if(F.col("c_mktsegment") == "AUTOMOBILE").cast("double").alias("NAT_score"))
    res = overall_score({"LEI": lei, "ACC": acc, "SAF": saf, "NAT": nat}, "n_nationkey")
    return res.select("n_nationkey", "LEI_score", "ACC_score", "SAF_score", "NAT_score", "raw_total",
                      "score_theoretical", "z_score", "score_z_transformed")
