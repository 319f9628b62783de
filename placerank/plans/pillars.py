"""Registered queries: safety, leisure and nature pillars, and the remaining
composite helpers, on nation/customer/supplier/orders/documents tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.agg import richness_score, run_metrics, share
from ..operators.scale import scale_many
from ..session import cut_lineage
from . import sqlkit as Q
from .composite import (crime_score, disaster_score, equal_subindex, fire_score, leisure_total,
                        medical_score, nature_score, representative_minutes, rest_score, safety_index,
                        traffic_score)
from .registry import load, query

# ------------------------------------------------------------------ safety index (CI8–CI14)


def nation_metrics(spark, sf):
    """One row per nation with the raw counts and balances every sub-pillar uses."""
    c = load(spark, sf, "customer")
    cust = c.groupBy(F.col("c_nationkey").alias("nk")).agg(
        F.count(F.lit(1)).alias("n_cust"), F.avg("c_acctbal").alias("bal_avg"), F.max("c_acctbal").alias("bal_max"),
        F.sum(F.when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0)).alias("n_mach"),
        share(F.col("c_mktsegment") == "MACHINERY").alias("share_mach"))
    s = load(spark, sf, "supplier")
    supp = s.groupBy(F.col("s_nationkey").alias("nk")).agg(
        F.count(F.lit(1)).alias("n_supp"), F.avg("s_acctbal").alias("s_avg"), F.max("s_acctbal").alias("s_max"),
        F.min("s_acctbal").alias("s_min"), F.sum(F.when(F.col("s_acctbal") > 0, 1).otherwise(0)).alias("s_pos"))
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"),
        F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("op"),
        F.sum("o_totalprice").alias("tp"), F.count(F.lit(1)).alias("n"))
    ords = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nk")).agg(
        F.sum("f").alias("n_f"), F.sum("op").alias("n_o"), (F.sum("tp") / F.sum("n")).alias("o_avg"))
    return cust.join(supp, "nk", "full").join(ords, "nk", "full")


_NATION_SQL = """
cust AS (SELECT c_nationkey AS nk, count(*) AS n_cust, avg(c_acctbal) AS bal_avg, max(c_acctbal) AS bal_max,
                sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) AS n_mach,
                avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END) AS share_mach FROM customer GROUP BY 1),
supp AS (SELECT s_nationkey AS nk, count(*) AS n_supp, avg(s_acctbal) AS s_avg, max(s_acctbal) AS s_max,
                min(s_acctbal) AS s_min, sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) AS s_pos FROM supplier GROUP BY 1),
po AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f,
              sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS op, sum(o_totalprice) AS tp, count(*) AS n
       FROM orders GROUP BY 1),
ords AS (SELECT c.c_nationkey AS nk, sum(f) AS n_f, sum(op) AS n_o, sum(tp) / sum(n) AS o_avg
         FROM po JOIN customer c ON po.o_custkey = c.c_custkey GROUP BY 1),
nm AS (SELECT * FROM cust FULL JOIN supp USING (nk) FULL JOIN ords USING (nk))
"""

# sub-pillar → (row filter, {component: (column, method)}, combining expression over components)
_PILLARS = {
    "CRI": ("bal_avg > 4000", {"occ": "n_f", "arr": "n_o", "cctv": "n_cust"}),
    "DRM": ("s_avg IS NOT NULL", {"p1": "n_supp", "p2": "s_avg", "q1": "s_max", "q2": "s_min", "q3": "s_pos",
                                  "q4": "s_avg"}),
    "FIR": ("share_mach > 0.15", {"cnt": "n_mach", "shr": "share_mach"}),
    "MED": ("n_cust > 0", {"inst": "bal_avg", "pharm": "bal_avg", "phc": "bal_max"}),
    "RST": ("bal_max > 9000", {"cl": "n_cust", "co": "bal_avg", "he": "n_mach", "li": "bal_max"}),
    "TRA": ("o_avg IS NOT NULL", {"si": "o_avg", "ac": "n_f", "cg": "n_o"}),
}


def _pillar_frame(nm, name):
    cond, comps = _PILLARS[name]
    sub = nm.filter(F.expr(cond))
    specs = []
    for comp, col in comps.items():
        method = "mean_relative" if (name, comp) == ("MED", "pharm") else "minmax"
        specs.append(dict(c=col, out=comp, method=method, constant=50.0 if method == "mean_relative" else 0.0))
    s = scale_many(sub, specs)
    cc = {k: F.col(k) for k in comps}
    expr = {
        "CRI": lambda: crime_score(cc["occ"], cc["arr"], cc["cctv"]),
        "DRM": lambda: disaster_score([cc["p1"], cc["p2"]], [cc["q1"], cc["q2"], cc["q3"], cc["q4"]]),
        "FIR": lambda: fire_score(cc["cnt"], cc["shr"]),
        "MED": lambda: medical_score(cc["inst"], cc["pharm"], cc["phc"]),
        "RST": lambda: rest_score(cc["cl"], cc["co"], cc["he"], cc["li"]),
        "TRA": lambda: traffic_score(cc["si"], cc["ac"], cc["cg"]),
    }[name]()
    return s.select(F.col("nk").alias("n_nationkey"), expr.alias(f"{name}_score"))


def _pillar_sql(name):
    cond, comps = _PILLARS[name]
    cols = []
    for comp, col in comps.items():
        if (name, comp) == ("MED", "pharm"):
            cols.append(f"CASE WHEN avg({col}) OVER () = 0 THEN 50.0 ELSE "
                        f"{Q.clip(f'50.0 * {col} / avg({col}) OVER ()', 0.0, 100.0)} END AS {comp}")
        else:
            cols.append(Q.minmax(col, comp))
    expr = {
        "CRI": "0.7 * ((occ + arr) / 2) + 0.3 * cctv",
        "DRM": "0.5 * ((p1 + p2) / 2) + 0.5 * ((q1 + q2 + q3 + q4) / 4)",
        "FIR": Q.row_mean(["cnt", "shr"]),
        "MED": "0.5 * inst + 0.25 * pharm + 0.25 * phc",
        "RST": "0.4 * cl + 0.4 * co + 0.1 * he + 0.1 * li",
        "TRA": "0.6 * si + 0.3 * ac + 0.1 * cg",
    }[name]
    return (f"{name}_c AS (SELECT nk, {', '.join(cols)} FROM nm WHERE {cond}),\n"
            f"{name}_p AS (SELECT nk AS n_nationkey, {expr} AS {name}_score FROM {name}_c),\n"
            f"{name}_m AS (SELECT quantile_cont({name}_score, 0.5) AS med FROM {name}_p),\n"
            f"{name}_d AS (SELECT n_nationkey, coalesce({name}_score, med) AS {name}_score FROM "
            f"(SELECT DISTINCT n_nationkey FROM nation) FULL JOIN {name}_p USING (n_nationkey) CROSS JOIN {name}_m)")


_W = {"CRI": 0.2, "DRM": 0.25, "TRA": 0.25, "FIR": 0.1, "MED": 0.1, "RST": 0.1}
_NAMES = list(_PILLARS)
_SAFETY_SQL = (
    "WITH " + _NATION_SQL + ",\n" + ",\n".join(_pillar_sql(p) for p in _NAMES)
    + "\nSELECT n_nationkey, " + ", ".join(f"{p}_score" for p in _NAMES) + ", "
    + " + ".join(f"{_W[p]} * {p}_score" for p in _NAMES) + " AS safety_score\n"
    + f"FROM {_NAMES[0]}_d" + "".join(f" JOIN {p}_d USING (n_nationkey)" for p in _NAMES[1:]))


@query("safety_style_index", _SAFETY_SQL, doubles=[f"{p}_score" for p in _PILLARS] + ["safety_score"])
def safety_style_index(spark, sf):
    """CI8–CI13 sub-pillars from scaled components over their own nation subsets, JN7
    domain completion with the median, CI14 weighted safety total."""
    nm = cut_lineage(nation_metrics(spark, sf))
    pillars = {p: _pillar_frame(nm, p) for p in _PILLARS}
    res = safety_index(pillars, "n_nationkey", load(spark, sf, "nation").select("n_nationkey"))
    return res.select("n_nationkey", *[f"{p}_score" for p in _PILLARS], "safety_score")


# ------------------------------------------------------------------ CI3

@query("representative_minutes", f"""
WITH u AS (
  SELECT user_id,
    avg(CASE WHEN event_type = 'purchase' AND value > 50 THEN value END) AS final_min,
    avg(CASE WHEN event_type = 'click' AND value > 20 THEN value END) AS sub_median,
    max(CASE WHEN event_type = 'click' THEN value END) AS sub_mean,
    avg(CASE WHEN event_type = 'view' AND value < 30 THEN value END) AS bus_median
  FROM events GROUP BY user_id)
SELECT user_id, final_min, sub_median, sub_mean, bus_median,
  coalesce(final_min, {Q.row_mean(['coalesce(sub_median, sub_mean)', 'bus_median'])}) AS final_walk_min
FROM u
""", doubles=["final_min", "sub_median", "sub_mean", "bus_median", "final_walk_min"])
def representative_minutes_q(spark, sf):
    """CI3: final value, else the mean of the per-mode representatives (key priority)."""
    e = load(spark, sf, "events")
    u = e.groupBy("user_id").agg(
        F.avg(F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), F.col("value"))).alias("final_min"),
        F.avg(F.when((F.col("event_type") == "click") & (F.col("value") > 20), F.col("value"))).alias("sub_median"),
        F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("sub_mean"),
        F.avg(F.when((F.col("event_type") == "view") & (F.col("value") < 30), F.col("value"))).alias("bus_median"))
    return representative_minutes(u, "final_min", [["sub_median", "sub_mean"], ["bus_median"]])


# ------------------------------------------------------------------ CI15 / CI16

@query("equal_subindex", """
WITH c AS (SELECT c_nationkey AS nk, count(*) AS m_cust, avg(c_acctbal) AS m_bal FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS nk, count(*) AS m_supp FROM supplier GROUP BY 1),
j AS (SELECT * FROM c JOIN s USING (nk))
SELECT nk, m_cust, m_bal, m_supp,
  (CASE WHEN max(m_cust) OVER () = min(m_cust) OVER () THEN 0.0 ELSE (m_cust - min(m_cust) OVER ()) / (max(m_cust) OVER () - min(m_cust) OVER ()) END
 + CASE WHEN max(m_bal) OVER () = min(m_bal) OVER () THEN 0.0 ELSE (m_bal - min(m_bal) OVER ()) / (max(m_bal) OVER () - min(m_bal) OVER ()) END
 + CASE WHEN max(m_supp) OVER () = min(m_supp) OVER () THEN 0.0 ELSE (m_supp - min(m_supp) OVER ()) / (max(m_supp) OVER () - min(m_supp) OVER ()) END
  ) / 3 AS subindex
FROM j
""", doubles=["m_bal", "subindex"])
def equal_subindex_q(spark, sf):
    """CI15: metrics with a common prefix scaled 0–1 and averaged with equal weight."""
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nk")).agg(
        F.count(F.lit(1)).alias("m_cust"), F.avg("c_acctbal").alias("m_bal"))
    s = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("m_supp"))
    return equal_subindex(c.join(s, "nk"), "m_", "subindex")


@query("leisure_total", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL
           GROUP BY 1, 2),
fest AS (SELECT user_id AS uid, sum(n) * (1 + ln(sum(n)) - sum(n * ln(n)) / sum(n)) AS fest_score FROM c GROUP BY 1),
sport AS (SELECT o_custkey AS uid, CAST(count(DISTINCT o_orderpriority) AS DOUBLE) * (1 + ln(count(DISTINCT o_orderpriority)))
                 AS sport_score FROM orders GROUP BY 1),
j AS (SELECT uid, coalesce(fest_score, 0.0) AS fest_score, coalesce(sport_score, 0.0) AS sport_score
      FROM fest FULL JOIN sport USING (uid)),
s AS (SELECT *, avg(fest_score) OVER () AS fm, stddev_samp(fest_score) OVER () AS fs,
             avg(sport_score) OVER () AS sm, stddev_samp(sport_score) OVER () AS ss FROM j),
t AS (SELECT uid, fest_score, sport_score,
        CASE WHEN fs IS NULL OR fs = 0 THEN 50.0 ELSE 50.0 + 10.0 * (fest_score - fm) / fs END AS fest_score_t,
        CASE WHEN ss IS NULL OR ss = 0 THEN 50.0 ELSE 50.0 + 10.0 * (sport_score - sm) / ss END AS sport_score_t FROM s)
SELECT *, 0.5 * fest_score_t + 0.5 * sport_score_t AS leisure_score FROM t
""", doubles=["fest_score", "sport_score", "fest_score_t", "sport_score_t", "leisure_score"])
def leisure_total_q(spark, sf):
    """AG6 richness on two sources (events by user; distinct order priorities by customer),
    CI16 outer join, T-scores, equal weights."""
    e = load(spark, sf, "events")
    fest = richness_score(e, "user_id", "event_type", out="fest_score").select(F.col("user_id").alias("uid"), "fest_score")
    o = load(spark, sf, "orders")
    sport = richness_score(o, "o_custkey", "o_orderpriority", distinct=True, out="sport_score").select(
        F.col("o_custkey").alias("uid"), F.col("sport_score").cast("double"))
    return leisure_total(fest, sport, "uid", "fest_score", "sport_score")


# ------------------------------------------------------------------ CI17

_ECO = ["the", "und", "que"]


@query("nature_score", f"""
WITH d AS (
  SELECT d.source, CASE WHEN l.quality = 1 THEN 0.9 ELSE 0.4 END AS conf, d.n_chars / 1000.0 AS size,
         d.text AS name
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT source, coalesce(sum(conf * size), 0.0) AS eco_score,
             sum(CASE WHEN len(regexp_extract_all(coalesce(name, ''), 'the|und|que')) = 0 THEN 0.1
                      ELSE CAST(len(regexp_extract_all(coalesce(name, ''), 'the|und|que')) AS DOUBLE) END) AS topic_weight
      FROM d GROUP BY source),
s AS (SELECT *, avg(eco_score) OVER () AS mu, stddev_pop(eco_score) OVER () AS sd FROM g)
SELECT source, eco_score, topic_weight,
  CASE WHEN sd IS NULL OR sd = 0 THEN 50.0 ELSE {Q.normal_cdf_sql('(eco_score - mu) / sd')} * 100.0 END AS eco_score_std,
  CAST(row_number() OVER (ORDER BY eco_score DESC NULLS LAST, source) AS BIGINT) AS rank
FROM s
""", doubles=["eco_score", "topic_weight", "eco_score_std"])
def nature_score_q(spark, sf):
    """CI17: Σ confidence × size per place, keyword weight reported, z-CDF, sequential rank."""
    d = load(spark, sf, "documents")
    lab = load(spark, sf, "labels")
    t = d.join(lab, "doc_id").select(
        "source", F.when(F.col("quality") == 1, 0.9).otherwise(0.4).alias("conf"),
        (F.col("n_chars") / 1000.0).alias("size"), F.col("text").alias("name"))
    return nature_score(t, "source", "conf", "size", name="name", keywords=_ECO)


# ------------------------------------------------------------------ AG18

@query("metric_registry", """
WITH sup AS (SELECT s_nationkey AS nk, count(CASE WHEN s_acctbal > 0 THEN 1 END) AS n_suppliers FROM supplier GROUP BY 1),
cus AS (SELECT c_nationkey AS nk, avg(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_acctbal END) AS avg_balance
        FROM customer GROUP BY 1),
ord AS (SELECT c.c_nationkey AS nk, CAST(sum(o.n) AS BIGINT) AS n_orders
        FROM (SELECT o_custkey, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS n FROM orders GROUP BY 1) o
        JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1)
SELECT nk, coalesce(n_suppliers, 0) AS n_suppliers, coalesce(avg_balance, 0.0) AS avg_balance,
       coalesce(n_orders, 0) AS n_orders
FROM sup FULL JOIN cus USING (nk) FULL JOIN ord USING (nk)
""", doubles=["avg_balance"])
def metric_registry(spark, sf):
    """AG18: dataset code → metric function; all present datasets run and outer-joined (fill 0)."""
    registry = {}

    def register(code):
        def deco(fn):
            registry[code] = fn
            return fn
        return deco

    @register("SUP")
    def _sup(df):
        return df.groupBy(F.col("s_nationkey").alias("nk")).agg(
            F.count_if(F.col("s_acctbal") > 0).alias("n_suppliers"))

    @register("CUS")
    def _cus(df):
        return df.groupBy(F.col("c_nationkey").alias("nk")).agg(
            F.avg(F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.col("c_acctbal"))).alias("avg_balance"))

    c = load(spark, sf, "customer")

    @register("ORD")
    def _ord(df):
        o = df.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"))
        return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nk")).agg(
            F.sum("n").cast("long").alias("n_orders"))

    datasets = {"SUP": load(spark, sf, "supplier"), "CUS": c, "ORD": load(spark, sf, "orders")}
    return run_metrics(datasets, "nk", fill=0, registry=registry)


# ------------------------------------------------------------------ RS4 / RS7

_FLAGS = ["A", "N", "R", "X", "Y"]


@query("wide_summary", """
WITH g AS (SELECT l_returnflag AS flag, year(l_shipdate) AS yr, sum(l_quantity) AS qty, avg(l_extendedprice) AS price
           FROM lineitem GROUP BY 1, 2),
r AS (SELECT * FROM g WHERE flag <> 'A' OR flag IS NULL
      UNION ALL SELECT t.flag, g.yr, g.qty, g.price FROM g CROSS JOIN (VALUES ('A'), ('X'), ('Y')) AS t(flag) WHERE g.flag = 'A')
SELECT yr, """ + ", ".join(f"max(CASE WHEN flag = '{f}' THEN qty END) AS qty_{f}, max(CASE WHEN flag = '{f}' THEN price END) AS price_{f}"
                           for f in _FLAGS) + """
FROM r GROUP BY yr
""", doubles=[f"{m}_{f}" for f in _FLAGS for m in ("qty", "price")], digits=4)
def wide_summary_q(spark, sf):
    """RS7 copy group 'A' to groups X and Y; RS4 per-flag tables side by side by year."""
    from ..operators.reshape import replicate_group, wide_summary
    li = load(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").cast("long").alias("yr")).agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"))
    g = replicate_group(g, "flag", "A", ["A", "X", "Y"])
    return wide_summary(g, "yr", "flag", _FLAGS, ["qty", "price"], fmt="{m}_{v}")


# ------------------------------------------------------------------ CI19

_EN_TO_LOCAL = {"AFRICA": "아프리카", "AMERICA": "아메리카", "ASIA": "아시아", "EUROPE": "유럽"}


@query("map_layer", """
WITH s AS (SELECT r.r_name AS region_name, avg(c.c_acctbal) AS score
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
           GROUP BY r.r_name),
t AS (SELECT CASE region_name """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EN_TO_LOCAL.items()) + """ END AS name_local,
             score FROM s),
dim AS (SELECT r_regionkey, CASE r_name """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EN_TO_LOCAL.items()) + """ ELSE r_name END AS name_local
        FROM region),
j AS (SELECT dim.r_regionkey, dim.name_local, t.score FROM dim LEFT JOIN t USING (name_local)),
b AS (SELECT min(score) AS lo, max(score) AS hi FROM j)
SELECT r_regionkey, name_local, score,
  CASE WHEN score IS NULL THEN NULL WHEN hi - lo > 0 THEN (score - lo) / (hi - lo) ELSE 0.0 END AS display_value,
  score IS NULL AS no_data
FROM j CROSS JOIN b
""", doubles=["score", "display_value"])
def map_layer_q(spark, sf):
    """CI19: boundary attributes (regions, local names) left-joined with scores whose
    English keys are translated (unmapped → missing), plus the shared display value."""
    from ..functions.text import apply_map
    from .composite import map_layer
    c, n, r = load(spark, sf, "customer"), load(spark, sf, "nation"), load(spark, sf, "region")
    scores = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
              .groupBy(F.col("r_name").alias("name_local")).agg(F.avg("c_acctbal").alias("score")))
    dim = r.select("r_regionkey", apply_map("r_name", _EN_TO_LOCAL).alias("name_local"))
    return map_layer(dim, scores, "name_local", "name_local", "score", name_map=_EN_TO_LOCAL)
