"""Registered queries: cleaning, joins, aggregations and reshaping on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import step_score, to_bool, to_number, zero_to_null
from ..functions.rowwise import row_weighted_mean
from ..functions.text import contains_any, match_dictionary, prefix_key, extract_region
from ..operators.agg import (ensure_min_members, explode_sum, fill_half_min, profile, richness_score,
                             select_top_quantile, share)
from ..operators.clean import assign_cyclic, exclude_keywords, split_cohort
from ..operators.joins import (append_missing, bridge_mean, coalesce_from, complete_domain, cross_terms,
                               join_all, resolve_alias, weighted_distance)
from ..operators.reshape import explode_delimited, pivot_wide
from ..session import cut_lineage
from .composite import parking_score
from .registry import load, query

# ------------------------------------------------------------------ clean_numbers

@query("clean_numbers", """
SELECT event_id,
  TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) AS k_num,
  TRY_CAST(regexp_replace(trim(concat(CAST(user_id AS VARCHAR), ',', lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0'))),
           '[,]', '', 'g') AS DOUBLE) AS amount,
  coalesce(TRY_CAST(CASE WHEN trim(code_text) = '-' THEN '0' ELSE trim(code_text) END AS DOUBLE), 0.0) AS code_num,
  CASE WHEN TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) % 10 <> 0
       THEN TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) % 10 END AS k_mod
FROM (SELECT *, CASE WHEN event_type = 'error' THEN '-' WHEN event_type = 'signup' THEN NULL
                     ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS code_text FROM events)
""", doubles=["k_num", "amount", "code_num", "k_mod"])
def clean_numbers(spark, sf):
    """PR1 to_number, PR2 comma strip / dash → 0 / fill 0, PR5 zero → missing."""
    e = load(spark, sf, "events")
    k = to_number(F.get_json_object("props", "$.k"))
    amount_text = F.concat(F.col("user_id").cast("string"), F.lit(","),
                           F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    code_text = (F.when(F.col("event_type") == "error", F.lit("-"))
                 .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
                 .otherwise(F.floor("value").cast("long").cast("string")))
    return e.select("event_id", k.alias("k_num"), to_number(amount_text, strip=",").alias("amount"),
                    to_number(code_text, dash_zero=True, fill=0.0).alias("code_num"),
                    zero_to_null(k % 10).alias("k_mod"))


# ------------------------------------------------------------------ tri_state_score

_HAS = ["yes", "no", None, "있음", "false", "maybe", "1", "Y"]


def _sql_list(xs):
    return "[" + ", ".join("NULL" if x is None else "'" + x + "'" for x in xs) + "]"


@query("tri_state_score", f"""
WITH p AS (
  SELECT p_partkey, p_size, p_retailprice,
    list_extract({_sql_list(_HAS)}, p_size % 8 + 1) AS has_text,
    CASE WHEN p_size % 11 = 0 THEN '' ELSE CAST(p_size % 7 AS VARCHAR) END AS lots_text,
    CASE WHEN p_partkey % 5 = 0 THEN 'true' ELSE 'no' END AS acc_text,
    CASE WHEN p_partkey % 3 = 0 THEN 'enabled' END AS ext_text,
    CASE WHEN instr(p_name, 'red') > 0 THEN 'about 20' ELSE '' END AS notes_text
  FROM part),
f AS (
  SELECT *,
    CASE WHEN lower(trim(has_text)) IN ('true','1','y','yes','있음') THEN true
         WHEN lower(trim(has_text)) IN ('false','0','n','no','없음') THEN false END AS flag,
    coalesce(lower(trim(ext_text)) IN ('true','1','y','yes','t','가능','있음','enable','enabled'), false) AS ext,
    coalesce(lower(trim(acc_text)) IN ('true','1','y','yes','t','가능','있음','enable','enabled'), false) AS acc,
    TRY_CAST(trim(lots_text) AS DOUBLE) AS lv, TRY_CAST(trim(CAST(p_retailprice AS VARCHAR)) AS DOUBLE) AS sv
  FROM p),
s AS (
  SELECT *,
    (CASE WHEN flag = false THEN (CASE WHEN ext THEN 20.0 ELSE 0.0 END) WHEN flag = true THEN 20.0 ELSE 10.0 END)
    + (CASE WHEN lv IS NULL THEN 0.0 ELSE least(greatest(lv, 0.0), 5.0) * 8.0 END)
    + (CASE WHEN sv IS NULL THEN 0.0 ELSE least(greatest(sv, 0.0), 1000.0) / 1000.0 * 40.0 END) AS raw
  FROM f),
t AS (
  SELECT *, CASE WHEN acc THEN least(raw, 40.0) ELSE raw END AS capped FROM s)
SELECT p_partkey,
  coalesce(lower(trim(has_text)) IN ('true','1','y','yes','t','가능','있음','enable','enabled'), false) AS has_bool,
  CASE WHEN p_size % 5 >= 3 THEN 100.0 WHEN p_size % 5 >= 2 THEN 70.0 WHEN p_size % 5 >= 1 THEN 40.0 ELSE 0.0 END
    AS step_points,
  least(greatest(CASE WHEN instr(notes_text, 'about') > 0 OR instr(notes_text, 'approximately') > 0
                      OR instr(notes_text, '약') > 0 OR instr(notes_text, '이상') > 0
                      OR instr(notes_text, '잘모르겠') > 0 OR instr(notes_text, '추정') > 0
                 THEN capped * 0.9 ELSE capped END, 0.0), 100.0) AS parking_score
FROM t
""", doubles=["step_points", "parking_score"])
def tri_state_score(spark, sf):
    """PR3 textual boolean, PR14 step points, CI4 parking rule score over derived part fields."""
    p = load(spark, sf, "part")
    has_arr = F.array(*[F.lit(x).cast("string") for x in _HAS])
    d = p.select(
        "p_partkey", "p_size", "p_retailprice",
        F.element_at(has_arr, (F.col("p_size") % 8 + 1).cast("int")).alias("has_text"),
        F.when(F.col("p_size") % 11 == 0, F.lit("")).otherwise((F.col("p_size") % 7).cast("string")).alias("lots_text"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("true")).otherwise(F.lit("no")).alias("acc_text"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("enabled")).alias("ext_text"),
        F.when(F.instr("p_name", "red") > 0, F.array(F.lit("about 20")))
         .otherwise(F.array().cast("array<string>")).alias("notes"))
    d = parking_score(d, "has_text", "lots_text", "p_retailprice", "acc_text", "ext_text", "notes")
    return d.select("p_partkey", to_bool("has_text").alias("has_bool"),
                    step_score(F.col("p_size") % 5, [(3, 100), (2, 70), (1, 40)]).alias("step_points"),
                    "parking_score")


# ------------------------------------------------------------------ dictionary_match

_DICT_KEYS = ["red", "blue", "ring", "bolt", "SMALL", "ECONOMY"]


def _case_contains(col, keys, vals=None):
    vals = vals or keys
    arms = " ".join(f"WHEN instr({col}, '{k}') > 0 THEN '{v}'" for k, v in zip(keys, vals))
    return f"CASE {arms} END"


@query("dictionary_match", f"""
SELECT p_partkey,
  coalesce({_case_contains('p_name', _DICT_KEYS)}, {_case_contains('p_type', _DICT_KEYS)}) AS matched,
  {_case_contains('p_name', ['gadg', 'widg'])} AS stripped
FROM part
""")
def dictionary_match(spark, sf):
    """PR16: ordered containment, fallback column, suffix-stripped variant."""
    p = load(spark, sf, "part")
    return p.select("p_partkey",
                    match_dictionary("p_name", _DICT_KEYS, fallback="p_type").alias("matched"),
                    match_dictionary("p_name", ["gadget", "widget"], strip_suffix="et").alias("stripped"))


@query("region_extract", r"""
SELECT page_id,
  nullif(regexp_extract(url, '//([a-z]+)\.', 1), '') AS host,
  nullif(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), '') AS lang
FROM pages
""")
def region_extract(spark, sf):
    """PR15: regex group extraction, no match → missing."""
    p = load(spark, sf, "pages")
    return p.select("page_id", extract_region("url", r"//([a-z]+)\.").alias("host"),
                    extract_region("url", r"/([a-z]{2})/[0-9]+").alias("lang"))


# ------------------------------------------------------------------ keyword_exclusion

_EXCL = ["ouen", "ndble", "sch"]


@query("keyword_exclusion", """
SELECT doc_id, coalesce(regexp_matches(text, 'th[a-z]+sh'), false) AS has_pattern
FROM documents
WHERE NOT coalesce(regexp_matches(text, 'ouen|ndble|sch'), false)
""")
def keyword_exclusion(spark, sf):
    """PR17 any-keyword exclusion, PR18 null-safe regex flag."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    kept = exclude_keywords(d, "text", _EXCL)
    return kept.select("doc_id", contains_any("text", "th[a-z]+sh").alias("has_pattern"))


@query("cyclic_labels", """
SELECT doc_id, list_extract(['A', 'B', 'C'], CAST((row_number() OVER (ORDER BY doc_id) - 1) % 3 + 1 AS INTEGER)) AS label
FROM documents
""")
def cyclic_labels(spark, sf):
    """PR23: label by position (row i → labels[i mod n])."""
    d = load(spark, sf, "documents").select("doc_id")
    return assign_cyclic(d, "doc_id", ["A", "B", "C"])


@query("cohort_split", """
SELECT doc_id,
  CASE WHEN source IN ('src1', 'src2') OR regexp_matches(source, 'src1[0-9]') THEN 'in' ELSE 'out' END AS cohort,
  CASE WHEN instr(source, '1') > 0 THEN split_part(source, '1', 1) ELSE 'none' END AS src_group
FROM documents
""")
def cohort_split(spark, sf):
    """PR20 cohort split by name set ∪ pattern; PR21 key prefix with default."""
    d = load(spark, sf, "documents").select("doc_id", "source")
    a, b = split_cohort(d, "source", names=["src1", "src2"], pattern="src1[0-9]")
    both = a.withColumn("cohort", F.lit("in")).unionByName(b.withColumn("cohort", F.lit("out")))
    return both.select("doc_id", "cohort", prefix_key("source", "1", default="none").alias("src_group"))


# ------------------------------------------------------------------ joins

@query("indicator_inner_chain", """
WITH rev AS (
  SELECT s.s_nationkey AS nationkey, sum(l.rev) AS revenue
  FROM (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY l_suppkey) l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_nationkey),
sup AS (SELECT s_nationkey AS nationkey, count(*) AS n_suppliers FROM supplier GROUP BY s_nationkey),
ord AS (
  SELECT c.c_nationkey AS nationkey, CAST(sum(o.n) AS BIGINT) AS n_orders
  FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o
  JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey)
SELECT nationkey, revenue, n_suppliers, n_orders FROM rev JOIN sup USING (nationkey) JOIN ord USING (nationkey)
""", doubles=["revenue"], digits=4)
def indicator_inner_chain(spark, sf):
    """JN2: inner-join chain of nation indicators (each pre-aggregated before its join)."""
    li = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    s = load(spark, sf, "supplier")
    rev = li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("nationkey")) \
        .agg(F.sum("rev").alias("revenue"))
    sup = s.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = load(spark, sf, "customer")
    ords = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nationkey")) \
        .agg(F.sum("n").cast("long").alias("n_orders"))
    return join_all([rev, sup, ords], "nationkey", "inner")


@query("outer_fill", """
SELECT nationkey, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers
FROM (SELECT c_nationkey AS nationkey, count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS n_customers
      FROM customer GROUP BY 1 HAVING n_customers > 0) a
FULL OUTER JOIN (SELECT s_nationkey AS nationkey, count(CASE WHEN s_acctbal > 5000 THEN 1 END) AS n_suppliers
                 FROM supplier GROUP BY 1 HAVING n_suppliers > 0) b
USING (nationkey)
""")
def outer_fill(spark, sf):
    """JN4 full outer join, PR7 fill 0."""
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("n_customers")).filter("n_customers > 0")
    s = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(
        F.count_if(F.col("s_acctbal") > 5000).alias("n_suppliers")).filter("n_suppliers > 0")
    return join_all([c, s], "nationkey", "full", fill=0)


@query("value_precedence", """
SELECT c.c_custkey, coalesce(o.balance, c.c_acctbal) AS balance
FROM customer c LEFT JOIN (
  SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS balance FROM orders GROUP BY o_custkey) o
ON c.c_custkey = o.o_custkey
""", doubles=["balance"])
def value_precedence(spark, sf):
    """JN6: take the order-derived value when present, else the customer's own."""
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("balance"))
    return coalesce_from(c, o, "c_custkey", ["balance"], prefer_other=True)


@query("domain_completion", """
WITH s AS (SELECT s_nationkey AS n_nationkey, avg(CASE WHEN s_acctbal > 7000 THEN s_acctbal END) AS score FROM supplier GROUP BY 1),
m AS (SELECT quantile_cont(score, 0.5) AS med FROM s)
SELECT n_nationkey, coalesce(score, med) AS score
FROM (SELECT DISTINCT n_nationkey FROM nation) d FULL OUTER JOIN s USING (n_nationkey) CROSS JOIN m
""", doubles=["score"])
def domain_completion(spark, sf):
    """JN7 + AG13: complete the nation domain, median-fill missing scores."""
    s = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.avg(F.when(F.col("s_acctbal") > 7000, F.col("s_acctbal"))).alias("score"))
    s = cut_lineage(s)  # one reading of the means for the median and the rows
    return complete_domain(s, load(spark, sf, "nation"), "n_nationkey", "score")


@query("bridge_mean", """
WITH b AS (
  SELECT r.r_name, unnest(list_append(list(n.n_nationkey), 99)) AS nk
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name),
s AS (SELECT s_nationkey AS nk, avg(CASE WHEN s_acctbal > 8000 THEN s_acctbal END) AS score FROM supplier GROUP BY 1)
SELECT r_name, coalesce(avg(s.score), 0.0) AS score FROM b LEFT JOIN s USING (nk) GROUP BY r_name
""", doubles=["score"])
def bridge_mean_q(spark, sf):
    """JN9: region ↔ nation list bridge (plus a key without data), mean of nation scores."""
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    bridge = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(
        F.concat(F.collect_list("n_nationkey"), F.array(F.lit(99))).alias("nations"))
    scores = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(
        F.avg(F.when(F.col("s_acctbal") > 8000, F.col("s_acctbal"))).alias("score"))
    return bridge_mean(bridge, scores, "r_name", "nations", ["score"], region_key="nk")


_TARGETS = ["red widget", "redwidget", "big bolt", "small  ring", "giant bolt", "no such part"]
_ALIASES = [("giant bolt", "big bolt"), ("giant bolt", "blue bolt")]


def _values(rows, cols):
    body = ", ".join("(" + ", ".join("'" + v + "'" for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS _v({', '.join(cols)})"


_AR_SQL = f"""
WITH t AS (SELECT * FROM {_values([(x,) for x in _TARGETS], ['target'])}),
a AS (SELECT * FROM {_values(_ALIASES, ['canonical', 'alias'])}),
listed AS (
  SELECT a.canonical AS target, a.alias AS cand FROM a
  UNION SELECT a1.alias, a2.alias FROM a a1 JOIN a a2 ON a1.canonical = a2.canonical),
c0 AS (SELECT target, target AS cand FROM t UNION SELECT l.target, l.cand FROM listed l JOIN t USING (target)),
c AS (SELECT target, cand FROM c0 UNION SELECT target, regexp_replace(cand, '[ \\t\\n\\r\\f]+', '', 'g') FROM c0),
hits AS (
  SELECT DISTINCT c.target, p.p_partkey, p.p_name FROM c JOIN part p
  ON c.cand = p.p_name OR regexp_replace(c.cand, '[ \\t\\n\\r\\f]+', '', 'g') = regexp_replace(p.p_name, '[ \\t\\n\\r\\f]+', '', 'g')),
first AS (SELECT target, p_partkey, p_name FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY p_partkey) AS rn FROM hits) WHERE rn = 1)
SELECT t.target, coalesce(f.p_partkey, -1) AS p_partkey, f.p_name, f.p_partkey IS NOT NULL AS matched
FROM t LEFT JOIN first f USING (target)
"""


@query("alias_resolution", _AR_SQL)
def alias_resolution(spark, sf):
    """JN10 alias resolution, WN4 first match by master order, DQ1 unmatched report."""
    targets = spark.createDataFrame([(x,) for x in _TARGETS], "target string")
    aliases = spark.createDataFrame(_ALIASES, "canonical string, alias string")
    master = load(spark, sf, "part").select("p_partkey", "p_name")
    matched, unmatched = resolve_alias(targets, aliases, master, "target", "p_name", "p_partkey")
    return (matched.withColumn("matched", F.lit(True))
            .unionByName(unmatched.withColumn("matched", F.lit(False)), allowMissingColumns=True)
            .select("target", F.coalesce("p_partkey", F.lit(-1)).alias("p_partkey"), "p_name", "matched"))


# ------------------------------------------------------------------ radius join

# coordinates derived from keys; explicit doubles (Spark SQL reads 37.4 as DECIMAL)
_LAT = "CAST(37.4 AS DOUBLE) + CAST({k} % 997 AS DOUBLE) / CAST(3000 AS DOUBLE)"
_LNG = "CAST(126.8 AS DOUBLE) + CAST({k} % 991 AS DOUBLE) / CAST(2500 AS DOUBLE)"


def _hav(lat1, lng1, lat2, lng2):
    return (f"2 * 6371000.0 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lng2}) - radians({lng1})) / 2), 2)))")


@query("radius_weighted", f"""
WITH pl AS (SELECT s_suppkey, {_LAT.format(k='s_suppkey')} AS lat, {_LNG.format(k='s_suppkey')} AS lng FROM supplier),
pt AS (SELECT c_mktsegment, {_LAT.format(k='c_custkey')} AS p_lat, {_LNG.format(k='c_custkey')} AS p_lng,
              c_acctbal + 1000 AS w FROM customer),
pairs AS (SELECT pl.s_suppkey, pt.c_mktsegment, pt.w, {_hav('lat', 'lng', 'p_lat', 'p_lng')} AS d FROM pl CROSS JOIN pt),
rad AS (SELECT * FROM (VALUES (500.0), (1000.0), (2000.0)) AS r(radius_m)),
agg AS (SELECT s_suppkey, c_mktsegment, radius_m, count(*) AS n, sum(w) AS ws, sum(w * d) AS wd
        FROM pairs JOIN rad ON d <= radius_m GROUP BY s_suppkey, c_mktsegment, radius_m),
frame AS (SELECT s_suppkey, c_mktsegment, radius_m FROM (SELECT DISTINCT s_suppkey FROM pl)
          CROSS JOIN rad CROSS JOIN (SELECT DISTINCT c_mktsegment FROM pt))
SELECT f.s_suppkey, f.c_mktsegment, f.radius_m,
  CAST(CASE WHEN coalesce(ws, 0) > 0 THEN n ELSE 0 END AS BIGINT) AS n_points,
  CASE WHEN coalesce(ws, 0) > 0 THEN ws ELSE 0.0 END AS weight_sum,
  CASE WHEN coalesce(ws, 0) > 0 THEN wd / ws END AS weighted_dist_m
FROM frame f LEFT JOIN agg a USING (s_suppkey, c_mktsegment, radius_m)
""", doubles=["radius_m", "weight_sum", "weighted_dist_m"], digits=3)
def radius_weighted(spark, sf):
    """JN5 grid radius join + AG7 population-weighted distance for 500/1000/2000 m."""
    s = load(spark, sf, "supplier")
    places = s.select("s_suppkey", F.expr(_LAT.format(k="s_suppkey")).alias("lat"),
                      F.expr(_LNG.format(k="s_suppkey")).alias("lng"))
    c = load(spark, sf, "customer")
    points = c.select("c_mktsegment", F.expr(_LAT.format(k="c_custkey")).alias("p_lat"),
                      F.expr(_LNG.format(k="c_custkey")).alias("p_lng"), (F.col("c_acctbal") + 1000).alias("w"))
    return weighted_distance(places, points, "s_suppkey", [500.0, 1000.0, 2000.0], "w",
                             by_right="c_mktsegment")


@query("search_terms", """
SELECT p_name, suffix, concat_ws(' ', p_name, suffix) AS search_query
FROM (SELECT DISTINCT p_name FROM part) CROSS JOIN (VALUES ('park'), ('review'), ('walk')) AS w(suffix)
""")
def search_terms(spark, sf):
    """JN12: place names × suffix words."""
    p = load(spark, sf, "part").select("p_name").distinct()
    return cross_terms(p, "p_name", ["park", "review", "walk"])


# ------------------------------------------------------------------ aggregations

_BUCKETS = ["night", "morning", "afternoon", "evening"]


@query("snapshot_mean_pivot", f"""
WITH m AS (
  SELECT event_type, list_extract({_sql_list(_BUCKETS)}, CAST(floor(hour(ts) / 6) AS INTEGER) + 1) AS bucket,
         avg(value) AS mean_value
  FROM events GROUP BY 1, 2)
SELECT event_type,
  {", ".join(f"max(CASE WHEN bucket = '{b}' THEN mean_value END) AS mean_value_{b}" for b in _BUCKETS)}
FROM m GROUP BY event_type
""", doubles=[f"mean_value_{b}" for b in _BUCKETS])
def snapshot_mean_pivot(spark, sf):
    """AG8 mean per (type, day part), RS1 pivot to prefixed wide columns."""
    e = load(spark, sf, "events")
    arr = F.array(*[F.lit(b) for b in _BUCKETS])
    e = e.withColumn("bucket", F.element_at(arr, (F.floor(F.hour("ts") / 6) + 1).cast("int")))
    m = e.groupBy("event_type", "bucket").agg(F.avg("value").alias("mean_value"))
    return pivot_wide(m, "event_type", "bucket", "mean_value", _BUCKETS)


@query("diversity", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events
           WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
a AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n_items, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS diversity FROM c GROUP BY 1),
b AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n_distinct_items, ln(count(*)) AS diversity_distinct FROM c GROUP BY 1)
SELECT a.user_id, n_items, diversity, n_items * (1 + diversity) AS richness,
       n_distinct_items, diversity_distinct, n_distinct_items * (1 + diversity_distinct) AS richness_distinct
FROM a JOIN b USING (user_id)
""", doubles=["diversity", "richness", "diversity_distinct", "richness_distinct"])
def diversity(spark, sf):
    """AG5 Shannon diversity, AG6 richness (plain and over distinct pairs)."""
    e = load(spark, sf, "events")
    a = richness_score(e, "user_id", "event_type")
    b = richness_score(e, "user_id", "event_type", distinct=True, out="richness_distinct",
                       count_out="n_distinct_items", diversity_out="diversity_distinct")
    return a.join(b, "user_id")


@query("conditional_share", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(*) AS n_rows,
  avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS share_f,
  avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS share_disc
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
""", doubles=["share_f", "share_disc"])
def conditional_share(spark, sf):
    """AG3 distinct count, AG2 size, AG4 conditional shares."""
    from ..operators.agg import group_stats
    li = load(spark, sf, "lineitem")
    return group_stats(li, "l_returnflag", n_orders=F.countDistinct("l_orderkey"), n_rows=F.count(F.lit(1)),
                       share_f=share(F.col("l_linestatus") == "F"), share_disc=share(F.col("l_discount") > 0.05))


@query("quantile_selection", """
WITH src AS (SELECT p_partkey, p_brand, p_retailprice FROM part),
thr AS (SELECT p_brand, quantile_cont(p_retailprice, 0.75) AS t FROM src GROUP BY p_brand),
g AS (SELECT quantile_cont(p_retailprice, 0.85) AS t FROM src),
sel AS (SELECT DISTINCT * FROM (
  SELECT s.* FROM src s JOIN thr USING (p_brand) WHERE s.p_retailprice >= thr.t
  UNION ALL SELECT s.* FROM src s CROSS JOIN g WHERE s.p_retailprice >= g.t
  UNION ALL SELECT * FROM src WHERE p_brand IN ('Brand#1'))),
small AS (SELECT p_brand FROM sel GROUP BY p_brand HAVING count(*) <= 1),
nth AS (SELECT p_partkey, p_brand, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rn
  FROM src WHERE p_brand IN (SELECT p_brand FROM small)) WHERE rn = 2)
SELECT * FROM sel UNION ALL SELECT * FROM nth
""", doubles=["p_retailprice"])
def quantile_selection(spark, sf):
    """AG9 group Q3 ∪ global 85 % ∪ kept groups (distinct), AG10 second member for thin groups."""
    src = load(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    sel = select_top_quantile(src, "p_brand", "p_retailprice", 0.75, 0.85, keep=["Brand#1"])
    return ensure_min_members(sel, src, "p_brand", "p_retailprice", 2, tiebreak="p_partkey")


@query("row_weighted", """
WITH p AS (
  SELECT l_suppkey,
    avg(CASE WHEN l_returnflag = 'A' AND l_quantity = 50 AND l_discount > 0.05 THEN l_discount END) AS flag_A,
    avg(CASE WHEN l_returnflag = 'N' AND l_quantity = 50 AND l_discount > 0.05 THEN l_discount END) AS flag_N,
    avg(CASE WHEN l_returnflag = 'R' AND l_quantity = 50 AND l_discount > 0.05 THEN l_discount END) AS flag_R
  FROM lineitem GROUP BY l_suppkey),
w AS (
  SELECT s.s_suppkey AS l_suppkey, p.flag_A, p.flag_N, p.flag_R,
    CASE WHEN (CASE WHEN flag_A IS NULL THEN 0.0 ELSE 0.6 END) + (CASE WHEN flag_N IS NULL THEN 0.0 ELSE 0.3 END)
              + (CASE WHEN flag_R IS NULL THEN 0.0 ELSE 0.1 END) > 0
         THEN (coalesce(flag_A * 0.6, 0.0) + coalesce(flag_N * 0.3, 0.0) + coalesce(flag_R * 0.1, 0.0))
              / ((CASE WHEN flag_A IS NULL THEN 0.0 ELSE 0.6 END) + (CASE WHEN flag_N IS NULL THEN 0.0 ELSE 0.3 END)
                 + (CASE WHEN flag_R IS NULL THEN 0.0 ELSE 0.1 END)) END AS weighted
  FROM supplier s LEFT JOIN p ON s.s_suppkey = p.l_suppkey)
SELECT *, coalesce(weighted, coalesce((SELECT min(weighted) FROM w), 0.0) * 0.5) AS weighted_filled FROM w
""", doubles=["flag_A", "flag_N", "flag_R", "weighted", "weighted_filled"])
def row_weighted(spark, sf):
    """AG12 weighted row mean renormalised over present values, AG14 half-minimum fill."""
    seen = (F.col("l_quantity") == 50) & (F.col("l_discount") > 0.05)  # other rows leave gaps
    li = load(spark, sf, "lineitem").withColumn("l_discount", F.when(seen, F.col("l_discount")))
    p = pivot_wide(li, "l_suppkey", "l_returnflag", "l_discount", ["A", "N", "R"], fmt="flag_{v}", agg=F.avg)
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    w = s.join(p, "l_suppkey", "left").withColumn(
        "weighted", row_weighted_mean({"flag_A": 0.6, "flag_N": 0.3, "flag_R": 0.1}))
    return fill_half_min(w, "weighted", "weighted_filled")


def _profile_sql(table, cols):
    parts = []
    for name, dtype, numeric in cols:
        mn = f"min(CAST({name} AS DOUBLE))" if numeric else "NULL::DOUBLE"
        mx = f"max(CAST({name} AS DOUBLE))" if numeric else "NULL::DOUBLE"
        av = f"avg(CAST({name} AS DOUBLE))" if numeric else "NULL::DOUBLE"
        parts.append(
            f"SELECT CAST(count(*) AS BIGINT) AS n_rows, '{name}' AS \"column\", '{dtype}' AS dtype, "
            f"CAST(count(*) - count({name}) AS BIGINT) AS n_missing, "
            f"CASE WHEN count(*) > 0 THEN (count(*) - count({name})) * 100.0 / count(*) END AS pct_missing, "
            f"{mn} AS min, {mx} AS max, {av} AS mean FROM {table}")
    return "\nUNION ALL\n".join(parts)


_EVENT_COLS = [("event_id", "bigint", True), ("ts", "timestamp_ntz", False), ("user_id", "bigint", True),
               ("event_type", "string", False), ("value", "double", True), ("props", "string", False)]


@query("profile", _profile_sql("events", _EVENT_COLS), doubles=["pct_missing", "min", "max", "mean"])
def profile_q(spark, sf):
    """AG16: per-column profile in one aggregate job."""
    return profile(load(spark, sf, "events"))


@query("region_list_sum", """
WITH d AS (
  SELECT CASE WHEN doc_id % 3 = 0 THEN [source, lang] WHEN doc_id % 3 = 1 THEN [source] ELSE [] END AS regions,
         CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE CAST(n_chars AS DOUBLE) END AS m
  FROM documents),
e AS (SELECT unnest(regions) AS region, m FROM d)
SELECT region, sum(m) AS total, avg(m) AS mean FROM e WHERE region IS NOT NULL AND trim(region) <> '' GROUP BY region
""", doubles=["total", "mean"])
def region_list_sum(spark, sf):
    """PR22 string list / scalar / null → array, RS2 explode, AG17 region sum and mean."""
    d = load(spark, sf, "documents")
    field = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("['"), F.col("source"), F.lit("', '"), F.col("lang"), F.lit("']")))
             .when(F.col("doc_id") % 3 == 1, F.col("source")))
    m = F.when(F.col("doc_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("n_chars").cast("string"))
    return explode_sum(d.select(field.alias("region_field"), m.alias("m_text")), "region_field", "m_text")


@query("delimited_rows", """
WITH e AS (SELECT trim(unnest(string_split(concat_ws(',', lang, source, ' '), ','))) AS tok FROM documents)
SELECT CASE WHEN tok = '' OR ends_with(tok, '_k') THEN tok ELSE tok || '_k' END AS tok, count(*) AS n
FROM e WHERE tok <> '' GROUP BY 1
""")
def delimited_rows(spark, sf):
    """RS3: delimited text → trimmed rows with suffix completion."""
    d = load(spark, sf, "documents").select(F.concat_ws(",", "lang", "source", F.lit(" ")).alias("field"))
    e = explode_delimited(d, "field", ",", out="tok", suffix="_k")
    return e.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


@query("append_missing", """
WITH s AS (SELECT s_nationkey AS n_nationkey, avg(CASE WHEN s_acctbal > 8000 THEN s_acctbal END) AS score FROM supplier
           GROUP BY 1 HAVING score IS NOT NULL)
SELECT * FROM s
UNION ALL
SELECT n.n_nationkey, (SELECT min(score) * 0.5 FROM s) AS score
FROM (SELECT DISTINCT n_nationkey FROM nation) n WHERE n.n_nationkey NOT IN (SELECT n_nationkey FROM s)
""", doubles=["score"])
def append_missing_q(spark, sf):
    """JN8 constant rows (half minimum) for absent entities, RS5 append."""
    s = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.avg(F.when(F.col("s_acctbal") > 8000, F.col("s_acctbal"))).alias("score")).filter("score IS NOT NULL")
    return append_missing(s, load(spark, sf, "nation"), "n_nationkey", "score", half_min=True)
