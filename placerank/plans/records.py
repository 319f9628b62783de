"""Registered queries: scan/filter/project, time codes, key normalisation, id drops,
lookups, data-quality checks, the IO round trip and the batch forms of the
stream operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import invert, join_notes, ratio, safe_float, to_number
from ..functions.stats import clip
from ..functions.text import apply_map, ensure_suffix, norm_key
from ..operators.agg import group_stats
from ..operators.clean import drop_ids, drop_labels, drop_missing, row_sum_fallback, time_code_filter
from ..operators.joins import left_lookup
from ..operators.quality import check_domain, check_ranges
from ..session import ensure_checkpoint_dir
from ..streaming.intake import intake, snapshot_mean
from .indicators import _LAT, _LNG
from .registry import load, query

# ------------------------------------------------------------------ PR6 PR8 PR9 PR13 PR24

_SFP_SQL = """
SELECT o_orderkey,
  CASE WHEN o_custkey = 0 THEN NULL ELSE o_totalprice / o_custkey END AS per_cust,
  100.0 - least(greatest(o_totalprice / 5000.0, 0.0), 100.0) AS inv,
  ln(o_totalprice) AS lg, exp(-o_totalprice / 100000.0) AS ex, sqrt(o_totalprice) AS sq,
  sin(radians(CAST(o_orderkey % 360 AS DOUBLE))) AS sn, cos(radians(CAST(o_orderkey % 360 AS DOUBLE))) AS cs,
  asin((CAST(o_orderkey % 200 AS DOUBLE) - 100.0) / 100.0) AS asn, abs(o_totalprice - 100000.0) AS ab,
  round_even(o_totalprice / 7.0, 2) AS rd, CAST(length(o_orderpriority) AS INTEGER) AS nlen,
  lower(o_orderpriority) AS low, trim(concat(' ', o_orderpriority, ' ')) AS st, replace(o_orderpriority, '-', '_') AS rep,
  split_part(o_orderpriority, '-', 1) AS head, starts_with(o_orderpriority, '1') AS sw,
  ends_with(o_orderpriority, 'URGENT') AS ew, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 5, '0') AS zf,
  substr(o_orderpriority, 3, 4) AS sl
FROM orders
WHERE o_orderstatus = 'F' AND NOT coalesce(o_orderpriority IN ('5-LOW'), false)
  AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL
"""


@query("scan_filter_project", _SFP_SQL,
       doubles=["per_cust", "inv", "lg", "ex", "sq", "sn", "cs", "asn", "ab", "rd"])
def scan_filter_project(spark, sf):
    """PR9 status filter, PR8 label exclusion, PR6 drop missing, PR13 ratio/inversion,
    PR24 scalar functions — all pushed into the parquet scan and one codegen stage."""
    o = load(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    o = drop_labels(o, "o_orderpriority", ["5-LOW"])
    o = drop_missing(o, ["o_totalprice", "o_orderpriority"])
    tp, pr, k = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderkey")
    return o.select(
        "o_orderkey", ratio(tp, "o_custkey").alias("per_cust"), invert(clip(tp / 5000.0, 0.0, 100.0)).alias("inv"),
        F.log(tp).alias("lg"), F.exp(-tp / 100000.0).alias("ex"), F.sqrt(tp).alias("sq"),
        F.sin(F.radians((k % 360).cast("double"))).alias("sn"), F.cos(F.radians((k % 360).cast("double"))).alias("cs"),
        F.asin(((k % 200).cast("double") - 100.0) / 100.0).alias("asn"), F.abs(tp - 100000.0).alias("ab"),
        F.bround(tp / 7.0, 2).alias("rd"), F.length(pr).alias("nlen"), F.lower(pr).alias("low"),
        F.trim(F.concat(F.lit(" "), pr, F.lit(" "))).alias("st"), F.replace(pr, F.lit("-"), F.lit("_")).alias("rep"),
        F.split(pr, "-").getItem(0).alias("head"), pr.startswith("1").alias("sw"), pr.endswith("URGENT").alias("ew"),
        F.lpad((k % 1000).cast("string"), 5, "0").alias("zf"), F.substring(pr, 3, 4).alias("sl"))


# ------------------------------------------------------------------ PR10 PR11

_DATES = ["20240101", "20240102", "20240105"]


@query("time_code_filter", f"""
WITH e AS (
  SELECT event_id, user_id, value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         strftime(ts, '%Y%m%d') AS day, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS hour,
         substr(concat(lpad(CAST(user_id AS VARCHAR), 4, '0'), event_type), 1, 8) AS code
  FROM events)
SELECT day, hour, code, sum(coalesce(value, 0.0) + coalesce(k, 0.0)) AS measure, count(*) AS n
FROM e WHERE day IN ({", ".join(f"'{d}'" for d in _DATES)})
  AND hour IN ({", ".join(f"'{h:02d}'" for h in range(7, 23))})
GROUP BY day, hour, code
""", doubles=["measure"])
def time_code_filter_q(spark, sf):
    """PR10 day list, hour range 07–22 with zero padding, 8-character code; PR11 fallback
    total (sum of numeric non-key columns)."""
    e = load(spark, sf, "events").select(
        "event_id", "user_id", "value", to_number(F.get_json_object("props", "$.k")).alias("k"),
        F.date_format("ts", "yyyyMMdd").alias("day"), F.hour("ts").cast("string").alias("hour"),
        F.concat(F.lpad(F.col("user_id").cast("string"), 4, "0"), F.col("event_type")).alias("code"))
    f = time_code_filter(e, "day", "hour", "code", dates=_DATES, hours=(7, 22))
    f = row_sum_fallback(f, "total", "measure", protected=["event_id", "user_id"])
    return f.groupBy("day", "hour", "code").agg(F.sum("measure").alias("measure"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ PR12 PR4

_TYPO = {"red widget": "red gadget", "blue bolt": "blue screw"}


@query("key_normalise", """
WITH p AS (
  SELECT p_partkey, p_size, p_brand, p_type,
    CASE WHEN p_size % 3 = 0 THEN concat('  ', upper(p_name), ' ') WHEN p_size % 3 = 1 THEN concat(p_name, chr(13), chr(10))
         ELSE p_name END AS variant FROM part),
n AS (SELECT *, regexp_replace(variant, '[ \\t\\n\\r\\f]+', '', 'g') AS nospace, lower(trim(variant)) AS low,
        trim(regexp_replace(variant, '[\\r\\n]+', '', 'g')) AS nobreak FROM p),
t AS (SELECT *, CASE low WHEN 'red widget' THEN 'red gadget' WHEN 'blue bolt' THEN 'blue screw' ELSE low END AS typo FROM n)
SELECT p_partkey, nospace, low, nobreak, typo,
  CASE WHEN typo IS NULL OR typo = '' OR ends_with(typo, ' part') THEN typo ELSE typo || ' part' END AS suffixed,
  TRY_CAST(trim(CASE WHEN p_size % 4 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR) END) AS DOUBLE) AS size_f,
  coalesce(array_to_string([p_brand, p_type], ' '), '') AS notes
FROM t
""", doubles=["size_f"])
def key_normalise(spark, sf):
    """PR12 key normalisation (no spaces / lower / no line breaks), typo map, suffix
    completion; PR4 tolerant float and list notes joined to text."""
    p = load(spark, sf, "part")
    variant = (F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
               .when(F.col("p_size") % 3 == 1, F.concat(F.col("p_name"), F.lit("\r\n"))).otherwise(F.col("p_name")))
    n = p.select("p_partkey", "p_size", "p_brand", "p_type", variant.alias("variant"))
    n = n.select("*", norm_key("variant", "nospace").alias("nospace"), norm_key("variant", "lower").alias("low"),
                 norm_key("variant", "nobreak").alias("nobreak"))
    n = n.withColumn("typo", apply_map("low", _TYPO))
    size_text = F.when(F.col("p_size") % 4 == 0, F.lit(" ")).otherwise(F.col("p_size").cast("string"))
    return n.select("p_partkey", "nospace", "low", "nobreak", "typo", ensure_suffix("typo", " part").alias("suffixed"),
                    safe_float(size_text).alias("size_f"), join_notes(F.array("p_brand", "p_type")).alias("notes"))


# ------------------------------------------------------------------ PR19 JN11

@query("drop_listed_ids", """
SELECT doc_id, lang, 'unlabeled' AS kind FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id NOT IN (1, 2, 3, 5, 8)
UNION ALL
SELECT doc_id, lang, 'labeled' AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
""")
def drop_listed_ids(spark, sf):
    """PR19 delete listed rows by id (a frame and a literal list), JN11 semi and anti joins."""
    d = load(spark, sf, "documents").select("doc_id", "lang")
    lab = load(spark, sf, "labels").select("doc_id")
    anti = drop_ids(drop_ids(d, "doc_id", lab), "doc_id", [1, 2, 3, 5, 8]).withColumn("kind", F.lit("unlabeled"))
    semi = d.join(lab, "doc_id", "left_semi").withColumn("kind", F.lit("labeled"))
    return anti.unionByName(semi)


# ------------------------------------------------------------------ JN1 JN3 JN13 AG2

_NAMES = {"NATION_0": "가나", "NATION_1": "나라", "NATION_2": "다솜", "NATION_3": "라온", "NATION_4": "마루"}


@query("lookup_join", """
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
oc AS (SELECT o.n, c.c_nationkey FROM o JOIN customer c ON o.o_custkey = c.c_custkey),
onn AS (SELECT oc.*, n.n_name FROM oc LEFT JOIN nation n ON oc.c_nationkey = n.n_nationkey),
t AS (SELECT *, CASE n_name """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + """ END AS name_ko FROM onn)
SELECT name_ko, CAST(sum(n) AS BIGINT) AS n_orders, count(*) AS n_customers FROM t WHERE name_ko IS NOT NULL GROUP BY name_ko
""")
def lookup_join(spark, sf):
    """JN1 inner join on a code, JN3 left lookup with differently named keys, JN13 name
    translation (unmapped → missing), AG2 group size."""
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    oc = o.join(c, o.o_custkey == c.c_custkey).select("n", "c_nationkey")
    on = left_lookup(oc, load(spark, sf, "nation").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey")
    on = on.withColumn("name_ko", apply_map("n_name", _NAMES, keep_unmapped=False))
    return group_stats(on, "name_ko", n_orders=F.sum("n").cast("long"), n_customers=F.count(F.lit(1)))


# ------------------------------------------------------------------ DQ2 DQ3

@query("domain_check", """
SELECT 'nation' AS tbl, count(DISTINCT n_nationkey) AS n_distinct, CAST(25 AS BIGINT) AS expected,
       count(DISTINCT n_nationkey) = 25 AS complete FROM nation
UNION ALL
SELECT 'customer', count(DISTINCT c_nationkey), CAST(25 AS BIGINT), count(DISTINCT c_nationkey) = 25 FROM customer
""")
def domain_check(spark, sf):
    """DQ2: dimension completeness (25 members expected)."""
    a = check_domain(load(spark, sf, "nation"), "n_nationkey", 25).withColumn("tbl", F.lit("nation"))
    b = check_domain(load(spark, sf, "customer"), "c_nationkey", 25).withColumn("tbl", F.lit("customer"))
    return a.unionByName(b)


@query("range_check", f"""
WITH p AS (SELECT {_LAT.format(k='c_custkey')} AS lat, {_LNG.format(k='c_custkey')} AS lng FROM customer)
SELECT 'lat' AS "column", 37.4 AS lo, 37.6 AS hi, CAST(count(*) - count(lat) AS BIGINT) AS n_null,
       CAST(sum(CASE WHEN lat < 37.4 OR lat > 37.6 THEN 1 ELSE 0 END) AS BIGINT) AS n_out_of_range FROM p
UNION ALL
SELECT 'lng', 126.8, 127.1, CAST(count(*) - count(lng) AS BIGINT),
       CAST(sum(CASE WHEN lng < 126.8 OR lng > 127.1 THEN 1 ELSE 0 END) AS BIGINT) FROM p
""", doubles=["lo", "hi"])
def range_check(spark, sf):
    """DQ3: coordinate missing and out-of-range counts."""
    c = load(spark, sf, "customer").select(F.expr(_LAT.format(k="c_custkey")).alias("lat"),
                                           F.expr(_LNG.format(k="c_custkey")).alias("lng"))
    return check_ranges(c, {"lat": (37.4, 37.6), "lng": (126.8, 127.1)})


# ------------------------------------------------------------------ IO round trip

_CODES = {"cnt_click": "Click", "cnt_view": "View", "cnt_purchase": "Purchase", "cnt_signup": "Signup", "cnt_error": "Error"}


@query("io_round_trip", """
SELECT 'csv' AS src, CAST(n_regionkey AS VARCHAR) AS key, count(*) AS n FROM nation GROUP BY 2
UNION ALL SELECT 'encoded', CAST(n_regionkey AS VARCHAR), count(*) FROM nation GROUP BY 2
UNION ALL SELECT 'positional', CAST(n_regionkey AS VARCHAR), count(*) FROM nation GROUP BY 2
UNION ALL SELECT 'envelope', CAST(n_regionkey AS VARCHAR), count(*) FROM nation GROUP BY 2
UNION ALL SELECT 'keyed', CAST(n_regionkey AS VARCHAR), count(*) FROM nation GROUP BY 2
UNION ALL SELECT 'json_lines', event_type, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'union', event_type, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'dir', event_type, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'coded', upper(substr(event_type, 1, 1)) || substr(event_type, 2), count(DISTINCT user_id) FROM events GROUP BY 2
""")
def io_round_trip(spark, sf):
    """IO1–IO11: tables written to a fresh folder under the shared checkpoint folder in
    every supported layout, read back with the matching reader, and counted."""
    from ..sources import readers as R
    from ..sources import writers as W
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/io_round_trip/{uuid.uuid4().hex}"
    nation, events = load(spark, sf, "nation"), load(spark, sf, "events")
    parts = []
    # IO9 → IO1 (+ IO11 header resolution)
    W.write_csv(nation.withColumnsRenamed({"n_regionkey": "Region Key", "n_name": "NAME"}), f"{base}/nation_csv")
    csv = R.resolve_columns(R.read_table(spark, f"{base}/nation_csv"),
                            {"n_regionkey": ["region_key", "regionkey"], "n_name": ["name"]}, required=["n_regionkey"])
    parts.append(csv.groupBy(F.lit("csv").alias("src"), F.col("n_regionkey").cast("string").alias("key")).count())
    # IO2: a legacy Korean encoding and UTF-8 in one folder, told apart file by file
    named = nation.withColumn("n_name", F.concat(F.lit("구 "), "n_name"))
    own = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark's writer knows the charset only with it
    try:
        named.where("n_nationkey % 2 = 0").write.mode("append").option("header", True).option("encoding", "x-windows-949").csv(f"{base}/nation_949")
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets") if own is None else spark.conf.set("spark.sql.legacy.javaCharsets", own)
    named.where("n_nationkey % 2 = 1").write.mode("append").option("header", True).csv(f"{base}/nation_949")
    enc = R.read_csv_encoded(spark, f"{base}/nation_949", required=["n_regionkey"]).where(F.col("n_name").startswith("구 "))
    parts.append(enc.groupBy(F.lit("encoded").alias("src"), F.col("n_regionkey").cast("string").alias("key")).count())
    # IO3: title preamble, columns by position (a bounded dimension written as one text file)
    lines = (spark.createDataFrame([("National register,,",), (",,",), ("key,name,region",)], "value string")
             .unionByName(nation.select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"))))
    lines.coalesce(1).write.mode("overwrite").text(f"{base}/nation_pos")
    pos = R.read_positional(spark, f"{base}/nation_pos", ["c0", "c1", "c2"], skip_until="key")
    parts.append(pos.groupBy(F.lit("positional").alias("src"), F.col("c2").alias("key")).count())
    # IO4: JSON envelope {"records": [...]} of a bounded dimension
    env = nation.agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name", F.struct(
        F.col("n_regionkey").alias("key")).alias("region"))).alias("records"))).alias("value"))
    env.coalesce(1).write.mode("overwrite").text(f"{base}/nation_env")
    recs = R.read_json_records(spark, f"{base}/nation_env")
    parts.append(recs.groupBy(F.lit("envelope").alias("src"), F.col("`region.key`").cast("string").alias("key")).count())
    # IO5: object keyed by name
    keyed = nation.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "n_name", F.struct("n_nationkey", "n_regionkey"))))).alias("value"))
    keyed.coalesce(1).write.mode("overwrite").text(f"{base}/nation_keyed")
    kj = R.read_keyed_json(spark, f"{base}/nation_keyed", "struct<n_nationkey:int,n_regionkey:int>", "n_name")
    parts.append(kj.groupBy(F.lit("keyed").alias("src"), F.col("n_regionkey").cast("string").alias("key")).count())
    # IO10 → JSON lines back
    W.write_json(events, f"{base}/events_json")
    ej = spark.read.json(f"{base}/events_json")
    parts.append(ej.groupBy(F.lit("json_lines").alias("src"), F.col("event_type").alias("key")).count())
    # IO7: two CSV folders appended with a required-column check
    W.write_csv(events.filter(F.col("value") > 50), f"{base}/ev_hi")
    W.write_csv(events.filter(~(F.col("value") > 50) | F.col("value").isNull()), f"{base}/ev_lo")
    un = R.read_union(spark, [f"{base}/ev_hi", f"{base}/ev_lo"], ["event_id", "event_type"],
                      schema="event_id long, ts string, user_id long, event_type string, value double, props string")
    parts.append(un.groupBy(F.lit("union").alias("src"), F.col("event_type").alias("key")).count())
    # IO8: one folder per entity; entity taken from the path and put first
    events.write.mode("overwrite").partitionBy("event_type").option("header", True).csv(f"{base}/ev_dir")
    dr = R.read_dir_with_key(spark, f"{base}/ev_dir/*/*.csv", ".csv", key="entity", path_pattern="event_type=([^/]+)/",
                             schema="event_id long, ts string, user_id long, value double, props string")
    parts.append(dr.groupBy(F.lit("dir").alias("src"), F.col("entity").alias("key")).count())
    # IO6: coded wide counters → labelled rows
    wide = events.groupBy("user_id").pivot("event_type", ["click", "view", "purchase", "signup", "error"]).count()
    wide = wide.withColumnsRenamed({t: f"cnt_{t}" for t in ["click", "view", "purchase", "signup", "error"]})
    coded = R.unpivot_coded(wide, "user_id", "cnt", {k.upper(): v for k, v in _CODES.items()})
    parts.append(coded.groupBy(F.lit("coded").alias("src"), F.col("label").alias("key")).count())
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res.withColumnRenamed("count", "n")


# ------------------------------------------------------------------ ST1 ST2 (batch forms)

@query("incremental_intake", """
WITH b AS (
  SELECT 1 AS batch, event_id, ts, user_id, CASE WHEN event_type = 'error' THEN '' ELSE props END AS body
  FROM events WHERE ts < TIMESTAMP '2024-01-06'
  UNION ALL
  SELECT 2 AS batch, event_id, ts, user_id, CASE WHEN event_type = 'error' THEN '' ELSE props END AS body
  FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-04'),
k AS (SELECT * FROM b WHERE body IS NOT NULL AND trim(body) <> ''),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY batch, ts, event_id) AS rn FROM k) WHERE rn = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch, ts, event_id) AS qn FROM f)
SELECT event_id, user_id, batch FROM q WHERE qn <= 5
""")
def incremental_intake(spark, sf):
    """ST1 (batch form): overlapping batches, each id accepted once (earliest arrival),
    blank bodies skipped, at most 5 per user."""
    e = load(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props")).alias("body"))
    b1 = e.filter(F.col("ts") < F.lit("2024-01-06").cast("timestamp_ntz")).withColumn("batch", F.lit(1))
    b2 = e.filter(F.col("ts").isNull() | (F.col("ts") >= F.lit("2024-01-04").cast("timestamp_ntz"))).withColumn("batch", F.lit(2))
    res = intake(b1.unionByName(b2), "event_id", ["batch", "ts"], "user_id", body="body", quota=5)
    return res.select("event_id", "user_id", "batch")


@query("rolling_snapshot", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS daily FROM events GROUP BY 1, 2)
SELECT event_type, avg(daily) AS daily_mean, count(*) AS n_snapshots FROM d GROUP BY event_type
""", doubles=["daily_mean"])
def rolling_snapshot(spark, sf):
    """ST2 (batch form): daily snapshot means, then the mean over all snapshots per key."""
    e = load(spark, sf, "events")
    d = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.avg("value").alias("daily"))
    return snapshot_mean(d, ["event_type"], "daily", out="daily_mean")
