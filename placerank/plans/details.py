"""Queries of single operators that no composite uses: statistics rows, describes, code lengths, row
append and keep-first, station congestion, shelters, passages with a query column, names from a
table, density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agg, density, joins, reshape
from ..operators import text as T
from ..operators.scale import scale_many
from ..session import cut_lineage
from . import sqlkit as Q
from .composite import shelter_indicator, station_congestion
from .registry import load, query
from .texts import _ENTITIES, sql_sentences

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("stats_row", "SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS {c}_median, avg({c}) AS {c}_mean, min({c}) AS {c}_min, max({c}) AS {c}_max, stddev_samp({c}) AS {c}_std"
    for c in _NUMBERS) + " FROM lineitem", doubles=[f"{c}_{s}" for c in _NUMBERS for s in ("median", "mean", "min", "max", "std")])
def stats_row_q(spark, sf):
    """AG13: median, mean, minimum, maximum and σ of several columns in one row."""
    return agg.stats_row(load(spark, sf, "lineitem"), _NUMBERS)


@query("describe_numbers", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    f"CAST(max({c}) AS DOUBLE) AS max, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median, "
    f"CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3 FROM lineitem" for c in _NUMBERS),
    doubles=["mean", "std", "min", "max", "q1", "median", "q3"])
def describe_numbers_q(spark, sf):
    """AG16: count, mean, σ, minimum, quartiles and maximum per column."""
    return agg.describe_numbers(load(spark, sf, "lineitem"), _NUMBERS)


@query("code_lengths", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(length(CAST({c} AS VARCHAR)) AS INTEGER) AS length, count(*) AS count FROM orders "
    f"WHERE {c} IS NOT NULL GROUP BY 2" for c in ("o_orderkey", "o_custkey", "o_orderpriority")))
def code_lengths_q(spark, sf):
    """AG16: how often each length of a code occurs."""
    return agg.code_lengths(load(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("type_counts", """
SELECT count(*) AS n_rows, dtype, CAST(n AS BIGINT) AS n_columns
FROM events CROSS JOIN (VALUES ('bigint', 2), ('timestamp_ntz', 1), ('string', 2), ('double', 1)) AS t(dtype, n) GROUP BY dtype, n
""")
def type_counts_q(spark, sf):
    """AG16: number of columns by type, with the number of rows."""
    return agg.type_counts(load(spark, sf, "events"))


_FIRST_SQL = """
WITH u AS (SELECT user_id, event_type, ts, event_id FROM events WHERE event_type = 'click'
           UNION ALL SELECT user_id, event_type, ts, event_id FROM events
           UNION ALL SELECT user_id, 'none' AS event_type, NULL AS ts, NULL AS event_id FROM events),
d AS (SELECT DISTINCT * FROM u)
SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS rn FROM d) WHERE rn = 1
"""


@query("keep_first", _FIRST_SQL)
def keep_first(spark, sf):
    """RS5 append of ragged frames, RS6 whole-row distinct and the first row of each key."""
    e = load(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    rows = reshape.union_all([e.where(F.col("event_type") == "click"), e, e.select("user_id", F.lit("none").alias("event_type"))])
    return reshape.first_distinct(reshape.distinct_rows(rows), ["user_id", "event_type"], ["ts", "event_id"]) \
        .select("user_id", "event_type", "event_id")


_HOURS = [0, 6, 12, 18]


@query("station_congestion", f"""
WITH slot AS (SELECT user_id, CAST(hour(ts) // 6 * 6 AS INTEGER) AS h, avg(value) AS v FROM events
              WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
wide AS (SELECT user_id, {', '.join(f'max(CASE WHEN h = {h} THEN v END) AS s{h}' for h in _HOURS)} FROM slot GROUP BY user_id),
st AS (SELECT user_id, {Q.row_mean([f's{h}' for h in _HOURS])} AS m FROM wide),
pl AS (SELECT DISTINCT c_custkey AS user_id, c_nationkey AS district FROM customer),
d AS (SELECT district, avg(m) AS station_mean_congest FROM st JOIN pl USING (user_id) GROUP BY district)
SELECT district, station_mean_congest, CASE WHEN max(station_mean_congest) OVER () = min(station_mean_congest) OVER () THEN 0.0
  ELSE (station_mean_congest - min(station_mean_congest) OVER ()) / (max(station_mean_congest) OVER () - min(station_mean_congest) OVER ()) * 100.0
  END AS congestion_score FROM d
""", doubles=["station_mean_congest", "congestion_score"])
def station_congestion_q(spark, sf):
    """CI13 input: mean of the time-slot columns per station, station → district, district mean and score."""
    e = load(spark, sf, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    slot = e.groupBy("user_id", F.concat((F.floor(F.hour("ts") / 6) * 6).cast("string"), F.lit("시")).alias("slot")).agg(F.avg("value").alias("v"))
    wide = slot.groupBy("user_id").pivot("slot", [f"{h}시" for h in _HOURS]).agg(F.first("v"))
    places = load(spark, sf, "customer").select(F.col("c_custkey").alias("station"), F.col("c_nationkey").alias("district"))
    return station_congestion(wide, "user_id", places, "station", "district")


@query("shelter_index", """
WITH g AS (SELECT s_nationkey, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END) AS cap FROM supplier GROUP BY 1)
SELECT s_nationkey,
  0.4 * (CASE WHEN max(n) OVER () = min(n) OVER () THEN 0.0 ELSE (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) * 100.0 END)
  + 0.6 * (CASE WHEN max(cap) OVER () = min(cap) OVER () THEN 0.0 ELSE (cap - min(cap) OVER ()) / (max(cap) OVER () - min(cap) OVER ()) * 100.0 END)
  AS shelter_score FROM g
""", doubles=["shelter_score"])
def shelter_index(spark, sf):
    """CI9 shelter indicator: .4 scaled count + .6 scaled capacity."""
    g = load(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(0.0)).alias("cap"))
    s = scale_many(cut_lineage(g), [dict(c=c, out=f"{c}_score", method="minmax", constant=0.0) for c in ("n", "cap")])
    return s.select("s_nationkey", shelter_indicator(F.col("n_score"), F.col("cap_score")).alias("shelter_score"))


_ENT = ", ".join(f"'{e}'" for e in _ENTITIES)


@query("entity_passages_query", f"""
WITH d AS (SELECT doc_id, text, {sql_sentences('text')} AS s, coalesce('about ' || left(text, 40), '') || ' ' || coalesce(text, '') AS src FROM documents),
e AS (SELECT doc_id, s, unnest(list_filter([{_ENT}], lambda x: instr(src, x) > 0)) AS entity FROM d),
p AS (SELECT doc_id, entity, CASE WHEN len(s) > 0 THEN array_to_string(list_transform(list_filter(range(len(s)),
        lambda i: len(list_filter(range(greatest(i - 2, 0), least(i + 2, len(s) - 1) + 1),
                                  lambda j: instr(s[j + 1], entity) > 0)) > 0), lambda i: s[i + 1]), ' ') END AS relevant_text FROM e)
SELECT doc_id, entity, relevant_text FROM p WHERE relevant_text IS NOT NULL AND relevant_text <> ''
""")
def entity_passages_query(spark, sf):
    """TX6 with the query column: entities named in the search string or the text, ± 2 sentences."""
    d = load(spark, sf, "documents").withColumn("asked", F.concat(F.lit("about "), F.left("text", F.lit(40))))
    return T.entity_passages(d, "text", _ENTITIES, keep="doc_id", k=2, query="asked")


@query("contained_names", r"""
WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS name FROM benchmark)
SELECT doc_id, name FROM documents d JOIN n ON instr(d.text, n.name) > 0
""")
def contained_names(spark, sf):
    """PR16/PR17/TX6 for a dictionary that is a table: every name that occurs in a text."""
    names = load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1))).alias("name"))
    return joins.contained_names(load(spark, sf, "documents"), "doc_id", "text", names, "name")


@query("density_topics", """
WITH RECURSIVE p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id
      AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.04),
core AS (SELECT a AS n FROM l GROUP BY a HAVING count(*) + 1 >= 4),
cl AS (SELECT a, b FROM l WHERE a IN (SELECT n FROM core) AND b IN (SELECT n FROM core)),
reach(a, b) AS (SELECT n, n FROM core UNION SELECT r.a, cl.b FROM reach r JOIN cl ON r.b = cl.a),
root AS (SELECT a AS n, min(b) AS root FROM reach GROUP BY a),
edge AS (SELECT l.a AS n, min(root.root) AS root FROM l JOIN root ON l.b = root.n WHERE l.a NOT IN (SELECT n FROM core) GROUP BY l.a)
SELECT vec_id, coalesce(root.root, edge.root, -1) AS topic FROM p LEFT JOIN root ON root.n = vec_id LEFT JOIN edge ON edge.n = vec_id
""")
def density_topics(spark, sf):
    """TX17 by density: neighbours of the first three coordinates within .04, cores of four, components."""
    e = load(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)])
    return density.density_clusters(e, "vec_id", ["x0", "x1", "x2"], 0.04, 4)
