"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of shuffled documents, read over again up to ``MOST_PASSES`` times. A
document's virtual finish time is its source's cumulative words up to and with it, divided by the
source's target. All documents are then put in order of finish time and the order is cut at the
total budget: a queue with twice the target is served twice as often.

Prefix sums never gather a source (one may hold a third of all rows): documents are dealt by
their shuffle hash into ``BUCKETS`` buckets a source, sums of buckets give each bucket's start, and
only inside a bucket is there an ordered window. The cut of the global order works alike: sums over
ranges of finish time find the range in which the budget ends, and sub-ranges inside it.

Defined cases: a null text has no words and is taken with 0; sources go by code point with null
last; rows that agree in id, text and source are served together, other repeats of an id alone; an empty table gives no rows; where all
texts are empty the targets are 0. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_each, saved, small_side, word_count

WEIGHTS, SHARE, MOST_PASSES = (3, 1, 2), 1.5, 2
BUCKETS = 2048         # shuffle buckets a source
RANGES, PARTS = 4096, 4096  # ranges of finish time, and parts of each
SMALL_SOURCES = 100_000     # sources whose one-row targets are broadcast at most
SMALL_TIMES = 500_000       # documents whose times are broadcast at most


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the budget, ``share`` of all
    words, is dealt by weight; a target stops at ``most`` times its source's size and the excess
    goes to the others by weight. With sources in order of size / weight the stopped ones come
    first, so the level (words a unit of weight) is found from running sums. One row a source."""
    by_code, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    w = sizes.withColumn("_i", F.row_number().over(by_code) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights)) + 1)
    w = w.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    w = w.withColumn("_stop", F.col("_cap") / F.col("_w")).withColumn(
        "_budget", F.sum("source_size").over(every) * F.lit(float(share)))
    before = Window.orderBy("_stop", "_i").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_stop", "_i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    w = w.withColumn("_level", level)
    level = F.min(F.when(F.col("_level") <= F.col("_stop"), F.struct("_stop", "_i", "_level"))).over(every)
    target = F.least(F.col("_cap"), F.coalesce(level["_level"] * F.col("_w"), F.col("_cap")))
    return w.select("source", "source_size", target.alias("target"))


def queue(docs: DataFrame, seed: int = 20, **how) -> DataFrame:
    """Every pass of every document: doc_id, source, size, n_rows (rows that agree in id, text and
    source: they are served together), source_size, target, pass, finish (virtual finish time),
    taken (inside the budget)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count().alias("size"), shuffle_key(seed).alias("shuffle"))
    rows = saved(rows.groupBy("doc_id", "source", "size", "shuffle").agg(F.count(F.lit(1)).alias("n_rows"))
                 .withColumn("_b", F.pmod(F.col("shuffle"), F.lit(BUCKETS)).cast("int")), "queue")
    words = F.col("size") * F.col("n_rows")
    sums = saved(rows.groupBy("source", "_b").agg(F.sum(words).alias("_sum")), "queue-sums")
    per_source = saved(targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), **how), "targets")
    per_source = small_side(per_source, per_source.count(), SMALL_SOURCES).withColumnRenamed("source", "_ps")
    start = F.sum("_sum").over(Window.partitionBy("source").orderBy("_b")) - F.col("_sum")
    starts = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), start.alias("_start"))
    inside = Window.partitionBy("source", "_b").orderBy("shuffle", "doc_id", "size")
    cum = F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passes = rows.withColumn("_in", cum) \
        .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb"))) \
        .join(per_source, F.col("source").eqNullSafe(F.col("_ps"))) \
        .withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(MOST_PASSES)])))
    done = F.col("pass") * F.col("source_size") + F.col("_start") + F.col("_in")
    passes = passes.withColumn("finish", F.when(F.col("target") > 0, done / F.col("target")))
    passes = saved(passes.select("doc_id", "source", "size", "n_rows", "shuffle", "source_size", "target", "pass",
                                 "finish"), "passes")
    return _cut(passes, float(how.get("share", SHARE)))


def shuffle_key(seed: int) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(seed))


def _cut(passes: DataFrame, share: float) -> DataFrame:
    """Mark what comes before the budget ends in order of finish time. Finish times lie in ranges
    (what finishes after 2 is in the last); the running sums of the ranges, one number each, show
    in which one, and in which part of that one, the budget ends; only that part is sorted."""
    words = F.col("size") * F.col("n_rows")
    span = F.least(F.col("finish") / 2, F.lit(1.0)) * RANGES
    part = F.least(F.floor((span - F.col("_r")) * PARTS), F.lit(PARTS - 1)).cast("int")
    ranged = passes.withColumn("_r", F.least(F.floor(span), F.lit(RANGES - 1)).cast("int")).withColumn("_q", part)
    left = passes.where("pass = 0").agg(F.sum(words)).first()[0]
    left, at = float(left or 0) * share, []
    inside = ranged
    for by in ("_r", "_q"):
        w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = inside.groupBy(by).agg(F.sum(words).alias("_n")).where(F.col(by).isNotNull()) \
            .withColumn("_to", F.sum("_n").over(w))
        hit = run.where(F.col("_to") > left).orderBy(by).first()
        if hit is None:  # the budget holds all that there is
            at += [RANGES] * (2 - len(at))
            break
        at.append(hit[by])
        left -= hit["_to"] - hit["_n"]
        inside = inside.where(F.col(by) == hit[by])
    r, q = at
    edge = (F.col("_r") == r) & (F.col("_q") == q)
    run = F.sum(words).over(Window.orderBy("finish", "source", "shuffle", "doc_id", "pass")
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sure = F.coalesce((F.col("_r") < r) | ((F.col("_r") == r) & (F.col("_q") < q)), F.lit(False))
    return ranged.where(~F.coalesce(edge, F.lit(False))).withColumn("taken", sure) \
        .unionByName(ranged.where(edge).withColumn("taken", run <= F.lit(left))).drop("_r", "_q")


def served(docs: DataFrame, seed: int = 20, **how) -> DataFrame:
    """One row for each (doc_id, source, shuffle): how often the mix takes it, as ``times``."""
    return queue(docs, seed, **how).groupBy("doc_id", "source", "size", "n_rows", "shuffle", "source_size", "target") \
        .agg(F.sum(F.col("taken").cast("long")).alias("times"))


def mix(docs: DataFrame, seed: int = 20, **how) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, times, taken (words)."""
    return rows_each(served(docs, seed, **how), "n_rows").select(
        "doc_id", "source", "size", "source_size", "target", "times",
        (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 20, **how) -> DataFrame:
    """``docs`` as the mix serves them, with all their columns: a row is there once for each time
    it is taken. Documents without words stay once."""
    times = saved(served(docs, seed, **how).select(
        F.col("doc_id").alias("_llm_id"), F.col("source").alias("_llm_source"), F.col("shuffle").alias("_llm_key"),
        F.when(F.col("size") == 0, 1).otherwise(F.col("times")).alias("_llm_times")).where("_llm_times > 0"), "served")
    times = small_side(times, times.count(), SMALL_TIMES)
    same = F.col("_llm_key") == F.col("_llm_shuffle")
    same &= F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & F.col("source").eqNullSafe(F.col("_llm_source"))
    taken = docs.withColumn("_llm_shuffle", shuffle_key(seed)).join(times, same)
    return taken.withColumn("_llm_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_llm_times").cast("long")))) \
        .select(*docs.columns)
