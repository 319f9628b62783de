"""Positions in an order without sorting a whole frame in one task.

Rows are dealt into ranges of the sort key. The bounds of the ranges come from a sample that the
data alone decide: the rows whose content hash lies below a limit that follows from their number.
So every reading of the frame finds the same bounds, and counts, offsets and positions agree without the sorted frame being written.
A row's position is the number of rows in the ranges before its own, which are counted first, plus
its place inside its range, which one task sorts. The number of ranges follows
``spark.sql.shuffle.partitions``, as that of a range exchange does; no job runs while a plan is built.

All passes must see the same values. Floating-point sums may differ in their last bits from one run
of an aggregate to the next, so a frame that ends in such sums is written once (``cut_lineage``)
before it is ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLED = 24          # sampled rows a range, about


def row_hash(df: DataFrame) -> Column:
    """Deterministic per-row salt (content hash), stable under task retries."""
    return F.xxhash64(*[F.col(c) for c in df.columns])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _reversed(c: Column, kind: T.DataType) -> Column:
    """A column in the opposite order."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.bitwise_not(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(-math.inf)).otherwise(-c)
    if isinstance(kind, T.DecimalType):
        return -c
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.DateType):
        return F.bitwise_not(F.unix_date(c))
    if isinstance(kind, T.TimestampType):
        return F.bitwise_not(F.unix_micros(c))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        digits = "0123456789ABCDEF"
        return F.concat(F.translate(F.hex(c.cast("binary")), digits, digits[::-1]), F.lit("G"))
    raise TypeError(f"no descending order of {kind.simpleString()}")


def sort_key(df: DataFrame, order: list[tuple[Column, bool]]) -> Column:
    """One struct that sorts as ``order`` ((column, ascending) pairs, missing values last)."""
    kinds = [f.dataType for f in df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(order)]).schema]
    fields = []
    for i, ((c, ascending), kind) in enumerate(zip(order, kinds)):
        fields += [c.isNull().alias(f"n{i}"), (c if ascending else _reversed(c, kind)).alias(f"k{i}")]
    return F.struct(*fields)


def with_range(df: DataFrame, key: Column, ranges: int | None = None) -> DataFrame:
    """``df`` with ``_key`` and ``_range``, the number of its range from 0. The bounds are one
    broadcast row of fewer than ``ranges`` keys."""
    n = ranges or partitions(df)
    keyed = df.withColumn("_key", key)
    # a hash of its own: the key may end in the content hash, of which the sample must hold all values
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *[F.col(c) for c in df.columns]), 11) / F.lit(float(1 << 53))
    share = df.agg((F.lit(float(SAMPLED * n)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("_share"))
    sample = keyed.select("_key", unit.alias("_unit")).crossJoin(F.broadcast(share)).where("_unit < _share")
    every = sample.agg(F.array_sort(F.collect_list("_key")).alias("_a"))
    size = F.size("_a")
    cuts = F.when(size > 0, F.transform(F.sequence(F.lit(1), F.lit(max(n - 1, 1))),
                                        lambda i: F.element_at("_a", F.floor(i * size / n).cast("int") + 1)))
    found = keyed.crossJoin(F.broadcast(every.select(F.array_distinct(cuts).alias("_b")))).withColumn("_range", F.lit(0))
    # binary search written out, a step a column: no function is called for a row
    for power in reversed(range((n - 1).bit_length())):
        step = 1 << power
        passed = F.get("_b", F.col("_range") + (step - 1)) <= F.col("_key")
        found = found.withColumn("_range", F.col("_range") + F.when(passed, step).otherwise(0))
    return found.drop("_b")


def weight_before(df: DataFrame, order: list[tuple[Column, bool]], out: str, weight: str | None = None,
                  by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``out``: the number of rows (or the sum of ``weight``) that come before each row of its group in
    ``order``, which must tell all rows of a group apart but for equal ones."""
    by = by or []
    group = F.struct(*by, F.lit(0).alias("_"))
    key = sort_key(df, [(F.col(b), True) for b in by] + order)
    dealt = with_range(df, key, ranges).withColumn("_g", group)
    own = F.col(weight) if weight else F.lit(1)
    totals = dealt.groupBy("_g", "_range").agg(F.sum(own).alias("_sum"))
    # a group's ranges; without groups as many as the setting says, whatever the data's size
    earlier = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_g", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_g", "_range").orderBy("_key")
    ahead = F.coalesce(F.sum(own).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) \
        if weight else F.row_number().over(inside) - 1
    placed = dealt.withColumn("_ahead", ahead).join(offsets if by else F.broadcast(offsets), ["_g", "_range"])
    return placed.withColumn(out, (F.col("_offset") + F.col("_ahead")).cast("long")).drop("_g", "_range", "_key", "_ahead", "_offset")


def quantiles(df: DataFrame, c: str, qs: dict[str, float], by: list[str], ranges: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles of ``c`` per group by counting: the rows of every range
    are counted, and only those of the ranges that hold a wanted position are looked at again, as
    counted values."""
    vals = df.select(F.struct(*by, F.lit(0).alias("_")).alias("_g"), F.col(c).cast("double").alias("_v")).where("_v IS NOT NULL")
    order = [(F.col("_g")[b], True) for b in by] + [(F.col("_v"), True)]
    dealt = with_range(vals, sort_key(vals, order), ranges).select("_g", "_range", "_v")
    group = Window.partitionBy("_g")
    counts = dealt.groupBy("_g", "_range").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_all", F.sum("_n").over(group)) \
        .withColumn("_from", F.sum("_n").over(group.orderBy("_range")) - F.col("_n"))
    place = {name: (F.col("_all") - 1) * F.lit(float(q)) for name, q in qs.items()}
    wanted = [f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]
    holds = F.exists(F.array(*wanted), lambda p: (p >= F.col("_from")) & (p < F.col("_from") + F.col("_n")))
    hits = counts.where(holds).select("_g", "_range", "_from", "_all")
    values = dealt.join(hits, ["_g", "_range"]).groupBy("_g", "_range", "_v") \
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_from").alias("_from"), F.first("_all").alias("_all"))
    within = Window.partitionBy("_g", "_range").orderBy("_v")
    placed = values.withColumn("_to", F.sum("_n").over(within) + F.col("_from"))

    def at(spot: Column) -> Column:
        return F.max(F.when((spot >= F.col("_to") - F.col("_n")) & (spot < F.col("_to")), F.col("_v")))

    ends = {name: (at(F.floor(p)), at(F.ceil(p))) for name, p in place.items()}
    # without groups there is one row, of nulls where there are no values
    picked = placed.groupBy(*(["_g"] if by else [])).agg(F.first("_all").alias("_all"),
                                      *[F.struct(low.alias("low"), high.alias("high")).alias(name) for name, (low, high) in ends.items()])
    return picked.select(*[F.col("_g")[b].alias(b) for b in by],
                         *[(F.col(name)["low"] + (p - F.floor(p)) * (F.col(name)["high"] - F.col(name)["low"])).alias(name)
                           for name, p in place.items()])
