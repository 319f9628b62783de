"""Data-quality checks (DQ1–DQ3) as DataFrames (no driver loops)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched(targets: DataFrame, master: DataFrame, key: str, master_key: str | None = None) -> DataFrame:
    """DQ1: targets with no master row."""
    mk = master_key or key
    return targets.select(key).distinct().join(master.select(F.col(mk).alias(key)).distinct(), key, "left_anti")


def check_domain(df: DataFrame, key: str, expected: int) -> DataFrame:
    """DQ2: one row — distinct key count, expected count and whether they agree."""
    return (df.agg(F.countDistinct(key).alias("n_distinct"))
            .withColumn("expected", F.lit(expected).cast("long"))
            .withColumn("complete", F.col("n_distinct") == F.col("expected")))


def check_ranges(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """DQ3: per column — missing count and out-of-range count (one aggregate job)."""
    aggs = []
    for c, (lo, hi) in bounds.items():
        x = F.col(c).cast("double")
        aggs += [F.sum(F.when(x.isNull(), 1).otherwise(0)).alias(f"{c}__null"),
                 F.sum(F.when((x < lo) | (x > hi), 1).otherwise(0)).alias(f"{c}__out")]
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
                      F.col(f"{c}__null").cast("long").alias("n_null"),
                      F.col(f"{c}__out").cast("long").alias("n_out_of_range"))
             for c, (lo, hi) in bounds.items()]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
