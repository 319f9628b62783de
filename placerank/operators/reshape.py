"""Reshape and set operations (RS1–RS7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ensure_suffix


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def pivot_wide(df: DataFrame, idx, col: str, val: str, values: list, fmt: str = "{col}_{v}",
               agg=F.first) -> DataFrame:
    """RS1: long → wide with named output columns. ``values`` are given explicitly so
    Spark does not run a job to discover them."""
    g = df.groupBy(*_cols(idx)).pivot(col, values).agg(agg(val))
    return g.withColumnsRenamed({str(v): fmt.format(col=val, v=v) for v in values})


def explode_key(df: DataFrame, arr: str, out: str | None = None) -> DataFrame:
    """RS2: one row per list element; empty lists and blank elements dropped."""
    out = out or arr
    e = df.withColumn(out, F.explode_outer(F.col(arr)))
    return e.filter(F.col(out).isNotNull() & (F.trim(F.col(out).cast("string")) != ""))


def explode_delimited(df: DataFrame, c: str, sep: str = ",", out: str | None = None,
                      suffix: str | None = None) -> DataFrame:
    """RS3: delimited text → rows, trimmed, optional missing-suffix completion."""
    out = out or c
    e = df.withColumn(out, F.explode(F.split(F.col(c), sep))).withColumn(out, F.trim(F.col(out)))
    e = e.filter(F.col(out) != "")
    return e.withColumn(out, ensure_suffix(F.col(out), suffix)) if suffix else e


def wide_summary(df: DataFrame, key, by: str, values: list, metrics: list[str],
                 fmt: str = "{m}_{v}") -> DataFrame:
    """RS4: per-``by`` tables side by side (one pivot with several aggregates)."""
    aggs = [F.first(m).alias(m) for m in metrics]
    g = df.groupBy(*_cols(key)).pivot(by, values).agg(*aggs)
    ren = {}
    for v in values:
        for m in metrics:
            ren[f"{v}_{m}" if len(metrics) > 1 else str(v)] = fmt.format(m=m, v=v)
    return g.withColumnsRenamed(ren)


def union_all(dfs: list[DataFrame], allow_missing: bool = True) -> DataFrame:
    """RS5: row append by name; ragged columns filled with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def distinct_rows(df: DataFrame, subset=None) -> DataFrame:
    """RS6: whole-row distinct or subset distinct (any representative row)."""
    return df.dropDuplicates(_cols(subset) or None)


def first_distinct(df: DataFrame, subset, order) -> DataFrame:
    """RS6 'keep first': the first row in ``order`` per subset key (skew-safe top-1)."""
    from .rank import first_by
    return first_by(df, subset, [F.col(o).asc() if isinstance(o, str) else o for o in _cols(order)])


def replicate_group(df: DataFrame, key: str, src: str, targets: list[str]) -> DataFrame:
    """RS7: copy the rows of group ``src`` to every target group; other rows stay."""
    t = df.sparkSession.createDataFrame([(x,) for x in targets], f"_t string")
    copies = df.filter(F.col(key) == src).crossJoin(F.broadcast(t)).withColumn(key, F.col("_t")).drop("_t")
    rest = df.filter(~F.coalesce(F.col(key) == src, F.lit(False)))
    return rest.unionByName(copies)
