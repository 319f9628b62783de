"""Query catalogue: each entry pairs a Spark query over the test tables with the
equivalent SQL that DuckDB runs on the same parquet files.

Doubles listed in ``doubles`` are rounded to ``digits`` on both sides so the
comparison does not depend on floating-point summation order (``doubles`` may
also map a column to its own digit count). Rounding is
``floor(x·10^d + TIE) / 10^d`` on both engines: plain IEEE arithmetic, so equal
inputs give bit-equal outputs (Spark's ``round`` works on the decimal text of a
double and DuckDB's on its binary value, which split exact ties). The tie point
is moved off .5 because inputs with few decimals produce exact .5 ties that
summation-order noise would split; at TIE the data has no such ties.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIE = 0.4876543211


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: dict = field(default_factory=dict)
    digits: int = 6


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None, doubles=(), digits: int = 6):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        dd = dict(doubles) if isinstance(doubles, dict) else {c: digits for c in doubles}
        REGISTRY[name] = Entry(fn, sql, dd, digits)
        return fn
    return deco


# Inputs at least this large but split into fewer files than cores are spread over the cores.
SPREAD_BYTES = 4 * 1024 * 1024


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read a test table. The driver's tables are single files with one row group, which
    Spark can only scan in one task; when a table has fewer files than cores and is
    not tiny, the scan is spread round-robin so per-row work (text, regex) uses every
    core. Real inputs (many files/row groups) are left alone — no extra shuffle."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no estimate: leave the scan as is
        return df
    if len(df.inputFiles()) < cores and size >= SPREAD_BYTES:
        df = df.repartition(cores)
    return df


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    e = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = e.fn(spark, sf_dir)
        if e.doubles:
            df = df.withColumns({c: F.floor(F.col(c).cast("double") * float(10 ** d) + TIE) / float(10 ** d)
                                 for c, d in e.doubles.items()})
        return df
    run.__name__ = name
    return run


def oracle_text(name: str) -> str | None:
    e = REGISTRY[name]
    if e.sql is None:
        return None
    if not e.doubles:
        return e.sql
    repl = ", ".join(f"floor(CAST({c} AS DOUBLE) * {float(10 ** d)!r} + {TIE!r}) / {float(10 ** d)!r} AS {c}"
                     for c, d in e.doubles.items())
    return f"SELECT * REPLACE ({repl}) FROM (\n{e.sql}\n) AS _q"
