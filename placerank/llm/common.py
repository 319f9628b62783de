"""Helpers shared by the training-data operators.

A *word* is a maximal run of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); in Python ``bytes.split()`` cuts at exactly those characters.
Intermediate tables go to the shared folder of the session (``spark.checkpoint.dir``), never
to a machine-local one, so that they outlive a lost executor.
"""

from __future__ import annotations

import ctypes
import posixpath
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_C = ctypes.CDLL(None)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder of the session."""
    return posixpath.join(ensure_checkpoint_dir(spark).rstrip("/"), "placerank-llm", f"{kind}-{uuid.uuid4().hex}")


_WRITTEN: ContextVar[list | None] = ContextVar("written", default=None)


def saved(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back. Within :func:`settled`
    the shuffle files that the write needs go as soon as it is done."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, kind)
    if (written := _WRITTEN.get()) is None:
        df.write.parquet(path)
    else:
        was = spark.conf.get(CLEAN_SETTING, None)
        spark.conf.set(CLEAN_SETTING, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(CLEAN_SETTING) if was is None else spark.conf.set(CLEAN_SETTING, was)
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame], kind: str) -> DataFrame:
    """``saved(build(), kind)``; the tables that were saved while it was built are then deleted."""
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        df = build()
    finally:
        _WRITTEN.reset(token)
    out, spark = saved(df, kind), df.sparkSession
    for path in written:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python tasks in Arrow batches of at most ``BATCH_BYTES`` (a longer single text
    goes alone), whatever the number of their rows. A limit that the session has set stays."""
    if spark.conf.get(BYTES_SETTING, None) is None:
        spark.conf.set(BYTES_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Hand memory that a finished batch has freed back to the system: workers live from stage to
    stage, and Arrow's pool and the C library otherwise keep what they once took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def word_count(text: str = "text") -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def small_side(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast when its counted ``rows`` are at most ``most_rows``;
    beyond that it is left to a shuffled join."""
    return F.broadcast(df) if rows <= most_rows else df


def rows_each(df: DataFrame, count: str) -> DataFrame:
    """Repeat each row ``count`` times with ``copy`` from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
