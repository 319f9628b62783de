"""Incremental review intake (ST1) and rolling snapshot means (ST2).

Batch forms are plain DataFrame plans; stream forms use Structured Streaming
(watermarked de-duplication, ``foreachBatch`` for the order-dependent quota,
and a streaming aggregate in update/complete mode).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import cap_per_key


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def intake(df: DataFrame, id_col: str, ts, key, body: str | None = None,
           quota: int | None = None) -> DataFrame:
    """ST1 (batch): each id accepted once (earliest arrival by ``ts``, a column or a
    list such as [batch, ts]), blank bodies skipped, at most ``quota`` accepted rows
    per key in arrival order (ties by id)."""
    kept = df
    if body:
        kept = kept.filter(F.col(body).isNotNull() & (F.trim(F.col(body).cast("string")) != ""))
    order = [F.col(t).asc() for t in _cols(ts)] + [F.col(id_col).asc()]
    first = cap_per_key(kept, id_col, order, 1)
    if quota is None:
        return first
    return cap_per_key(first, key, order, quota)


def intake_stream(stream: DataFrame, id_col: str, ts: str, body: str | None = None,
                  delay: str = "1 hour") -> DataFrame:
    """ST1 (stream): blank bodies dropped, duplicate ids removed within the watermark."""
    s = stream
    if body:
        s = s.filter(F.col(body).isNotNull() & (F.trim(F.col(body).cast("string")) != ""))
    return s.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def quota_stream(stream: DataFrame, id_col: str, ts: str, key: str, quota: int, body: str | None = None) -> DataFrame:
    """ST1 (stream): at most ``quota`` rows per key, each id once per key, earliest first in a batch.

    The state of a key is the ids it has accepted, at most ``quota`` of them, so neither the
    state nor the work of a batch grows with what is stored. State and offsets are committed
    together: a batch that is run again finds the state from before it and accepts the same
    rows. A late row is accepted while its key has room. Rows without a key or an id are left
    out, as are blank bodies when ``body`` is given.
    """
    import pandas as pd
    rows = stream.where(F.col(key).isNotNull() & F.col(id_col).isNotNull())
    if body:
        rows = rows.filter(F.col(body).isNotNull() & (F.trim(F.col(body).cast("string")) != ""))
    kind = stream.schema[id_col].dataType.simpleString()

    def accept(_, frames, state):
        have = list(state.get[0]) if state.exists else []
        room, best = quota - len(have), None
        for pdf in frames:  # a part of the key's batch at a time; only the first ``room`` rows are held
            fresh = pdf[~pdf[id_col].isin(have)]
            best = fresh if best is None else pd.concat([best, fresh])
            best = best.sort_values([ts, id_col], kind="stable").drop_duplicates(id_col).head(max(room, 0))
        if best is not None and len(best):
            state.update((have + best[id_col].tolist(),))
            yield best

    return rows.groupBy(key).applyInPandasWithState(accept, stream.schema, f"ids array<{kind}>", "append", "NoTimeout")


def quota_sink(target_path: str, key, id_col: str, ts: str, quota: int):
    """``foreachBatch`` writer applying the per-key quota against what is already stored
    in ``target_path`` (parquet). Exact when batches arrive in time order. It reads the stored
    rows in every batch; a stream that keeps its own state uses ``quota_stream``."""
    key = _cols(key)

    def stored(spark) -> bool:
        """Whether a batch has been stored; an unreadable target is an error, not an empty one."""
        try:
            spark.read.format("binaryFile").load(target_path).limit(0).count()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def write(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        seen, fresh = None, batch
        if stored(spark):
            have = spark.read.schema(batch.schema).parquet(target_path)
            seen = have.groupBy(*key).agg(F.count(F.lit(1)).alias("_have"))
            fresh = batch.join(have.select(id_col), id_col, "left_anti")
        ranked = cap_per_key(fresh, key, [F.col(ts).asc(), F.col(id_col).asc()], quota, out="_rn")
        if seen is not None:
            ranked = ranked.join(seen, key, "left").fillna({"_have": 0})
            ranked = ranked.filter(F.col("_rn") + F.col("_have") <= quota).drop("_have")
        ranked.drop("_rn").write.mode("append").parquet(target_path)
    return write


def snapshot_mean(df: DataFrame, keys, m: str, out: str | None = None) -> DataFrame:
    """ST2 (batch or stream): mean of ``m`` over all snapshots per key. On a stream
    run it with output mode ``complete`` or ``update``."""
    return df.groupBy(*_cols(keys)).agg(F.avg(F.col(m).cast("double")).alias(out or f"{m}_mean"),
                                       F.count(F.lit(1)).alias("n_snapshots"))


def merge_snapshots(df: DataFrame, path: str, snapshot: str, keys, m: str) -> None:
    """ST2: put the sums and counts of ``m`` per key of each snapshot of ``df`` into the table at
    ``path``, a folder a snapshot. A snapshot that comes again replaces its own part, so the same
    file twice changes nothing; a snapshot must come whole. For a stream, call it from
    ``foreachBatch``: a batch that is run again writes the same parts. Rows without a snapshot
    are left out."""
    told = df.where(F.col(snapshot).isNotNull()).groupBy(snapshot, *_cols(keys)) \
        .agg(F.sum(F.col(m).cast("double")).alias("_sum"), F.count(F.col(m).cast("double")).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(snapshot).parquet(path)


def merged_mean(spark, path: str, keys, m: str, out: str | None = None) -> DataFrame:
    """ST2: the mean over all merged snapshots, as ``snapshot_mean`` over all their rows."""
    return spark.read.parquet(path).groupBy(*_cols(keys)).agg((F.sum("_sum") / F.sum("_n")).alias(out or f"{m}_mean"),
                                                             F.sum("_rows").alias("n_snapshots"))
