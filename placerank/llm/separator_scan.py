"""Token counts of documents in flat token files without an index, by their end-of-document ids.

Files are read in blocks of ``BLOCK_BYTES``; a task searches its block for the end id with one
vectorised comparison and reports where the ends lie. A document that crosses blocks is put
together from summaries alone: the last end before a block is a prefix maximum over the file's
blocks, and the number of ends before it a prefix sum. No task ever holds more than a block.

Defined cases: ids behind the last end form an unfinished document, which is reported with
``finished`` false; two ends in a row hold an empty document (one token, its end); files without
ids have no documents; a block without any end passes the open document on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .token_files import store

BLOCK_BYTES = 4 << 20


def blocks(files: DataFrame) -> DataFrame:
    """(path, width, block, first, n_ids) of files (path, width, n_ids): a row for each block."""
    per = F.floor(F.lit(BLOCK_BYTES) / F.col("width")).cast("long")
    last = F.greatest(F.ceil(F.col("n_ids") / per) - 1, F.lit(0)).cast("long")
    out = files.where("n_ids > 0").select("path", "width", F.col("n_ids").alias("all_ids"), per.alias("per"),
                                          F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    first = F.col("block") * F.col("per")
    return out.select("path", "width", "block", first.alias("first"),
                      F.least(F.col("per"), F.col("all_ids") - first).alias("n_ids"))


def ends_in(ids: np.ndarray, end_id: int) -> np.ndarray:
    return np.flatnonzero(ids == end_id)


def scan_blocks(files: DataFrame, end_id: int) -> DataFrame:
    """Blocks with ``ends``: places of the end ids in the file."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
                        ("ends", pa.list_(pa.int64()))])

    def search(batches):
        for batch in batches:
            for b in batch.to_pylist():
                system, at = store(b["path"])
                with system.open_input_file(at) as f:
                    raw = f.read_at(b["n_ids"] * b["width"], b["first"] * b["width"])
                found = ends_in(np.frombuffer(raw, dtype=f"<u{b['width']}"), end_id) + b["first"]
                yield pa.RecordBatch.from_pylist([{k: b[k] for k in ("path", "block", "first", "n_ids")} |
                                                  {"ends": found}], schema=schema)

    return blocks(files).repartition("path", "block").mapInArrow(
        search, "path string, block long, first long, n_ids long, ends array<long>")


def token_counts(files: DataFrame, end_id: int) -> DataFrame:
    """One row for each document of the files: path, ordinal (from 0), start (ids before it in the
    file), n_tokens (with the end id), finished."""
    found = saved(scan_blocks(files, end_id), "ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.withColumn("carry", F.coalesce(F.max(F.array_max("ends")).over(before) + 1, F.lit(0))) \
        .withColumn("seen", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))) \
        .withColumn("is_last", F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull())
    whole = stitched.select("path", "seen", "carry", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.element_at("ends", F.col("i")) + 1)
    whole = whole.select("path", (F.col("seen") + F.col("i")).alias("ordinal"), start.alias("start"),
                         (F.col("end") + 1 - start).alias("n_tokens"), F.lit(True).alias("finished"))
    open_start = F.coalesce(F.array_max("ends") + 1, F.col("carry"))
    rest = stitched.where("is_last").select(
        "path", (F.col("seen") + F.size("ends")).alias("ordinal"), open_start.alias("start"),
        (F.col("first") + F.col("n_ids") - open_start).alias("n_tokens"), F.lit(False).alias("finished"))
    return whole.unionByName(rest.where("n_tokens > 0"))
