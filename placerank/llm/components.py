"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no component is gathered anywhere; the number of
steps grows with the logarithm of the number of nodes. Each step's links are written to the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MOST_STEPS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (a > b). Large star: each node's larger neighbours are tied to the smallest node
    of its neighbourhood; small star: its smaller neighbours and itself are."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")) \
            .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m"))
    tied = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that it reaches."""
    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "links")
    before = None
    for _ in range(MOST_STEPS):
        now = saved(_star(_star(now, True), False), "links")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("links did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
