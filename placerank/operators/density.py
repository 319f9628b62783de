"""Density clusters (TX17): neighbours within a distance through a grid, core points, components.

A point's cell is its coordinates divided by the distance; all neighbours lie in the cells around
it, so the neighbour search is an equi-join on cells. Points with enough neighbours are cores,
linked cores are one cluster (named by its smallest key), other points next to a core join the
smallest such cluster, and the rest are outliers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def near_pairs(points: DataFrame, key: str, dims: list[str], eps: float) -> DataFrame:
    """All ordered pairs (a, b) of different keys at most ``eps`` apart."""
    around = [F.lit(i).cast("long") for i in (-1, 0, 1)]
    cells = [F.floor(F.col(c) / eps).cast("long") for c in dims]
    kept = points.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in dims]))
    home = kept.select(F.col(key).alias("b"), *[F.col(c).alias(f"_y{i}") for i, c in enumerate(dims)],
                       *[cell.alias(f"_c{i}") for i, cell in enumerate(cells)])
    left = kept.select(F.col(key).alias("a"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(dims)],
                       *[cell.alias(f"_c{i}") for i, cell in enumerate(cells)])
    for i in range(len(dims)):
        left = left.withColumn("_d", F.explode(F.array(*around))).withColumn(f"_c{i}", F.col(f"_c{i}") + F.col("_d")).drop("_d")
    square = reduce(lambda a, b: a + b, [(F.col(f"_x{i}") - F.col(f"_y{i}")) * (F.col(f"_x{i}") - F.col(f"_y{i}")) for i in range(len(dims))])
    return left.join(home, [f"_c{i}" for i in range(len(dims))]).where((F.col("a") != F.col("b")) & (F.sqrt(square) <= eps)).select("a", "b")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached. ``links`` holds both directions. Each
    round takes the least root among the neighbours and then the root of that root, so paths are
    halved; it is written once and the loop ends when nothing changes."""
    links = cut_lineage(links)
    roots = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    while True:
        least = links.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("_least"))
        told = roots.join(least, F.col("node") == F.col("a"), "left") \
            .select("node", F.col("root").alias("_old"), F.least("root", "_least").alias("_new"))
        up = roots.select(F.col("node").alias("_up"), F.col("root").alias("_over"))
        new = cut_lineage(told.join(up, F.col("_new") == F.col("_up"), "left")
                          .select("node", F.least("_new", "_over").alias("root"), (F.least("_new", "_over") < F.col("_old")).alias("_moved")))
        roots = new.select("node", "root")
        if new.where("_moved").limit(1).count() == 0:
            return roots


def density_clusters(points: DataFrame, key: str, dims: list[str], eps: float, min_points: int, out: str = "topic") -> DataFrame:
    """(key, ``out``): the cluster of each point, −1 for outliers and points without coordinates.
    ``key`` must be unique. A core has ``min_points`` points within ``eps``, itself included."""
    pairs = cut_lineage(near_pairs(points, key, dims, eps))
    cores = cut_lineage(pairs.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("_n")).where(F.col("_n") >= min_points).select(F.col("a").alias("node")))
    if min_points <= 1:
        cores = points.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in dims])).select(F.col(key).alias("node"))
    to_core = pairs.join(cores, F.col("b") == F.col("node"), "left_semi")
    roots = connected(cores, to_core.join(cores, F.col("a") == F.col("node"), "left_semi"))
    border = to_core.join(cores, F.col("a") == F.col("node"), "left_anti").join(roots, F.col("b") == F.col("node")) \
        .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root"))
    found = roots.unionByName(border)
    return points.select(key).join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("root", F.lit(-1)).alias(out))
