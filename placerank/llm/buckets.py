"""From buckets of a banded sketch to components, without all pairs of a bucket.

First every node is tested against one centre: of the centres of its buckets (the node that meets
most others, as the original of a group of copies does) the one that meets most. The links found
merge most of a large group. Then only buckets that still hold nodes of several components are
looked at. Nodes tied by such buckets form a field; a field is cut into blocks of bounded size, and
a task takes two blocks and compares their nodes from different components by vectorised sketches,
confirming the likely ones, until the components meet. It gives out only the links that join two
components, so no pair of nodes from different components that shares a bucket is left uncompared,
and no task gives out more links than it has nodes.

:func:`resolve_keys` is for sketches with few, short bands, under which unlike nodes often meet by
chance: chains of such meetings would tie most nodes to one field. It tests every node against the
centre of each of its buckets and then works on single buckets, so that its work grows with the
nodes and only within one bucket with the square of what is left there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, settled
from .components import components

BLOCK = 1024
SMALL = 16       # nodes of a bucket compared without arrays
BIN_ROWS = 4096  # rows of small buckets dealt to one task call, on average


def shared_buckets(members: DataFrame) -> DataFrame:
    """Stored rows (key, node, centre, meets) of the keys that hold at least two nodes; meets:
    how often the centre meets others."""
    keys = members.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"),
                                      F.count(F.lit(1)).alias("held")) \
        .where("_lo <> _hi").select(F.col("key").alias("_k"), "held")
    rows = saved(members.select("key", "node").join(keys.hint("merge"), F.col("key") == F.col("_k")).drop("_k"), "buckets")
    meets = rows.groupBy("node").agg(F.sum("held").alias("meets")).withColumnRenamed("node", "_n")
    ranked = rows.join(meets, F.col("node") == F.col("_n")).select("key", "node", "meets")
    centre = ranked.groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("_minus"))).alias("_c")) \
        .select(F.col("key").alias("_k"), (-F.col("_c._minus")).alias("centre"), "_c.meets")
    return saved(rows.select("key", "node").join(centre, F.col("key") == F.col("_k")).drop("_k"), "buckets")


def centred(rows: DataFrame) -> DataFrame:
    """Like :func:`shared_buckets`, of rows (key, node, held) of which every key is known to hold several
    nodes, ``held``; among nodes that meet as many the centre is chosen by hash."""
    meets = rows.groupBy("node").agg(F.sum("held").alias("meets")).withColumnRenamed("node", "_n")
    rank = F.shiftleft(F.least(F.col("meets"), F.lit(2 ** 42)), 20) + F.pmod(F.xxhash64("node"), F.lit(2 ** 20))
    ranked = rows.join(meets.hint("merge"), F.col("node") == F.col("_n")).select("key", "node", rank.alias("rank"))
    centre = ranked.groupBy("key").agg(F.max_by("node", "rank").alias("centre")).withColumnRenamed("key", "_k")
    return saved(rows.select("key", "node").join(centre.hint("merge"), F.col("key") == F.col("_k")).drop("_k"), "buckets")


class Field:
    """Nodes of one or two blocks. A subclass says which of the nodes ``js`` may be linked with
    node ``i``, likeliest first, and whether a pair is linked."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows

    def likely(self, i: int, js: np.ndarray) -> np.ndarray:
        return js

    def linked(self, i: int, j: int) -> bool:
        raise NotImplementedError


def settle(rows: pd.DataFrame, field: Callable[[pd.DataFrame], Field]) -> list[tuple[int, int]]:
    """Links that join components of the rows (node, component, block, ...; a frame or its columns by
    name), one for each node, in the order of the nodes."""
    own, links = field(rows), []
    if len(rows["node"]) <= SMALL:
        return _settle_small(own, *(np.asarray(rows[c]).tolist() for c in ("node", "component", "block")))
    node, block = np.asarray(rows["node"]), np.asarray(rows["block"])
    label = np.unique(np.asarray(rows["component"]), return_inverse=True)[1]
    two = len(np.unique(block)) > 1
    for i in range(len(node) - 1):
        js = np.arange(i + 1, len(node))
        js = js[(label[js] != label[i]) & ((block[js] != block[i]) | (not two))]
        for j in own.likely(i, js) if len(js) else ():
            if label[j] != label[i] and own.linked(i, int(j)):
                links.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return links


def _settle_small(own: Field, node: list, label: list, block: list) -> list[tuple[int, int]]:
    """:func:`settle` without arrays: of a few nodes, all pairs that ``own`` finds likely."""
    links, two = [], len(set(block)) > 1
    for i in range(len(node) - 1):
        js = [j for j in range(i + 1, len(node)) if label[j] != label[i] and not (two and block[j] == block[i])]
        for j in own.likely(i, np.array(js)).tolist() if js else ():
            if label[j] != label[i] and own.linked(i, j):
                links.append((node[i], node[j]))
                label = [label[i] if x == label[j] else x for x in label]
    return links


def _placed(shared: DataFrame, label: DataFrame) -> DataFrame:
    return saved(shared.join(label.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
                 .select("key", "node", "centre", F.coalesce("component", "node").alias("component")), "placed")


def resolve(shared: DataFrame, test: Callable[[DataFrame], DataFrame], payload: DataFrame,
            field: Callable[[pd.DataFrame], Field]) -> DataFrame:
    """(node, component) of the linked nodes. ``shared``: rows of :func:`shared_buckets`; ``test``:
    pairs (a, b) to those that are links; ``payload``: (node, ...) with what ``field`` compares."""
    first = shared.where("node <> centre").groupBy(F.col("node").alias("b")) \
        .agg(F.max(F.struct("meets", "centre")).alias("_c")).select(F.col("_c.centre").alias("a"), "b")
    links = saved(test(first), "links")
    label = components(links)
    placed = _placed(shared, label)
    open_keys = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")) \
        .where("_lo <> _hi").select("key")
    rows = saved(placed.join(open_keys, "key", "left_semi").select("node", "centre", "component").distinct(), "open")
    if rows.isEmpty():
        return label
    tied = components(rows.select(F.col("node").alias("a"), F.col("centre").alias("b"))) \
        .select(F.col("node").alias("_n"), F.col("component").alias("field"))
    nodes = rows.select("node", "component").distinct().join(tied, F.col("node") == F.col("_n")).drop("_n")
    nodes = saved(nodes, "fields")
    sizes = nodes.groupBy("field").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")) \
        .withColumnRenamed("field", "_f")
    dealt = nodes.join(sizes, F.col("field") == F.col("_f")).drop("_f") \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .join(payload.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n") \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
        return pd.DataFrame(settle(rows, field), columns=["a", "b"], dtype="int64")

    more = saved(dealt.groupBy("field", "lo", "hi").applyInPandas(meet, "a long, b long"), "links")
    return components(links.unionByName(more)) if not more.isEmpty() else label


def resolve_keys(shared: DataFrame, test: Callable[[DataFrame], DataFrame], payload: DataFrame,
                 field: Callable[[pd.DataFrame], Field]) -> DataFrame:
    """Like :func:`resolve`, bucket by bucket. Small buckets are dealt to tasks many at a time, one
    of more than ``BLOCK`` nodes by pairs of its blocks."""
    pairs = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = saved(test(pairs), "links")
    label = components(links)

    def still_open() -> DataFrame:
        placed = _placed(shared, label)
        # all pairs of a bucket of two nodes have been tested
        open_keys = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"),
                                              F.count(F.lit(1)).alias("held")) \
            .where("_lo <> _hi AND held > 2").select("key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
        return placed.select("key", "node", "component").join(open_keys.hint("merge"), "key")

    rows = settled(still_open, "open")
    n = rows.count()
    if not n:
        return label
    bins = -(-n // BIN_ROWS)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("bin", F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(bins)))) \
        .join(payload.withColumnRenamed("node", "_n").hint("merge"), F.col("node") == F.col("_n")).drop("_n") \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "node"]).sort_values(["key", "node"], ignore_index=True)
        key, found = rows["key"].to_numpy(), []
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            found += settle({c: x[a:b] for c, x in columns.items()}, field)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64").drop_duplicates()

    more = saved(dealt.groupBy("bin", "lo", "hi").applyInPandas(meet, "a long, b long"), "links")
    return components(links.unionByName(more)) if not more.isEmpty() else label
