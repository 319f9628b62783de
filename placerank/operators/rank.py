"""Ranking, ordering and top-k (WN1–WN8) without single-task global windows.

A global ``Window.orderBy`` (no partition keys) moves every row into one task.
Here positions come from counted ranges of the sort key (``operators.ranges``):
a row's position is the count of the ranges before its own plus its place in
its range. There is one path for every size. Rows that tie on the sort value
are told apart by a content hash, so a hot tie is spread over ranges; a
competition rank counts the rows of every distinct value before it ranks the
values, so a hot value is one row there.

Per-key top-k uses a two-level cut (first k inside ``(key, salt)`` sub-groups,
then k per key over at most ``salts·k`` candidates), which is exact and keeps a
hot key from landing in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import row_hash, weight_before

SALTS = 64
BLOCK_ROWS = 10_000   # positions of a group that one window holds


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def _sort_expr(c: str | Column, ascending: bool) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.asc_nulls_last() if ascending else col.desc_nulls_last()


def _directed(o) -> tuple[Column, bool]:
    """(column, ascending) of a name, a column, a pair, or a sorted column of a plain name."""
    if isinstance(o, tuple):
        return (F.col(o[0]) if isinstance(o[0], str) else o[0]), o[1]
    if isinstance(o, str):
        return F.col(o), True
    sorted_name = re.fullmatch(r"Column<'(\w+) (ASC|DESC) NULLS (?:FIRST|LAST)'>", str(o))
    return (F.col(sorted_name[1]), sorted_name[2] == "ASC") if sorted_name else (o, True)


def global_index(df: DataFrame, order: list, out: str = "_gidx", partitions: int | None = None) -> DataFrame:
    """1-based position of every row in ``order``: names, columns or (column, ascending)
    pairs, missing values last.

    Rows equal on ``order`` get distinct positions by their content; only equal rows are
    exchangeable. Positions are the same in every reading of the result."""
    keys = [_directed(o) for o in order] + [(row_hash(df), True)]
    return weight_before(df, keys, out, ranges=partitions).withColumn(out, F.col(out) + 1)


def rank_min(df: DataFrame, c: str, out: str, by=None, ascending: bool = False) -> DataFrame:
    """Competition rank (ties share the lowest rank); missing value → null rank."""
    by = _cols(by)
    values = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("_times"))
    ranked = weight_before(values, [(F.col(c), ascending)], "_before", weight="_times", by=by)
    ranks = ranked.select(*[F.col(k).alias(f"_r_{k}") for k in [*by, c]], (F.col("_before") + 1).alias(out))
    same = [F.col(b).eqNullSafe(F.col(f"_r_{b}")) for b in by] + [F.col(c) == F.col(f"_r_{c}")]
    return df.join(ranks, same, "left").select(*df.columns, out)


def rank_columns(df: DataFrame, key, specs: dict[str, str], ascending: bool = False,
                 method: str = "min") -> DataFrame:
    """Several independent ranks of one entity table (``key`` unique): each rank is
    computed on its own (key, value) projection and joined back on the key, so the
    plan grows linearly with the number of ranks instead of doubling per rank."""
    key = _cols(key)
    res = df
    for c, out in specs.items():
        part = df.select(*key, c)
        if method == "min":
            r = rank_min(part, c, out, ascending=ascending)
        else:
            r = row_rank(part, c, out, tiebreak=key, ascending=ascending)
        res = res.join(r.select(*key, out), key, "left")
    return res


def row_rank(df: DataFrame, c: str, out: str, tiebreak=None, by=None, ascending: bool = False) -> DataFrame:
    """Sequential rank 1..n after sorting (``np.arange`` after ``sort_values``).

    ``tiebreak`` (e.g. the entity name) makes the order total and the result stable.
    """
    order = [(F.col(c), ascending), *[_directed(t) for t in _cols(tiebreak)], (row_hash(df), True)]
    return weight_before(df, order, out, by=_cols(by)).withColumn(out, F.col(out) + 1)


def cap_per_key(df: DataFrame, key, order: list[Column], k: int, out: str | None = None,
                salts: int = SALTS) -> DataFrame:
    """First ``k`` rows per key in ``order`` (row_number ≤ k), skew-safe and exact.

    ``order`` must be a total order (include a unique tie-break) for stable output.
    """
    key = _cols(key)
    salt = F.pmod(row_hash(df), F.lit(salts))
    w1 = Window.partitionBy(*key, "_salt").orderBy(*order)
    cand = (df.withColumn("_salt", salt).withColumn("_rn1", F.row_number().over(w1))
            .filter(F.col("_rn1") <= k).drop("_rn1", "_salt"))
    w2 = Window.partitionBy(*key).orderBy(*order)
    rn = out or "_rn"
    res = cand.withColumn(rn, F.row_number().over(w2)).filter(F.col(rn) <= k)
    return res if out else res.drop(rn)


def nth_per_group(df: DataFrame, key, order: list[Column], n: int) -> DataFrame:
    """The n-th row per group (1-based) or nothing when the group is smaller."""
    return cap_per_key(df, key, order, n, out="_nth").filter(F.col("_nth") == n).drop("_nth")


def first_by(df: DataFrame, key, order: list[Column]) -> DataFrame:
    """First row per key in ``order``."""
    return cap_per_key(df, key, order, 1)


def sort(df: DataFrame, spec: list[tuple[str, bool]]) -> DataFrame:
    """Multi-key sort with mixed directions, nulls last."""
    return df.orderBy(*[_sort_expr(c, asc) for c, asc in spec])


def top_k(df: DataFrame, c: str, k: int, ascending: bool = False, tiebreak=None) -> DataFrame:
    """The k best rows (TakeOrderedAndProject: each task keeps only k)."""
    order = [_sort_expr(c, ascending)] + [_sort_expr(t, True) for t in _cols(tiebreak)]
    return df.orderBy(*order).limit(k)


def context_window(df: DataFrame, group, pos: str, hit: str, k: int = 1, dense: bool = False,
                   block: int = BLOCK_ROWS) -> DataFrame:
    """WN7: rows that are a hit or within ``k`` rows of one in the order of ``pos``, inside each group.

    A group is cut into blocks of ``block`` consecutive positions, and the ``k`` rows at a
    block's ends are copied to its neighbour, so a group of any size is many windows.
    ``dense`` says that ``pos`` numbers the rows of a group without gaps or repeats;
    otherwise they are numbered first.
    """
    group, size = _cols(group), max(block, k, 1)
    rows = df.withColumn("_i", F.col(pos).cast("long")) if dense else \
        weight_before(df, [(F.col(pos), True), (row_hash(df), True)], "_i", by=group)
    home = F.floor(F.col("_i") / size)
    inside = F.pmod(F.col("_i"), F.lit(size))
    blocks = F.array_compact(F.array(home, F.when(inside < k, home - 1), F.when(inside >= size - k, home + 1)))
    copied = rows.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(*group, "_block").orderBy("_i").rowsBetween(-k, k)
    return (copied.withColumn("_near", F.max(F.col(hit).cast("int")).over(w))
            .filter((F.col("_near") == 1) & (F.col("_block") == F.col("_home"))).drop("_near", "_i", "_home", "_block"))
