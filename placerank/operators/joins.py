"""Joins (JN1–JN13), including the grid-cell radius join.

Spark's planner turns a distance predicate into a nested-loop join; the radius
join here is rewritten into an equi-join on grid cells (each left row is
replicated to its 3×3 neighbourhood), followed by the exact haversine filter.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.text import norm_key
from ..session import cut_lineage

EARTH_RADIUS_M = 6371000.0
METERS_PER_DEG = math.pi * EARTH_RADIUS_M / 180.0
# Small-side size bound (bytes) under which an explicit broadcast is allowed.
BROADCAST_LIMIT = 64 * 1024 * 1024
PAIR_ROWS = 4096       # rows of each side of a cell that one task call holds against each other, on average
PAIR_CELLS = 1 << 18   # distances that it holds at once
GROUPS = 16            # right-side groups that it sums at once


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    """Optimizer size estimate of a plan (no job). Used to guard explicit broadcasts."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(str(size)) <= limit
    except Exception:  # pragma: no cover - estimate unavailable
        return False


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast only when the estimated size is under ``limit``; else a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def heavy_join(left: DataFrame, right: DataFrame, on, how: str = "inner", share: float = 0.002, salts: int = 64) -> DataFrame:
    """Equi-join for a left side in which few keys may hold most rows.

    One aggregate finds the keys with more than ``share`` of the left rows; there are fewer
    than 1 / ``share`` of them, so they are broadcast. Only their rows are dealt over
    ``salts`` tasks, and only their right rows are repeated. ``how``: inner, left,
    left_semi or left_anti.
    """
    on = _cols(on)
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    every = left.agg(F.count(F.lit(1)).alias("_every"))
    heavy = F.broadcast(sizes.crossJoin(F.broadcast(every)).where(F.col("_rows") > share * F.col("_every"))
                        .select(*[F.col(c).alias(f"_h_{c}") for c in on], F.lit(True).alias("_heavy")))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_h_{c}") for c in on])
    hash_ = F.xxhash64(*[F.col(c) for c in left.columns])
    dealt = left.join(heavy, same, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(hash_, F.lit(salts))).otherwise(0)) \
        .select(*left.columns, "_salt")
    each = F.when(F.col("_heavy"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = right.join(heavy, same, "left").withColumn("_salt", F.explode(each)).select(*right.columns, "_salt")
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def _finder(words: list[str]):
    """Function that names those of the distinct ``words`` that a text (UTF-8) holds. The first 8 bytes
    at every place, as one number, are looked up in a table of the words' beginnings for each length."""
    filed: dict[int, dict] = {}
    for word in words:
        own = word.encode()
        filed.setdefault(min(len(own), 8), {}).setdefault(int.from_bytes(own[:8], "big"), []).append((own, word))
    odd, tables = np.uint64(0x9E3779B97F4A7C15), {}
    for n, known in filed.items():
        codes, likely = np.array(sorted(known), dtype=np.uint64), np.zeros(1 << 18, bool)
        likely[codes * odd >> np.uint64(46)] = True
        tables[n] = codes, [known[x] for x in codes.tolist()], likely

    def find(text: bytes) -> list[str]:
        raw, out = np.frombuffer(text, np.uint8).astype(np.uint64), []
        code = raw
        for n in range(1, min(max(tables, default=0), len(raw)) + 1):
            code = code[:-1] << np.uint64(8) | raw[n - 1:] if n > 1 else code
            if n in tables:
                codes, own, likely = tables[n]
                met = code[likely[code * odd >> np.uint64(46)]]
                at = np.minimum(np.searchsorted(codes, met), len(codes) - 1)
                for i in np.unique(at[codes[at] == met]).tolist():
                    out += [word for b, word in own[i] if len(b) <= 8 or b in text]
        return out
    return find


def _holding(filed: list, key: str, name: str):
    """For Arrow batches (key, text, repeated): the names that each text holds. ``filed``: (name, its
    gram). Of a repeated key also the names of which it holds the gram only."""
    def run(batches):
        by_gram: dict[str, list] = {}
        for own, gram in filed:
            by_gram.setdefault(gram, []).append(own)
        names_in, grams_in = _finder([own for own, _ in filed]), _finder(list(by_gram))

        def rows(batch):
            at, found, held = [], [], []
            for row, (text, again) in enumerate(zip(batch.column("_text"), batch.column("_repeated").to_pylist())):
                text = text.as_buffer().to_pybytes()
                own = names_in(text)
                rest = [x for gram in grams_in(text) for x in by_gram[gram]] if again else []
                rest = [*set(rest).difference(own)]
                at += [row] * (len(own) + len(rest))
                found += own + rest
                held += [True] * len(own) + [False] * len(rest)
            at = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(key).take(at), pa.array(found, pa.string()), pa.array(held, pa.bool_()),
                                               batch.column("_repeated").take(at)], names=[key, name, "_held", "_repeated"])
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                yield rows(batch.slice(start, 500))
    return run


def contained_names(texts: DataFrame, key: str, c: str, names: DataFrame, name: str, size: int = 3,
                    small: int = BROADCAST_LIMIT // 8) -> DataFrame:
    """(key, name): which of the distinct ``names`` (a table of any size) each text holds.

    A name is filed under the gram of ``size`` characters that fewest names share (a shorter
    name under itself); a text is looked up by its distinct grams, and what meets is verified
    by a search in the text. Names of up to ``small`` bytes go to every task, which looks up and
    searches a text where it reads it; only more names are met by a join of the grams of the texts.
    ``key`` must be unique. Blank names are in no text.
    """
    def grams(t, n):
        # all places in one pass; taking substrings by place would read the text from its start each time
        return F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    listed = names.select(F.col(name).cast("string").alias("_name")).where("length(_name) > 0").distinct()
    filed = listed.select("_name", F.explode(F.when(F.length("_name") >= size, grams(F.col("_name"), size)).otherwise(F.array("_name"))).alias("_gram"))
    common = filed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_shared"))
    rarest = filed.join(common, "_gram").groupBy("_name").agg(F.min(F.struct("_shared", "_gram")).alias("_g")).select("_name", F.col("_g._gram").alias("_gram"))
    rarest = cut_lineage(rarest)
    text = F.coalesce(F.col(c).cast("string"), F.lit(""))
    if not fits_broadcast(rarest, small):
        own = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.flatten(F.array(*[grams(text, n) for n in range(1, size + 1)])))).alias("_gram"))
        met = own.join(rarest, "_gram").select("_key", "_name")
        held = texts.select(F.col(key), text.alias("_text")).join(met, F.col(key) == F.col("_key"))
        return held.where(F.instr(F.col("_text"), F.col("_name")) > 0).select(key, F.col("_name").alias(name))
    again = cut_lineage(texts.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key", F.lit(True).alias("_again")))
    read = texts.select(F.col(key), text.alias("_text")).where(F.col(key).isNotNull()) \
        .join(maybe_broadcast(again), F.col(key) == F.col("_key"), "left") \
        .select(key, "_text", F.coalesce("_again", F.lit(False)).alias("_repeated"))
    schema = read.select(key, F.lit("").alias(name), F.lit(True).alias("_held"), "_repeated").schema
    found = read.mapInArrow(_holding([tuple(r) for r in rarest.collect()], key, name), schema)
    if again.isEmpty():
        return found.select(key, name)
    # as in the join: each text of a repeated key meets the grams of all its texts
    times = found.where("_repeated").groupBy(key, name).agg((F.count(F.lit(1)) * F.count_if("_held")).alias("_n")).where("_n > 0")
    times = times.select(key, name, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i")).select(key, name)
    return found.where("NOT _repeated").select(key, name).unionByName(times)


def join_all(dfs: list[DataFrame], key, how: str = "inner", fill=None) -> DataFrame:
    """JN2/JN4: chain of joins on a shared key; ``fill`` replaces missing values
    (numeric columns) after outer joins."""
    key = _cols(key)
    res = reduce(lambda a, b: a.join(b, key, how), dfs)
    if fill is not None:
        res = res.fillna(fill)
    return res


def left_lookup(df: DataFrame, dim: DataFrame, left_key: str, right_key: str,
                cols: list[str] | None = None) -> DataFrame:
    """JN3: left join with differently named keys; the right key is dropped."""
    right = dim.select(right_key, *(cols or [c for c in dim.columns if c != right_key]))
    j = df.join(right, df[left_key] == right[right_key], "left")
    return j.drop(right[right_key])


def coalesce_from(df: DataFrame, other: DataFrame, key: str, cols: list[str],
                  prefer_other: bool = True) -> DataFrame:
    """JN6: take each column from ``other`` when present (or only fill gaps when
    ``prefer_other`` is false)."""
    o = other.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    j = df.join(o, key, "left")
    for c in cols:
        pair = (F.col(f"_o_{c}"), F.col(c)) if prefer_other else (F.col(c), F.col(f"_o_{c}"))
        j = j.withColumn(c, F.coalesce(*pair)) if c in df.columns else j.withColumn(c, F.col(f"_o_{c}"))
    return j.drop(*[f"_o_{c}" for c in cols])


def complete_domain(df: DataFrame, dim: DataFrame, key: str, score: str,
                    stat: str = "median") -> DataFrame:
    """JN7: add missing members of a fixed dimension and fill their score with the
    median (or mean) of the present scores. Extra members of ``df`` are kept."""
    from .agg import quantile_exact
    if stat == "median":
        fillv = quantile_exact(df, score, {"_fill": 0.5})
    else:
        fillv = df.agg(F.avg(F.col(score).cast("double")).alias("_fill"))
    full = dim.select(key).distinct().join(df, key, "full")
    return (full.crossJoin(F.broadcast(fillv))
            .withColumn(score, F.coalesce(F.col(score).cast("double"), F.col("_fill"))).drop("_fill"))


def append_missing(df: DataFrame, expected: DataFrame, key: str, value_col: str,
                   value: float | None = None, half_min: bool = False) -> DataFrame:
    """JN8: one constant row for each expected key that ``df`` lacks. The constant is
    ``value`` or, with ``half_min``, half the minimum of ``value_col`` in ``df``."""
    missing = expected.select(key).distinct().join(df.select(key), key, "left_anti")
    if half_min:
        m = df.agg((F.min(F.col(value_col).cast("double")) * 0.5).alias(value_col))
        filled = missing.crossJoin(F.broadcast(m))
    else:
        filled = missing.withColumn(value_col, F.lit(value))
    return df.unionByName(filled, allowMissingColumns=True)


def bridge_mean(bridge: DataFrame, scores: DataFrame, entity: str, region: str,
                cols: list[str], region_key: str | None = None) -> DataFrame:
    """JN9: entity ↔ many regions (``region`` holds an array or one value); mean of the
    regions' scores, regions without data skipped, 0 when none has data."""
    rk = region_key or region
    rcol = F.col(region)
    b = bridge.select(entity, F.explode_outer(rcol if dict(bridge.dtypes)[region].startswith("array")
                                              else F.array(rcol)).alias("_region"))
    s = scores.select(F.col(rk).alias("_region"), *cols)
    j = b.join(s, "_region", "left")
    return j.groupBy(entity).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols])


def resolve_alias(targets: DataFrame, aliases: DataFrame, master: DataFrame, target: str,
                  name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """JN10: match each target to the first master row whose raw or space-free name
    equals one of the target's candidates (own name, normalised, aliases both ways).

    ``aliases`` has columns (canonical, alias). ``order`` is the master order column.
    Returns (matched rows with ``target``, unmatched targets).
    """
    t = targets.select(target).distinct()
    own = t.select(target, F.col(target).alias("_cand"))
    canon_hit = aliases.select(F.col("canonical").alias(target), F.col("alias").alias("_cand"))
    # targets that appear as an alias get every alias of the same canonical name
    alias_hit = (aliases.alias("a").join(aliases.alias("b"), F.col("a.canonical") == F.col("b.canonical"))
                 .select(F.col("a.alias").alias(target), F.col("b.alias").alias("_cand")))
    listed = canon_hit.unionByName(alias_hit).join(t, target, "left_semi")
    cands = own.unionByName(listed)
    cands = cands.unionByName(cands.select(target, norm_key(F.col("_cand")).alias("_cand"))).distinct()
    m = master.select("*", norm_key(F.col(name)).alias("_norm"))
    raw = cands.join(m, cands["_cand"] == m[name]).select(target, *master.columns)
    nrm = (cands.withColumn("_cn", norm_key(F.col("_cand")))
           .join(m, F.col("_cn") == F.col("_norm")).select(target, *master.columns))
    hits = raw.unionByName(nrm).dropDuplicates([target, order])
    from .rank import first_by
    matched = first_by(hits, target, [F.col(order).asc()])
    unmatched = t.join(matched.select(target), target, "left_anti")
    return matched, unmatched


def cross_terms(df: DataFrame, col: str, words: list[str], out: str = "search_query",
                word_col: str = "suffix") -> DataFrame:
    """JN12: every row × every suffix word (a fixed literal list, safe to broadcast)."""
    w = df.sparkSession.createDataFrame([(x,) for x in words], f"{word_col} string")
    return df.crossJoin(F.broadcast(w)).withColumn(out, F.concat_ws(" ", F.col(col), F.col(word_col)))


# ---------------------------------------------------------------- radius join (JN5)

def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = p2 - p1
    dl = F.radians(lng2) - F.radians(lng1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def _ring_cells(band: Column, reach: float) -> Column:
    """Number of longitude cells of a latitude band that is ``reach`` degrees tall. A cell is at
    least as wide as the largest longitude difference, at the band's edge nearest to a pole, of
    two points ``reach`` apart; a band from which a pole can be reached is one cell."""
    edge = F.greatest(F.abs(band * reach), F.abs((band + 1) * reach))
    width = F.degrees(F.asin(F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians(edge)))) * (1 + 1e-9)
    return F.when(edge + reach >= 90.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 / width))).cast("long")


def _ring_cell(lng: Column, n: Column) -> Column:
    """Cell of a longitude among the ``n`` of its band, counted around the circle."""
    return F.least(F.floor(F.pmod(lng + 180.0, F.lit(360.0)) / 360.0 * n), n - 1).cast("long")


def _to_cells(left: DataFrame, right: DataFrame, radius_m: float, left_lat: str, left_lng: str, right_lat: str,
              right_lng: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the grid cell (_ci, _cj) in which they meet; left rows once for each cell around theirs."""
    reach = radius_m / METERS_PER_DEG * (1 + 1e-9)
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])

    def band(lat):
        return F.floor(F.col(lat).cast("double") / reach).cast("long")

    l = (left.withColumn("_ci", F.explode(F.transform(around, lambda d: band(left_lat) + d)))
         .withColumn("_n", _ring_cells(F.col("_ci"), reach))
         .withColumn("_cj", _ring_cell(F.col(left_lng).cast("double"), F.col("_n")))
         .withColumn("_cj", F.explode(F.array_distinct(
             F.transform(around, lambda d: F.pmod(F.col("_cj") + d, F.col("_n"))))))
         .drop("_n"))
    r = (right.filter(F.col(right_lat).isNotNull() & F.col(right_lng).isNotNull())
         .withColumn("_ci", band(right_lat))
         .withColumn("_cj", _ring_cell(F.col(right_lng).cast("double"), _ring_cells(F.col("_ci"), reach))))
    return l, r


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, *,
                left_lat: str = "lat", left_lng: str = "lng", right_lat: str = "lat",
                right_lng: str = "lng", max_abs_lat: float | None = None, dist_out: str = "dist_m",
                broadcast_left: bool | None = None) -> DataFrame:
    """All (left, right) pairs with haversine distance ≤ ``radius_m``, at any latitude and across
    the date line.

    The grid has latitude bands of the radius' height, each cut into its own number of
    longitude cells (``_ring_cells``), so any pair within the radius lies in neighbouring
    cells. Left rows are copied to the three bands around theirs and, in each, to three
    cells, then equi-joined on the cell of the right row. A small left side is broadcast;
    otherwise cells that hold many right rows (even all at one spot) are dealt over many
    tasks, to which their left rows are copied (``heavy_join``). ``max_abs_lat`` is accepted
    from earlier callers; the grid fits every latitude without it.
    Column names of the two sides must not clash (prefix them first).
    """
    l, r = _to_cells(left, right, radius_m, left_lat, left_lng, right_lat, right_lng)
    if broadcast_left is None:
        # the estimate does not see that every row is copied up to nine times
        broadcast_left = fits_broadcast(left, BROADCAST_LIMIT // 9)
    j = F.broadcast(l).join(r, ["_ci", "_cj"]) if broadcast_left else heavy_join(r, l, ["_ci", "_cj"])
    j = j.select(*left.columns, *right.columns)
    d = haversine_m(F.col(left_lat), F.col(left_lng), F.col(right_lat), F.col(right_lng))
    return j.withColumn(dist_out, d).filter(F.col(dist_out) <= radius_m)


def _distances(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """``haversine_m`` of all pairs, from radians."""
    a = np.sin((lat2 - lat1[:, None]) / 2) ** 2 + np.cos(lat1)[:, None] * np.cos(lat2) * np.sin((lng2 - lng1[:, None]) / 2) ** 2
    return 2.0 * EARTH_RADIUS_M * np.arcsin(np.sqrt(a))


def _summing(key: list[str], by: list[str], radii: list[float]):
    """Function of places (key, _lat, _lng) and of points (by, _lat, _lng, _n, _w) that share a cell, one row for each
    spot and group, to the sums of each place and group with a point in the largest radius. A distance is
    computed once for all groups of a spot."""
    widest = int(np.argmax(radii))
    margin = max(radii) / EARTH_RADIUS_M * (1 + 1e-9)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(np.argsort(left.column("_lat").to_numpy(), kind="stable"))
        lat, lng = (np.radians(left.column(c).to_numpy()) for c in ("_lat", "_lng"))
        spots, spot = np.unique(np.stack([right.column(c).to_numpy() for c in ("_lat", "_lng")], axis=1), axis=0, return_inverse=True)
        spot_lat, spot_lng, spot = *np.radians(spots.T), spot.ravel()
        group = np.zeros(len(spot), dtype=np.int64)
        for c in by:
            own = right.column(c).combine_chunks().dictionary_encode("encode")
            group = np.unique(group * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
        first = np.unique(group, return_index=True)[1]
        order = np.argsort(group, kind="stable")
        n, w = (right.column(c).fill_null(0).to_numpy().astype(np.float64) for c in ("_n", "_w"))
        slabs = []
        for g in range(0, len(first), GROUPS):
            size = min(GROUPS, len(first) - g)
            rows = order[slice(*np.searchsorted(group[order], [g, g + size]))]
            held, at = np.unique(spot[rows], return_inverse=True)
            at, odd = at * size + group[rows] - g, ~np.isfinite(w[rows])
            table = [np.bincount(at, weights=x, minlength=len(held) * size).reshape(len(held), size)
                     for x in (n[rows], np.where(odd, 0.0, w[rows]))]
            slabs.append((g, size, held, np.concatenate(table, axis=1),
                          [(spot[i], group[i] - g, w[i]) for i in rows[odd].tolist()]))
        out: list[list] = [[] for _ in range(2 + 3 * len(radii))]
        step = max(1, PAIR_CELLS // max(1, len(spots)))
        for a in range(0, len(lat), step):
            b = min(a + step, len(lat))
            lo, hi = np.searchsorted(spot_lat, [lat[a] - margin, lat[b - 1] + margin])
            if lo >= hi:
                continue
            every = _distances(lat[a:b], lng[a:b], spot_lat[lo:hi], spot_lng[lo:hi])
            for g, size, held, table, odd in slabs:
                i, j = np.searchsorted(held, [lo, hi])
                d = every if j - i == hi - lo else every[:, held[i:j] - lo]
                sums = []
                for r in radii:
                    inside = d <= r
                    both, far = inside.astype(np.float64) @ table[i:j], np.where(inside, d, 0.0) @ table[i:j, size:]
                    for s, k, x in odd:  # NaN and infinite weights count only where they are in reach
                        if lo <= s < hi:
                            met = every[:, s - lo] <= r
                            both[met, size + k] += x
                            far[met, k] += x * every[met, s - lo]
                    sums += [both[:, :size], both[:, size:], far]
                p, k = np.nonzero(sums[3 * widest])
                for o, x in zip(out, [p + a, first[g + k], *[x[p, k] for x in sums]]):
                    o.append(x)
        p, k, *sums = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({**{c: left.column(c).take(pa.array(p.astype(np.int64))) for c in key},
                         **{c: right.column(c).take(pa.array(k.astype(np.int64))) for c in by},
                         **{f"{('_n', '_w', '_wd')[i % 3]}_{i // 3}": x.astype(np.float64 if i % 3 else np.int64)
                            for i, x in enumerate(sums)}})
    return run


def radius_sums(places: DataFrame, points: DataFrame, key, radii: list[float], weight: str, *, by_right=None,
                place_lat="lat", place_lng="lng", point_lat="p_lat", point_lng="p_lng") -> DataFrame:
    """Per place and right-side group with a point in the largest radius: points (_n_0, ...), Σ weight (_w_0, ...) and
    Σ weight · distance (_wd_0, ...) within each radius.

    The sums of all pairs of ``radius_join``, on its grid, but no pair becomes a row: points at one spot are
    summed first, and a task takes up to ``PAIR_ROWS`` places and as many spots of a cell (more are
    dealt over several tasks) and sums over blocks of exact distances. So the distances grow with the places times
    the distinct spots around them, and what is shuffled with the places and the cells that they reach.
    """
    key, by = _cols(key), _cols(by_right)
    cell = ["_ci", "_cj"]
    own = places.select(*key, F.col(place_lat).cast("double").alias("_lat"), F.col(place_lng).cast("double").alias("_lng"))
    spots = points.where(F.col(point_lat).isNotNull() & F.col(point_lng).isNotNull()) \
        .groupBy(F.col(point_lat).cast("double").alias("_lat"), F.col(point_lng).cast("double").alias("_lng"), *by) \
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(weight).cast("double")).alias("_w"))
    l, r = _to_cells(own, spots, max(radii), "_lat", "_lng", "_lat", "_lng")

    def sized(df, out):
        return df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / PAIR_ROWS).cast("int").alias(out))

    # cells that hold both sides; blocks of each
    sizes = maybe_broadcast(cut_lineage(sized(l, "_lb").join(sized(r, "_rb"), cell)))

    def dealt(df, block, other, cols):
        return df.join(sizes, cell).withColumn(block, F.pmod(F.xxhash64(*cols), F.col(block)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    met = [*cell, "_lb", "_rb"]
    schema = StructType([*places.select(*key).schema, *points.select(*by).schema, *[
        StructField(f"{c}_{i}", t) for i in range(len(radii)) for c, t in (("_n", LongType()), ("_w", DoubleType()), ("_wd", DoubleType()))]])
    sums = dealt(l, "_lb", "_rb", [*key, "_lat", "_lng"]).groupBy(*met).cogroup(
        dealt(r, "_rb", "_lb", ["_lat", "_lng"]).groupBy(*met)).applyInArrow(_summing(key, by, [float(x) for x in radii]), schema)
    return sums.groupBy(*key, *by).agg(*[F.sum(f.name).alias(f.name) for f in schema if f.name not in key + by])


def weighted_distance(places: DataFrame, points: DataFrame, key, radii: list[float], weight: str,
                      *, by_right=None, place_lat="lat", place_lng="lng", point_lat="p_lat",
                      point_lng="p_lng") -> DataFrame:
    """AG7 after JN5: per place (and right-side group such as a date) and radius:
    points in radius, Σ weight, weight-averaged distance (missing when Σw is 0; the
    point count is then reported as 0). One pass at the largest radius (``radius_sums``) serves all
    radii; places without a hit appear with zeros.
    """
    key, by_right = _cols(key), _cols(by_right)
    wide = radius_sums(places, points, key, radii, weight, by_right=by_right, place_lat=place_lat, place_lng=place_lng,
                       point_lat=point_lat, point_lng=point_lng)
    long = wide.select(*key, *by_right, F.explode(F.array(*[
        F.struct(F.lit(r).cast("double").alias("radius_m"), F.col(f"_n_{i}").alias("_n"),
                 F.col(f"_w_{i}").alias("_w"), F.col(f"_wd_{i}").alias("_wd")) for i, r in enumerate(radii)])).alias("s"))
    long = long.select(*key, *by_right, "s.*")
    pos = F.coalesce(F.col("_w"), F.lit(0.0)) > 0
    long = long.select(*key, *by_right, "radius_m",
                       F.when(pos, F.col("_n")).otherwise(F.lit(0)).cast("long").alias("n_points"),
                       F.when(pos, F.col("_w")).otherwise(F.lit(0.0)).alias("weight_sum"),
                       F.when(pos, F.col("_wd") / F.col("_w")).alias("weighted_dist_m"))
    # every place (× right group) × radius, zeros where nothing is in range
    rad = places.sparkSession.createDataFrame([(float(r),) for r in radii], "radius_m double")
    frame = places.select(*key).distinct().crossJoin(F.broadcast(rad))  # × a literal radius list
    if by_right:
        # the output has one row per place × radius × right-side group (e.g. snapshot date);
        # the distinct groups are few, broadcast only when their estimated size is bounded
        frame = frame.crossJoin(maybe_broadcast(points.select(*by_right).distinct()))
    res = frame.join(long, key + by_right + ["radius_m"], "left")
    return res.fillna({"n_points": 0, "weight_sum": 0.0})
