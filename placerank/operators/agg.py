"""Aggregations (AG1–AG18).

Everything is a hash aggregate with map-side partial aggregation, so a hot
key is collapsed before the shuffle. Exact quantiles are selected by counting
ranges of values, not from a per-group buffer that would hold a hot group's
values in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_number
from ..functions.text import to_array
from .ranges import quantiles


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def share(cond: Column) -> Column:
    """AG4: share of rows meeting ``cond`` (null condition counts as no)."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def group_stats(df: DataFrame, by, **aggs: Column) -> DataFrame:
    """AG1/AG2/AG3: ``groupBy(by).agg(name=expr, ...)``; null keys dropped like pandas."""
    by = _cols(by)
    kept = df
    for b in by:
        kept = kept.filter(F.col(b).isNotNull())
    return kept.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()])


def shannon(df: DataFrame, key, cat: str, out: str = "diversity", count_out: str = "n_items") -> DataFrame:
    """AG5: −Σ p·ln p of category shares per key.

    Written as ln N − Σ nᵢ ln nᵢ / N over the per-category counts: one partial
    aggregate for the counts and one for the sums, no window and no join.
    """
    key = _cols(key)
    clean = df.filter(F.col(cat).isNotNull())
    for k in key:
        clean = clean.filter(F.col(k).isNotNull())
    counts = clean.groupBy(*key, cat).agg(F.count(F.lit(1)).alias("_ni"))
    n = F.sum("_ni")
    s = F.sum(F.col("_ni") * F.log(F.col("_ni")))
    return counts.groupBy(*key).agg(n.alias(count_out), (F.log(n) - s / n).alias(out))


def richness_score(df: DataFrame, key, cat: str, distinct: bool = False, out: str = "richness",
                   count_out: str = "n_items", diversity_out: str = "diversity") -> DataFrame:
    """AG6: count × (1 + H); with ``distinct`` over unique (key, category) pairs."""
    base = df.select(*_cols(key), cat)
    if distinct:
        base = base.dropDuplicates()
    h = shannon(base, key, cat, out=diversity_out, count_out=count_out)
    return h.withColumn(out, F.col(count_out) * (1.0 + F.col(diversity_out)))


def quantile_exact(df: DataFrame, c: str, qs: dict[str, float], by=None) -> DataFrame:
    """Linear-interpolation quantiles (pandas ``quantile``), exact, per group.

    ``qs`` maps output name → q. Rows are counted in ranges of (group, value); only
    those of a range that holds a wanted position are read again, as counted values,
    so neither a hot group nor a hot value lands in one task.
    """
    return quantiles(df, c, qs, _cols(by))


def stats_row(df: DataFrame, cols: list[str], stats=("median", "mean", "min", "max", "std")) -> DataFrame:
    """AG13: one row of global statistics for several columns (``{col}_{stat}``): one aggregate, and
    one selection for all medians over the unpivoted columns. A column without values has nulls."""
    simple = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp,
              "std_pop": F.stddev_pop, "count": F.count}
    row = df.agg(F.lit(1).alias("_one"), *[simple[s](F.col(c).cast("double")).alias(f"{c}_{s}") for c in cols for s in stats if s in simple])
    if "median" in stats:
        named = [F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in cols]
        found = quantiles(df.select(F.inline(F.array(*named))), "_v", {"_med": 0.5}, ["_name"])
        row = row.crossJoin(F.broadcast(found.groupBy().pivot("_name", cols).agg(F.first("_med")))
                            .withColumnsRenamed({c: f"{c}_median" for c in cols}))
    return row.select(*[f"{c}_{s}" for c in cols for s in stats])


def fill_half_min(df: DataFrame, c: str, out: str | None = None, factor: float = 0.5,
                  all_missing: float = 0.0) -> DataFrame:
    """AG14: missing → factor × (minimum of present values); 0 if none present."""
    out = out or c
    m = df.agg(F.min(F.col(c).cast("double")).alias("_min"))
    fill_value = F.coalesce(F.col("_min"), F.lit(all_missing)) * F.lit(factor)
    return (df.crossJoin(F.broadcast(m)).withColumn(out, F.coalesce(F.col(c).cast("double"), fill_value))
            .drop("_min"))


def value_counts(df: DataFrame, c: str, out: str = "count") -> DataFrame:
    """AG15: frequency table, most common first (ties by value)."""
    return (df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(out))
            .orderBy(F.col(out).desc(), F.col(c).asc()))


def profile(df: DataFrame) -> DataFrame:
    """AG16: one row per column — type, missing count and share, numeric min/max/mean.

    A single aggregate job over the table; the wide result is unpivoted.
    """
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for name, dtype in df.dtypes:
        aggs.append(F.sum(F.when(F.col(name).isNull(), 1).otherwise(0)).alias(f"{name}__miss"))
        if dtype in numeric or dtype.startswith("decimal"):
            for s, f in (("min", F.min), ("max", F.max), ("mean", F.avg)):
                aggs.append(f(F.col(name).cast("double")).alias(f"{name}__{s}"))
    one = df.agg(*aggs)
    parts = []
    for name, dtype in df.dtypes:
        is_num = dtype in numeric or dtype.startswith("decimal")
        nul = F.lit(None).cast("double")
        parts.append(F.struct(
            F.lit(name).alias("column"), F.lit(dtype).alias("dtype"),
            F.col(f"{name}__miss").cast("long").alias("n_missing"),
            F.when(F.col("_rows") > 0, F.col(f"{name}__miss") / F.col("_rows") * 100.0).alias("pct_missing"),
            (F.col(f"{name}__min") if is_num else nul).alias("min"),
            (F.col(f"{name}__max") if is_num else nul).alias("max"),
            (F.col(f"{name}__mean") if is_num else nul).alias("mean")))
    return (one.select(F.col("_rows").cast("long").alias("n_rows"), F.explode(F.array(*parts)).alias("p"))
            .select("n_rows", "p.*"))


def describe_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG16: per numeric column count, mean, sample σ, minimum, quartiles and maximum: one aggregate,
    and one selection of all quartiles over the unpivoted columns."""
    simple = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in cols])))
    told = long.groupBy("column").agg(*[f("_v").alias(name) for name, f in simple.items()])
    return told.join(quantiles(long, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column"]), "column", "left")


def code_lengths(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG16: how often each length occurs among the values of code columns, missing values left out."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.length(F.col(c).cast("string")).alias("length")) for c in cols])))
    return long.where(F.col("length").isNotNull()).groupBy("column", "length").agg(F.count(F.lit(1)).alias("count"))


def type_counts(df: DataFrame) -> DataFrame:
    """AG16: number of columns of each type, with the number of rows of the table."""
    names = [t for _, t in df.dtypes]
    kinds = F.array(*[F.struct(F.lit(t).alias("dtype"), F.lit(names.count(t)).cast("long").alias("n_columns")) for t in dict.fromkeys(names)])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(kinds))


def explode_sum(df: DataFrame, region: str, m: str, out_sum: str = "total", out_avg: str = "mean",
                key_out: str = "region") -> DataFrame:
    """AG17: a place measure summed and averaged per region; the region field may be a
    scalar or a list; unparsable numbers count as 0."""
    r = df.select(F.explode(to_array(F.col(region))).alias(key_out),
                  to_number(F.col(m), fill=0.0).alias("_m"))
    r = r.filter(F.col(key_out).isNotNull() & (F.trim(F.col(key_out)) != ""))
    return r.groupBy(key_out).agg(F.sum("_m").alias(out_sum), F.avg("_m").alias(out_avg))


def select_top_quantile(df: DataFrame, key: str, m: str, q: float = 0.75, global_q: float = 0.85,
                        keep=None) -> DataFrame:
    """AG9: rows ≥ the group's q-quantile ∪ rows ≥ the global quantile ∪ rows of the
    always-keep groups, whole-row distinct."""
    thr = quantile_exact(df, m, {"_thr": q}, by=key)
    glob = quantile_exact(df, m, {"_gthr": global_q})
    from .joins import heavy_join
    marked = heavy_join(df, thr, key, "left").crossJoin(F.broadcast(glob))
    chosen = F.coalesce(F.col(m) >= F.col("_thr"), F.lit(False)) | F.coalesce(F.col(m) >= F.col("_gthr"), F.lit(False))
    if keep:
        chosen = chosen | F.coalesce(F.col(key).isin(list(keep)), F.lit(False))
    return marked.where(chosen).select(*df.columns).distinct()


def ensure_min_members(selected: DataFrame, source: DataFrame, key: str, m: str, n: int = 2,
                       tiebreak=None) -> DataFrame:
    """AG10: for groups with fewer than ``n`` selected rows add the source's n-th best row
    (nothing if the source group is smaller). Appended without de-duplication."""
    from .rank import nth_per_group
    sizes = selected.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") <= n - 1)
    order = [F.col(m).desc_nulls_last()] + [F.col(t).asc() for t in _cols(tiebreak)]
    nth = nth_per_group(source.join(sizes.select(key), key, "left_semi"), key, order, n)
    return selected.unionByName(nth)


# ------------------------------------------------------------ metric registry (AG18)

METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_metric(code: str):
    """Decorator: dataset code → function(DataFrame) returning (key, metrics...)."""
    def deco(fn):
        METRICS[code] = fn
        return fn
    return deco


def run_metrics(datasets: dict[str, DataFrame], key: str, fill: float | None = 0.0,
                registry: dict | None = None) -> DataFrame:
    """Run every registered metric whose dataset is present and full-outer join by key."""
    from .joins import join_all
    reg = METRICS if registry is None else registry
    frames = [fn(datasets[code]) for code, fn in reg.items() if code in datasets]
    if not frames:
        raise ValueError("no registered metric has a dataset")
    return join_all(frames, key, how="full", fill=fill)
