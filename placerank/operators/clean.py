"""Row and column cleaning operators (PR6–PR11, PR17, PR19, PR20, PR23, IO11 helpers).

All are narrow transformations (no shuffle) except ``assign_cyclic``, which
needs a global position and uses the range-partitioned index from ``rank``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, keyword_regex


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def drop_missing(df: DataFrame, cols) -> DataFrame:
    """PR6: drop rows with a missing value in any of ``cols``."""
    return df.dropna(subset=_cols(cols))


def fill(df: DataFrame, value, cols=None) -> DataFrame:
    """PR7: fill missing values by a constant (type-compatible columns only)."""
    return df.fillna(value, subset=_cols(cols) or None)


def drop_labels(df: DataFrame, c: str, labels: list[str]) -> DataFrame:
    """PR8: exclude subtotal/total/junk labels; a null label is kept (pandas ``~isin``)."""
    return df.filter(F.col(c).isNull() | ~F.col(c).isin(list(labels)))  # pushable to the scan


def time_code_filter(df: DataFrame, day: str, hour: str, code: str | None = None, *,
                     dates: list[str] | None = None, hours: tuple[int, int] | None = None,
                     code_len: int = 8) -> DataFrame:
    """PR10: keep listed days and an inclusive hour range; hour zero-padded to 2 and the
    area code cut to its first ``code_len`` characters (columns replaced in place)."""
    out = df.withColumn(hour, F.lpad(F.col(hour).cast("string"), 2, "0")).withColumn(day, F.col(day).cast("string"))
    if code:
        out = out.withColumn(code, F.substring(F.col(code).cast("string"), 1, code_len))
    if dates is not None:
        out = out.filter(F.col(day).isin(list(dates)))
    if hours is not None:
        allowed = [f"{h:02d}" for h in range(hours[0], hours[1] + 1)]
        out = out.filter(F.col(hour).isin(allowed))
    return out


def row_sum_fallback(df: DataFrame, preferred: str, out: str, protected: list[str]) -> DataFrame:
    """PR11: the named total column when it exists, else the null-skipping sum of all
    numeric columns that are not protected keys (decided on the schema, no job)."""
    if preferred in df.columns:
        return df.withColumn(out, F.col(preferred).cast("double"))
    numeric = [c for c, t in df.dtypes if c not in protected and
               (t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal"))]
    total = F.lit(0.0)
    for c in numeric:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumn(out, total)


def exclude_keywords(df: DataFrame, c: str, words: list[str]) -> DataFrame:
    """PR17: drop rows whose text contains any listed word (null text is kept)."""
    return df.filter(~contains_any(F.col(c), keyword_regex(words)))


def drop_ids(df: DataFrame, id_col: str, ids) -> DataFrame:
    """PR19: delete listed rows by a stable id (a DataFrame of ids or a literal list)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_anti")
    return df.filter(~F.col(id_col).isin(list(ids)))


def split_cohort(df: DataFrame, c: str, names: list[str] | None = None, pattern: str | None = None,
                 flag: str = "in_cohort") -> tuple[DataFrame, DataFrame]:
    """PR20: rows whose key is in ``names`` or matches ``pattern`` vs the rest."""
    cond = F.lit(False)
    if names:
        cond = cond | F.coalesce(F.col(c).isin(list(names)), F.lit(False))
    if pattern:
        cond = cond | contains_any(F.col(c), pattern)
    marked = df.withColumn(flag, cond)
    return marked.filter(F.col(flag)).drop(flag), marked.filter(~F.col(flag)).drop(flag)


def assign_cyclic(df: DataFrame, order, labels: list[str], out: str = "label") -> DataFrame:
    """PR23: row i (in ``order``) gets ``labels[i mod n]`` — position, not content, decides."""
    from .rank import global_index
    idx = global_index(df, _cols(order))
    arr = F.array(*[F.lit(x) for x in labels])
    return idx.withColumn(out, F.element_at(arr, (F.pmod(F.col("_gidx") - 1, F.lit(len(labels))) + 1).cast("int"))).drop("_gidx")


# ------------------------------------------------------------ column names (IO11)

def normalise_header(name: str) -> str:
    """trim, lower, inner spaces → ``_``."""
    return re.sub(r"\s+", "_", name.strip().lower())


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keep the first of duplicate column names (metadata only)."""
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append(i)
    if len(keep) == len(df.columns):
        return df
    tmp = [f"_c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*tmp)
    return renamed.select(*[F.col(f"_c{i}").alias(df.columns[i]) for i in keep])


def resolve_columns(df: DataFrame, candidates: dict[str, list[str]], required: list[str] | None = None,
                    normalise: bool = True, substring: bool = False) -> DataFrame:
    """Rename columns to standard names by ordered candidate lists (metadata only).

    A candidate matches a header exactly (after normalisation when asked); with
    ``substring`` a header containing the candidate also matches. A missing
    required column raises with the list of present columns.
    """
    present = df.columns
    norm = {c: (normalise_header(c) if normalise else c) for c in present}
    mapping = {}
    for std, cands in candidates.items():
        hit = None
        for cand in cands:
            key = normalise_header(cand) if normalise else cand
            for c in present:
                if norm[c] == key or (substring and key in norm[c]):
                    hit = c
                    break
            if hit:
                break
        if hit and hit not in mapping:
            mapping[hit] = std
    missing = [r for r in (required or []) if r not in mapping.values()]
    if missing:
        raise ValueError(f"required columns {missing} not found; present: {present}")
    return df.withColumnsRenamed(mapping)
