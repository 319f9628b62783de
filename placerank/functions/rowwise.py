"""Null-skipping row-wise statistics as plain arithmetic (AG11, AG12).

Written as sums of ``coalesce``/``when`` terms rather than higher-order array
lambdas so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_sum(cols: list, skip_null: bool = True) -> Column:
    terms = [F.coalesce(_c(c), F.lit(0.0)) if skip_null else _c(c) for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def row_count(cols: list) -> Column:
    out = None
    for c in cols:
        t = F.when(_c(c).isNotNull(), F.lit(1)).otherwise(F.lit(0))
        out = t if out is None else out + t
    return out


def row_mean(cols: list) -> Column:
    """Mean of the present values; null when all are missing (``mean(axis=1)``)."""
    n = row_count(cols)
    return F.when(n > 0, row_sum(cols) / n)


def row_weighted_mean(weights: dict) -> Column:
    """Σ w·x / Σ w over present values only; null when none is present."""
    num = None
    den = None
    for c, w in weights.items():
        x = _c(c)
        t = F.coalesce(x * F.lit(float(w)), F.lit(0.0))
        d = F.when(x.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0))
        num = t if num is None else num + t
        den = d if den is None else den + d
    return F.when(den > 0, num / den)
