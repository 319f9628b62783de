"""Scaler and normaliser family (SC1–SC13).

Every method needs a few statistics of the column; they come from one
aggregate (global or per group) that is joined back — a single-row frame is
broadcast, per-group statistics join on the group keys. No keyless windows.
The value for degenerate inputs (constant column, all missing) differs per
call site in the reference and is therefore a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clip as _clip
from ..functions.stats import normal_cdf, sigmoid100

METHODS = ("minmax", "zscore", "zcdf", "zcdf_squeezed", "zcdf_margin", "tscore",
           "sigmoid", "mean_relative")


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def attach_stats(df: DataFrame, aggs: dict[str, Column], by=None) -> DataFrame:
    """Add aggregate statistics as columns: broadcast one-row cross join, or group join."""
    by = _cols(by)
    exprs = [e.alias(n) for n, e in aggs.items()]
    if not by:
        stats = df.agg(*exprs)
        return df.crossJoin(F.broadcast(stats))
    stats = df.groupBy(*by).agg(*exprs)
    return df.join(stats, by, "left")


def _round(c: Column, rounding: int | None, half_even: bool) -> Column:
    if rounding is None:
        return c
    return F.bround(c, rounding) if half_even else F.round(c, rounding)


def scale(df: DataFrame, c: str, out: str | None = None, method: str = "minmax", **kw) -> DataFrame:
    """Scale column ``c`` into ``out`` (see :func:`scale_many` for the parameters)."""
    return scale_many(df, [dict(c=c, out=out, method=method, **kw)], by=kw.get("by"))


def scale_many(df: DataFrame, specs: list[dict], by=None) -> DataFrame:
    """Apply several scalers with ONE statistics aggregate and one join.

    Each spec is a dict with ``c`` and optional ``out``, ``method`` and:

    method        formula
    minmax        top·(x−min)/(max−min), ``reverse`` → top·(1−norm)
    zscore        (x−μ)/σ
    zcdf          top·Φ((x−μ)/σ)
    zcdf_squeezed ((1−2e)·clip(Φ, p, 1−p) + e)·top with e = 0.5/n (n rows)
    zcdf_margin   eps + clip(Φ(sharp·z), eps/100, 1−eps/100)·(top−2·eps)
    tscore        50 + 10·(x−μ)/σ
    sigmoid       top/(1+e^−z) (``z_out`` keeps z)
    mean_relative clip(50·x/mean, 0, 100)

    ``constant`` is the value when the spread is zero (or undefined) and
    ``all_missing`` when no value is present; with ``degenerate_all_rows``
    those values are given to every row, missing ones included (the
    reference's ``Series([50]*len)``). ``ddof`` selects population (0) or
    sample (1) standard deviation; ``zero_missing`` treats 0 as missing;
    ``rounding`` rounds half-even (numpy) unless ``half_even=False``.
    """
    aggs: dict[str, Column] = {"_n_rows": F.count(F.lit(1))}
    plans = []
    for i, spec in enumerate(specs):
        p = dict(method="minmax", reverse=False, ddof=0, zero_missing=False, constant=0.0,
                 all_missing=None, degenerate_all_rows=False, top=100.0, rounding=None,
                 half_even=True, eps=None, clip_p=None, sharp=1.0, z_out=None, out=None)
        p.update({k: v for k, v in spec.items() if k != "by"})
        if p["method"] not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        c = p["c"]
        p["out"] = p["out"] or f"{c}_{p['method']}"
        x = F.col(c).cast("double")
        if p["zero_missing"]:
            x = F.when(x != 0, x)
        p["x"] = x
        std = F.stddev_pop if p["ddof"] == 0 else F.stddev_samp
        t = f"_s{i}"
        p["t"] = t
        aggs[f"{t}_n"] = F.count(x)
        if p["method"] == "minmax":
            aggs[f"{t}_lo"], aggs[f"{t}_hi"] = F.min(x), F.max(x)
        elif p["method"] == "mean_relative":
            aggs[f"{t}_mu"] = F.avg(x)
        else:
            aggs[f"{t}_mu"], aggs[f"{t}_sd"] = F.avg(x), std(x)
        plans.append(p)
    s = attach_stats(df, aggs, by)
    new_cols = {}
    for p in plans:
        val, extra = _scaled(p)
        new_cols.update(extra)
        new_cols[p["out"]] = val
    return s.withColumns(new_cols).drop(*aggs.keys())


def _scaled(p: dict) -> tuple[Column, dict]:
    x, t, top, method = p["x"], p["t"], p["top"], p["method"]
    extra = {}
    if method == "minmax":
        lo, hi = F.col(f"{t}_lo"), F.col(f"{t}_hi")
        norm = (x - lo) / (hi - lo)
        val = (F.lit(1.0) - norm) * top if p["reverse"] else norm * top
        degenerate = (hi - lo) == 0
    elif method == "mean_relative":
        mu = F.col(f"{t}_mu")
        val = _clip(F.lit(50.0) * x / mu, 0.0, 100.0)
        degenerate = mu == 0
    else:
        mu, sd = F.col(f"{t}_mu"), F.col(f"{t}_sd")
        z = (x - mu) / sd
        degenerate = sd.isNull() | (sd == 0) | F.isnan(sd)
        if method == "zscore":
            val = z
        elif method == "zcdf":
            val = normal_cdf(z) * top
        elif method == "zcdf_squeezed":
            e = F.lit(0.5) / F.col("_n_rows")
            cp = p["clip_p"] if p["clip_p"] is not None else 1e-9
            phi = _clip(normal_cdf(F.when(degenerate, F.lit(0.0)).otherwise(z)), cp, 1.0 - cp)
            phi = F.when(x.isNotNull(), phi)
            val = ((F.lit(1.0) - 2.0 * e) * phi + e) * top
            degenerate = F.lit(False)
        elif method == "zcdf_margin":
            m = 0.5 if p["eps"] is None else p["eps"]
            phi = _clip(normal_cdf(z * F.lit(float(p["sharp"]))), m / 100.0, 1.0 - m / 100.0)
            val = F.lit(m) + phi * (top - 2.0 * m)
        elif method == "tscore":
            val = F.lit(50.0) + F.lit(10.0) * z
        else:  # sigmoid
            zz = F.when(x.isNotNull(), F.when(degenerate, F.lit(0.0)).otherwise(z))
            if p["z_out"]:
                extra[p["z_out"]] = zz
            val = sigmoid100(zz)
            degenerate = F.lit(False)
    val = _round(val, p["rounding"], p["half_even"])
    res = val
    if p["constant"] is not None:
        rows = F.lit(True) if p["degenerate_all_rows"] else x.isNotNull()
        res = F.when(degenerate & rows, F.lit(float(p["constant"]))).otherwise(res)
    if p["all_missing"] is not None:
        res = F.when(F.col(f"{t}_n") == 0, F.lit(float(p["all_missing"]))).otherwise(res)
    return res, extra


def percent_of_max(c: Column | str, total_weight: float, top: float = 100.0) -> Column:
    """SC12: raw / (top·Σw) · 100."""
    c = F.col(c) if isinstance(c, str) else c
    return c / F.lit(top * float(total_weight)) * 100.0


def display_scale(layers: list[DataFrame], c: str, out: str = "display_value",
                  log: bool = False, floor: float = 1.0) -> list[DataFrame]:
    """SC13: one shared 0–1 scale over several layers (linear, or log with a floor).

    Missing values get null and ``no_data = true``.
    """
    def v(col: Column) -> Column:
        col = col.cast("double")
        return F.log(F.greatest(col, F.lit(floor))) if log else col

    union = None
    for layer in layers:
        part = layer.select(v(F.col(c)).alias("_v"))
        union = part if union is None else union.unionByName(part)
    bounds = union.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    res = []
    for layer in layers:
        j = layer.crossJoin(F.broadcast(bounds))
        spread = F.col("_hi") - F.col("_lo")
        val = F.when(spread > 0, (v(F.col(c)) - F.col("_lo")) / spread).otherwise(F.lit(0.0))
        res.append(j.withColumn(out, F.when(F.col(c).isNotNull(), val))
                   .withColumn("no_data", F.col(c).isNull())
                   .drop("_lo", "_hi"))
    return res
