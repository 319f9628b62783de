"""SQL text builders for the DuckDB oracle (same formulas as the Spark operators)."""

from __future__ import annotations

from ..functions.stats import normal_cdf_sql  # noqa: F401  (re-exported)


def minmax(col: str, alias: str, over: str = "", constant: float = 0.0, top: float = 100.0,
           reverse: bool = False) -> str:
    lo = f"min({col}) OVER ({over})"
    hi = f"max({col}) OVER ({over})"
    norm = f"(({col}) - {lo}) / ({hi} - {lo})"
    val = f"(1.0 - {norm}) * {top}" if reverse else f"{norm} * {top}"
    return (f"CASE WHEN ({col}) IS NULL THEN NULL WHEN {hi} = {lo} THEN {constant} "
            f"ELSE {val} END AS {alias}")


def row_mean(cols: list[str]) -> str:
    num = " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in cols)
    den = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in cols)
    return f"(CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END)"


def row_weighted_mean(weights: dict) -> str:
    num = " + ".join(f"coalesce(CAST({c} AS DOUBLE) * {float(w)}, 0.0)" for c, w in weights.items())
    den = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0.0 ELSE {float(w)} END)" for c, w in weights.items())
    return f"(CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END)"


def shannon_from_counts(n_col: str) -> tuple[str, str]:
    """(N, H) aggregate expressions over a per-category count column."""
    n = f"sum({n_col})"
    return f"CAST({n} AS BIGINT)", f"(ln({n}) - sum({n_col} * ln({n_col})) / {n})"


def clip(expr: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE least(greatest({expr}, {lo}), {hi}) END)"
