"""Closed-form statistical Column functions (no Python in the hot path).

Neither Spark nor DuckDB ships ``erf``; the standard normal CDF is written with
the double-precision rational approximation published by Hart (1968) in the
form given by West (2005), "Better approximations to cumulative normal
functions". The same text is emitted for SQL so that oracle and engine agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients (highest power first).
HART_P = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165,
          33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_Q = [8.83883476483184e-2, 1.75566716318264, 16.064177579207,
          86.7807322029461, 296.564248779674, 637.333633378831,
          793.826512519948, 440.413735824752]
HART_SPLIT = 7.07106781186547
HART_FAR = 37.0
SQRT_2PI = 2.506628274631


def _horner(a: Column, coefs: list[float]) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * a + F.lit(c)
    return acc


def normal_cdf(x: Column | str) -> Column:
    """Φ(x) as a Column expression; null in, null out."""
    x = F.col(x) if isinstance(x, str) else x
    a = F.abs(x)
    e = F.exp(-(a * a) / 2.0)
    near = e * _horner(a, HART_P) / _horner(a, HART_Q)
    far = e / (F.lit(SQRT_2PI) * (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))))
    tail = (F.when(a >= HART_FAR, F.lit(0.0))
            .when(a < HART_SPLIT, near)
            .otherwise(far))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x > 0, 1.0 - tail).otherwise(tail)


def _horner_sql(a: str, coefs: list[float]) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc}) * {a} + {c!r}"
    return acc


def normal_cdf_sql(x: str) -> str:
    """The same Φ as SQL text (DuckDB and Spark SQL both accept it)."""
    a = f"abs({x})"
    e = f"exp(-({a}) * ({a}) / 2.0)"
    near = f"({e}) * ({_horner_sql(a, HART_P)}) / ({_horner_sql(a, HART_Q)})"
    far = (f"({e}) / ({SQRT_2PI} * ({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / "
           f"({a} + 4.0 / ({a} + 0.65))))))")
    tail = (f"(CASE WHEN {a} >= {HART_FAR} THEN 0.0 WHEN {a} < {HART_SPLIT} "
            f"THEN {near} ELSE {far} END)")
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0 THEN 1.0 - {tail} "
            f"ELSE {tail} END)")


def sigmoid100(z: Column | str) -> Column:
    """100 / (1 + e^-z)."""
    z = F.col(z) if isinstance(z, str) else z
    return F.lit(100.0) / (1.0 + F.exp(-z))


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """least/greatest skip nulls in Spark; a missing value must stay missing."""
    c = F.col(c) if isinstance(c, str) else c
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)
