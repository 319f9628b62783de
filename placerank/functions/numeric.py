"""Tolerant value coercion as Column expressions (PR1–PR5, PR13, PR14)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Textual booleans that count as true (PR3).
TRUE_WORDS = ["true", "1", "y", "yes", "t", "가능", "있음", "enable", "enabled"]
# Tri-state parking flag words (CI4).
TRI_TRUE_WORDS = ["true", "1", "y", "yes", "있음"]
TRI_FALSE_WORDS = ["false", "0", "n", "no", "없음"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str, strip: str | None = None, dash_zero: bool = False,
              fill: float | None = None, dtype: str = "double") -> Column:
    """Coerce text to a number; unparsable → null (``to_numeric(errors='coerce')``).

    ``strip`` lists characters removed first (thousands commas), ``dash_zero``
    maps a lone ``-`` to 0 and ``fill`` replaces what stays missing.
    """
    s = F.trim(_c(c).cast("string"))
    if strip:
        s = F.regexp_replace(s, "[" + re.escape(strip) + "]", "")
    if dash_zero:
        s = F.when(s == "-", F.lit("0")).otherwise(s)
    out = s.try_cast(dtype)
    if fill is not None:
        out = F.coalesce(out, F.lit(fill).cast(dtype))
    return out


def safe_float(c: Column | str, default: float | None = None) -> Column:
    """Float or ``default``; blank text counts as missing."""
    out = F.trim(_c(c).cast("string")).try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def to_bool(c: Column | str, true_words: list[str] | None = None) -> Column:
    """Textual boolean; null and anything not listed → false."""
    words = true_words or TRUE_WORDS
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin(words), F.lit(False))


def tri_state(c: Column | str, true_words: list[str] | None = None,
              false_words: list[str] | None = None) -> Column:
    """true / false / null (unknown) from a loosely typed flag."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return (F.when(s.isin(true_words or TRI_TRUE_WORDS), F.lit(True))
            .when(s.isin(false_words or TRI_FALSE_WORDS), F.lit(False)))


def zero_to_null(c: Column | str) -> Column:
    """Zero means missing."""
    c = _c(c)
    return F.when(c != 0, c)


def ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """Division that yields null on a zero or missing denominator."""
    return F.try_divide(_c(num), _c(den)) * F.lit(scale)


def invert(c: Column | str, top: float = 100.0) -> Column:
    return F.lit(top) - _c(c)


def step_score(c: Column | str, steps: list[tuple[float, float]], default: float = 0.0) -> Column:
    """Piecewise constant policy points: first (threshold, points) with c >= threshold."""
    c = _c(c)
    out = None
    for threshold, points in sorted(steps, key=lambda t: -t[0]):
        out = (F.when(c >= threshold, F.lit(float(points))) if out is None
               else out.when(c >= threshold, F.lit(float(points))))
    return out.otherwise(F.lit(float(default))) if out is not None else F.lit(float(default))


def join_notes(c: Column | str, sep: str = " ") -> Column:
    """Array of notes → one text; null → ''. Works on array or string columns."""
    c = _c(c)
    return F.coalesce(F.array_join(c, sep), F.lit(""))
