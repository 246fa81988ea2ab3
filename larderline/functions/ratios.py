"""Ratios and products of column families."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is zero."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a, b)


def per_hundred(amount: str | Column, weight: str | Column) -> Column:
    """Density: amount per 100 units of weight."""
    return ratio(amount, weight) * F.lit(100.0)


def pair_products(pairs: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """``{new: (left, right)}`` to ``{new: left * right}``, for ``withColumns``."""
    return {new: F.col(a) * F.col(b) for new, (a, b) in pairs.items()}


def significant(c: str | Column, digits: int) -> Column:
    """The number rounded to so many significant digits, whatever its size."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    # Beyond the range of powers of ten, and for 0, the number stays as it is.
    usable = (F.abs(c) > F.lit(1e-280)) & (F.abs(c) < F.lit(1e280))
    return F.when(usable, F.round(c * scale) / scale).otherwise(c)
