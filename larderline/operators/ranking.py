"""Top-N reports with a total order: measure descending, missing last, ties by key.

Sums of doubles differ in their last digits with the order the parts arrive in. ``digits``
ranks by the measure rounded to so many significant digits, whatever its unit, so that equal
groups stay tied and every run gives one answer. Reported values are never rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larderline.functions import present, significant


def _order(df: DataFrame, measure: str, keys: Sequence[str], digits: int | None) -> list:
    ranked = present(df, measure)
    if digits is not None:
        ranked = significant(ranked, digits)
    return [ranked.desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]]


def sort_by(
    df: DataFrame, measure: str, keys: Sequence[str], digits: int | None = None
) -> DataFrame:
    return df.orderBy(*_order(df, measure, keys, digits))


def top_n(
    df: DataFrame, measure: str, n: int, keys: Sequence[str], digits: int | None = None
) -> DataFrame:
    """The n largest rows; each task keeps n and only those are merged."""
    return sort_by(df, measure, keys, digits).limit(n)


def top_n_per_class(
    df: DataFrame,
    classes: Sequence[str],
    measure: str,
    n: int,
    keys: Sequence[str],
    out: str = "position",
    digits: int | None = None,
) -> DataFrame:
    """The n largest rows of every class in one pass; each task keeps n per class."""
    inside = Window.partitionBy(*classes).orderBy(*_order(df, measure, keys, digits))
    top = df.withColumn(out, F.row_number().over(inside)).where(F.col(out) <= n)
    return top.withColumn(out, F.col(out).cast("bigint"))


def reorder_top(
    top: DataFrame,
    show_by: str,
    keys: Sequence[str],
    classes: Sequence[str] = (),
    out: str = "shown_at",
    digits: int | None = None,
) -> DataFrame:
    """Number the rows of a top-N report (n per class, so few) by another measure."""
    inside = Window.partitionBy(*classes).orderBy(*_order(top, show_by, keys, digits))
    return top.withColumn(out, F.row_number().over(inside).cast("bigint"))
