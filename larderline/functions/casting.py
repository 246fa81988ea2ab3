"""Casts that never raise, and column sets resolved against a schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Text to double; anything that is not a number becomes NULL.

    The JVM parser also takes a type suffix ("1.5d", "2F"), which is not a number in a
    data file. Only text that did parse is looked at again: it is refused if it ends in one
    of those letters, unless it spells infinity. Columns that are numbers need no such test,
    see :func:`number_of`.
    """
    c = _col(c)
    value = c.try_cast("double")
    text = F.lower(F.trim(c))
    plain = ~(F.endswith(text, F.lit("d")) | F.endswith(text, F.lit("f")))
    return F.when(value.isNotNull() & (plain | text.isin("inf", "+inf", "-inf")), value)


def number_of(df: DataFrame, name: str) -> Column:
    """:func:`to_number` of a column; one that is already numeric is only widened."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return to_number(name)


def to_int(c: str | Column) -> Column:
    """Text or number to int by way of double ("42", "42.0" and 42.0 all give 42)."""
    return to_number(c).try_cast("int")


def plain_id(c: str | Column) -> Column:
    """Identifier as text with plain digits: 101011021.0 -> "101011021", not "1.01E8".

    Text stays as it is ("007", "1e3"), and so does every digit of whole numbers and decimals.
    Only floating numbers go by bigint, if they are whole and small enough to be exact.
    """
    c = _col(c)
    floating = F.typeof(c).isin("double", "float")
    value = c.try_cast("double")
    whole = value.try_cast("bigint")
    exact = floating & (F.abs(value) < F.lit(float(2**53))) & (whole == value)
    return F.when(exact, whole.cast("string")).otherwise(c.cast("string"))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing (only floats can hold NaN)."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.nullif(c, F.lit(float("nan")))
    return c


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of all numeric columns outside ``exclude``, in schema order."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def columns_at(df: DataFrame, first: int, last: int) -> Sequence[str]:
    """Column names at 1-based positions ``first`` to ``last``, both included."""
    return df.columns[first - 1 : last]
