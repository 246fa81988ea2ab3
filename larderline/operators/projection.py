"""Column selection, renaming and bulk casts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from larderline.functions import columns_at, number_of, plain_id

# How the CSV reader names a column whose header is blank.
BLANK_HEADER = r"^_c\d+$"


def keep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def discard(df: DataFrame, columns: Sequence[str], missing_ok: bool = True) -> DataFrame:
    unknown = [c for c in columns if c not in df.columns]
    if unknown and not missing_ok:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*columns)


def drop_matching(df: DataFrame, pattern: str = BLANK_HEADER) -> DataFrame:
    """Drop every column whose name matches; by default those with a blank header."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def cast_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast the named columns to double, bad text to NULL."""
    return df.withColumns({c: number_of(df, c) for c in columns})


def cast_positions(df: DataFrame, first: int, last: int) -> DataFrame:
    """Cast the columns at 1-based positions ``first``..``last`` to double."""
    return cast_numbers(df, columns_at(df, first, last))


def cast_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Identifiers to text with plain digits."""
    return df.withColumns({c: plain_id(c) for c in columns})
