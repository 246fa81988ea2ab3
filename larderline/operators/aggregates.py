"""Grouped summaries with the missing-value rules of the intake jobs.

A sum over nothing but missing values is 0, a mean over them is missing. NaN counts as missing.
All of these are partial/final aggregates, so a group holding a large share of the rows is
reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.functions import label_of_rank, numeric_columns, present, rank_of_label
from larderline.operators.exact import exact_totals


def mean_of(df: DataFrame, name: str) -> Column:
    return F.avg(present(df, name))


def sum_of(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.sum(present(df, name)), F.lit(0))


def strict_sum_of(df: DataFrame, name: str) -> Column:
    """Sum that is missing as soon as one value is."""
    c = present(df, name)
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


SUMMARIES = {"mean": mean_of, "sum": sum_of, "strict_sum": strict_sum_of}
FLOATING = (T.DoubleType, T.FloatType)


def summarise_numeric(
    df: DataFrame,
    keys: Sequence[str],
    how: str = "mean",
    columns: Sequence[str] | None = None,
    exact: Sequence[str] = (),
) -> DataFrame:
    """One summary of every numeric column (or of ``columns``) per key, names kept.

    Sums and means of the columns in ``exact`` have the same bits in whatever order the rows
    come, at several times the cost; they are for figures that are ranked or compared later.
    """
    columns = list(numeric_columns(df, keys) if columns is None else columns)
    # Whole numbers and decimals are added without rounding anyway.
    parted = [c for c in columns if c in exact and isinstance(df.schema[c].dataType, FLOATING)]
    plain = {c: SUMMARIES[how](df, c) for c in columns if c not in parted}
    if not parted:
        return df.groupBy(*keys).agg(*[made.alias(c) for c, made in plain.items()])
    if how not in ("mean", "sum"):
        raise ValueError(f"no exact form of {how!r}")
    totals = exact_totals(df, keys, parted, plain)

    def result(c: str) -> Column:
        if c in plain:
            return F.col(f"`{c}`")
        total = F.col(f"`_sum_{c}`")
        if how == "sum":
            return F.coalesce(total, F.lit(0.0)).alias(c)
        return F.try_divide(total, F.col(f"`_n_{c}`")).alias(c)

    return totals.select(*keys, *[result(c) for c in columns])


def two_level(
    df: DataFrame,
    entity_keys: Sequence[str],
    item_keys: Sequence[str],
    columns: Sequence[str] | None = None,
    inner: str = "sum",
    outer: str = "mean",
    exact: Sequence[str] = (),
) -> DataFrame:
    """Summarise per entity and item, then over the entities of each item.

    With the defaults this is the mean, over people who ate an item, of what each ate in
    total. The denominator is the number of inner groups, not of rows or of the population.
    """
    keys = list(dict.fromkeys([*entity_keys, *item_keys]))
    per_entity = summarise_numeric(df, keys, inner, columns, exact)
    columns = [c for c in per_entity.columns if c not in keys]
    return summarise_numeric(per_entity, list(item_keys), outer, columns, exact)


def named_sums(
    df: DataFrame, keys: Sequence[str], sums: Mapping[str, str], strict: bool = False
) -> DataFrame:
    """``{new: column}`` sums per key; ``strict`` lets one missing value void the sum."""
    how = strict_sum_of if strict else sum_of
    return df.groupBy(*keys).agg(*[how(df, c).alias(new) for new, c in sums.items()])


def means_where(df: DataFrame, means: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Many filtered means in one pass: ``{new: (condition, column)}`` gives one row."""
    return df.agg(
        *[F.avg(F.when(cond, present(df, c))).alias(new) for new, (cond, c) in means.items()]
    )


def mean_and_sd(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation; the latter is missing for a single value."""
    c = present(df, column)
    return df.groupBy(*keys).agg(
        F.avg(c).alias(f"mean_{column}"), F.stddev_samp(c).alias(f"sd_{column}")
    )


def class_means(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "mean_"
) -> DataFrame:
    return df.groupBy(*keys).agg(*[mean_of(df, c).alias(prefix + c) for c in columns])


def group_count(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key, largest group first."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return counted.orderBy(F.col(out).desc(), *keys)


def strongest_label(
    df: DataFrame, keys: Sequence[str], label: str, order: Sequence[str], out: str
) -> DataFrame:
    """Per key the label that comes first in ``order`` among all its rows."""
    ranked = df.groupBy(*keys).agg(F.min(rank_of_label(label, order)).alias("_rank"))
    return ranked.select(*keys, label_of_rank("_rank", order).alias(out))
