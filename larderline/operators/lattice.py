"""Reports of many groupings from one pass over the rows.

The rows are summed once by the finest keys, into exact states; every coarser grouping adds up
states. As these are whole numbers, a figure has the same bits as one taken from the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderline.operators.exact import exact_states, state_sums, totals_of_states


def finest_keys(levels: Mapping[str, Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(k for keys in levels.values() for k in keys))


def level_totals(
    states: DataFrame, levels: Mapping[str, Sequence[str]], columns: Sequence[str]
) -> DataFrame:
    """Sums and counts of every level in one aggregate with grouping sets.

    ``states`` are exact states by all keys of the levels or finer. The result has the level's
    name as ``level`` and missing values in the keys that a level does not have; a missing
    key value of the rows stays a group of its own. Levels with the same keys are refused.
    """
    keys = finest_keys(levels)
    sets = {name: frozenset(of) for name, of in levels.items()}
    if len(set(sets.values())) < len(sets):
        raise ValueError("two levels have the same keys")
    # A bit for each key, the last key lowest; set where the level does not have the key.
    number = {
        name: sum(2**i for i, k in enumerate(reversed(keys)) if k not in of)
        for name, of in sets.items()
    }
    named = F.create_map(*[F.lit(x) for name, n in number.items() for x in (n, name)])
    sums = states.groupingSets([[F.col(k) for k in of] for of in levels.values()], *keys).agg(
        F.grouping_id().cast("int").alias("_level"), *state_sums(columns)
    )
    totals = totals_of_states(sums, columns)
    return totals.withColumn("level", named[F.col("_level")]).drop("_level")


def level_means(
    df: DataFrame,
    levels: Mapping[str, Sequence[str]],
    columns: Sequence[str],
    prefix: str = "mean_",
) -> DataFrame:
    """Mean of every column per group of every level; the rows are read and shuffled once."""
    states = exact_states(df, finest_keys(levels), columns)
    totals = level_totals(states, levels, columns)
    means = [F.try_divide(F.col(f"`_sum_{c}`"), F.col(f"`_n_{c}`")).alias(prefix + c) for c in columns]
    return totals.select("level", *finest_keys(levels), *means)
