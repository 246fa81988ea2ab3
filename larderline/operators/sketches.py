"""Quantiles of very large groups from stored sketches that can be merged.

One small sketch per finest group is written once. Quantiles of any union of groups come from
merging sketches, without the rows; each new part of the data adds its own sketches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderline.functions import present
from larderline.operators.quantiles import QUARTILES
from larderline.operators.spread import same_keys

SIZE = 800  # values held at the widest level; a sketch takes some tens of kilobytes at most


def rank_error(size: int = SIZE) -> float:
    """How far the share of rows below an answer may lie from the one asked for (99 in 100).

    Merged sketches of one size keep this bound. With the default size it is 0.0035.
    """
    return 2.296 / size**0.9723


def quantile_sketches(
    df: DataFrame, by: Sequence[str], measure: str, size: int = SIZE
) -> DataFrame:
    """One mergeable sketch of the measure per group, as ``sketch``; missing values and NaN are
    left out, and groups without any other value have no row. Partial sketches are built before
    the shuffle, so a hot group costs no more than others."""
    v = present(df, measure).cast("double")
    narrow = df.select(*by, v.alias("_v")).where("_v is not null")
    return narrow.groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(size)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str], size: int = SIZE) -> DataFrame:
    """Sketches of coarser groups (``by`` may be empty), or of several stored parts together."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketch_quantiles(
    sketches: DataFrame, by: Sequence[str], probs: Mapping[str, float] = QUARTILES
) -> DataFrame:
    """Count and approximate quantiles of each sketch; every answer is a value of the group."""
    asked = F.kll_sketch_get_quantile_double
    return sketches.select(
        *by,
        F.kll_sketch_get_n_double("sketch").alias("n"),
        *[asked("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()],
    )


def rank_gaps(
    df: DataFrame,
    by: Sequence[str],
    measure: str,
    answers: DataFrame,
    probs: Mapping[str, float] = QUARTILES,
) -> DataFrame:
    """Exact distance of each answer's rank from the one asked for, per group and in one pass.

    An answer covers all ranks that rows equal to it hold; the distance to these is 0.
    """
    v = present(df, measure).cast("double")
    rows = df.select(*by, v.alias("_v")).where("_v is not null")
    asked = answers.select(*[F.col(k).alias(k + "_a") for k in by], *probs)
    joined = rows.join(asked, same_keys(by, "_a")) if by else rows.crossJoin(asked)
    parts = [F.count(F.lit(1)).alias("_n")]
    for q in probs:
        parts += [F.count_if(F.col("_v") < F.col(q)).alias(f"_below_{q}"),
                  F.count_if(F.col("_v") <= F.col(q)).alias(f"_upto_{q}")]
    counted = joined.groupBy(*by).agg(*parts)

    def gap(q: str, p: float):
        low, high = F.col(f"_below_{q}") / F.col("_n"), F.col(f"_upto_{q}") / F.col("_n")
        return F.greatest(low - F.lit(float(p)), F.lit(float(p)) - high, F.lit(0.0)).alias(q)

    return counted.select(*by, F.col("_n").alias("n"), *[gap(q, p) for q, p in probs.items()])
