"""Figures that grow with each survey wave, from stored states instead of all the rows.

A wave is read once: its sums and counts per key are written as exact states, in a folder of the
wave. Means and sums over all waves come from the states. Adding a wave again replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderline.operators.exact import exact_states, merged_states, totals_of_states
from larderline.plans.schema import DIARY


def add_waves(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    measures: Sequence[str],
    wave: str = DIARY.year,
) -> None:
    """Store the states of the waves found in ``rows``; other stored waves stay as they are.

    ``rows`` hold whole waves. Keys and measures must be those of the stored table. A job that
    is run again after a failure writes the same folders.
    """
    states = exact_states(rows, [*keys, wave], measures)
    (
        states.repartition(wave, F.spark_partition_id())
        .write.partitionBy(wave)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def wave_figures(
    spark: SparkSession, path: str, keys: Sequence[str], measures: Sequence[str], how: str = "mean"
) -> DataFrame:
    """``mean`` or ``sum`` of every measure per key over all stored waves.

    ``keys`` may be fewer than the stored ones, and may name the wave. Bits are those of one run
    over all rows. A sum over missing values only is 0, a mean over them is missing.
    """
    if how not in ("mean", "sum"):
        raise ValueError(f"no stored form of {how!r}")
    totals = totals_of_states(merged_states(spark.read.parquet(path), keys, measures), measures)

    def figure(c: str):
        total = F.col(f"`_sum_{c}`")
        if how == "sum":
            return F.coalesce(total, F.lit(0.0)).alias(c)
        return F.try_divide(total, F.col(f"`_n_{c}`")).alias(c)

    return totals.select(*keys, *[figure(c) for c in measures])
