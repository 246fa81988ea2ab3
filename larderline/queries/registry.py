"""Where queries are registered, and small helpers they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderline.plans.supply import BOX_DIGITS
from larderline.session import prepare

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None) -> Callable[[Run], Run]:
    """Register a query under ``name``; ``sql`` states the same result for another engine."""

    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")

        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(prepare(spark), sf_dir)

        REGISTRY[name] = Query(prepared, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def significant_sql(x: str, digits: int = BOX_DIGITS) -> str:
    """SQL twin of ``functions.significant``."""
    scale = f"pow(10.0::double, {digits - 1} - floor(log10(abs({x}))))"
    usable = f"abs({x}) > 1e-280 and abs({x}) < 1e280"
    return f"case when {usable} then round({x} * {scale}) / {scale} else {x} end"


def exact_sum_sql(x: str) -> str:
    """SQL twin of an exact sum: multiples of 2**-80 in 128 bits, rounded alike."""

    def rounded(s: str) -> str:
        middle, low = f"(({s} >> 62) & {2**62 - 1})::double", f"({s} & {2**62 - 1})::double"
        return f"((({s} >> 124)::double * {2.0**44} + {middle} * {2.0**-18}) + {low} * {2.0**-80})"

    return (
        f"list_transform([sum(trunc(({x})::double * {2.0**80})::hugeint)], lambda s: "
        f"case when s < 0 then -{rounded('(-s)')} else {rounded('s')} end)[1]"
    )


def exact_mean_sql(x: str) -> str:
    return f"({exact_sum_sql(x)} / count({x}))"


# Means of two-digit amounts often lie exactly between two rounded values. Both engines add this
# nudge first, so that noise in the last bits cannot send them different ways.
NUDGE = 1e-7


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Round doubles whose last digits depend on summation order."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(NUDGE), digits) for c in columns})
