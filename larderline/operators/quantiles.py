"""Exact quantiles, box statistics and ordering of categories by their median."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larderline.functions import present
from larderline.operators.spread import chunk_count, global_row_number, in_chunks, same_keys
from larderline.session import staged

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
WHISKER_REACH = 1.5


def value_counts(df: DataFrame, by: Sequence[str], measure: str) -> DataFrame:
    """Rows per group and value, as ``_v`` and ``_same``; missing measures are left out.

    A value that a third of the rows share is one row here, whatever task it goes to.
    """
    narrow = df.select(*by, present(df, measure).cast("double").alias("_v"))
    return (
        narrow.where(F.col("_v").isNotNull())
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_same"))
    )


def chunked_counts(counts: DataFrame, chunks: int | None = None) -> DataFrame:
    """Staged :func:`value_counts` dealt into chunks of value order.

    Each group has a value once, so equal values of many groups are told apart by the group.
    """
    return in_chunks(counts, [F.col("_v")], chunk_count(counts, chunks), "values")


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    measure: str,
    probs: Mapping[str, float],
    chunks: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact, without gathering any group.

    Built-in ``percentile`` keeps every distinct value of a group in one task. Here rows are
    first counted by group and value, in one pass over ``df``; ranks are then selected by weight.
    The counts are written in chunks of value order, sums per group and chunk tell which chunk
    holds each wanted rank, and only the counts of those chunks are shuffled and ranked.
    """
    counts = staged(value_counts(df, by, measure), "value-counts")
    return quantiles_of_counts(counts, by, probs, chunks)


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], probs: Mapping[str, float], chunks: int | None = None
) -> DataFrame:
    """:func:`exact_quantiles` of staged :func:`value_counts`."""
    by = list(by)
    values = chunked_counts(counts, chunks)

    group = Window.partitionBy(*by)  # one row for each chunk at most
    earlier = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = (
        values.groupBy(*by, "_chunk")
        .agg(F.sum("_same").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(group))
    )
    ranks = F.array(*[r for p in probs.values() for r in (_below(p), _above(p))])
    holds = F.exists(
        ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows"))
    )
    wanted = per_chunk.where(holds).select(
        *[F.col(k).alias(k + "_w") for k in [*by, "_chunk"]], "_before", "_total"
    )
    # A few rows per group, from a file of known size: Spark broadcasts it or does not.
    wanted = staged(wanted, "ranks")

    inside = Window.partitionBy(*by, "_chunk").orderBy("_v")
    ranked = values.join(wanted, same_keys([*by, "_chunk"], "_w")).withColumn(
        "_upto", F.col("_before") + F.sum("_same").over(inside)
    )

    def value_at(rank: Column) -> Column:
        here = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_same"))
        return F.max(F.when(here, F.col("_v")))

    ends = ranked.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[value_at(_below(p)).alias(f"_lo_{q}") for q, p in probs.items()],
        *[value_at(_above(p)).alias(f"_hi_{q}") for q, p in probs.items()],
    )
    return ends.select(*by, *[_between(q, p).alias(q) for q, p in probs.items()])


def _exact_rank(p: float) -> Column:
    return (F.col("_total") - 1) * F.lit(float(p))


def _below(p: float) -> Column:
    return F.floor(_exact_rank(p)).cast("bigint")


def _above(p: float) -> Column:
    return F.ceil(_exact_rank(p)).cast("bigint")


def _between(q: str, p: float) -> Column:
    lo, hi = F.col(f"_lo_{q}"), F.col(f"_hi_{q}")
    return lo + (_exact_rank(p) - _below(p)) * (hi - lo)


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    measure: str,
    probs: Mapping[str, float],
    method: str = "exact",
    chunks: int | None = None,
) -> DataFrame:
    """``exact`` (any size), ``grouped`` (exact, groups known to be small) or ``approximate``."""
    if method == "exact":
        return exact_quantiles(df, by, measure, probs, chunks)
    v = present(df, measure).cast("double")
    if method == "grouped":
        aggs = [F.percentile(v, F.lit(p)).alias(q) for q, p in probs.items()]
    elif method == "approximate":
        aggs = [F.percentile_approx(v, F.lit(p), 10_000).alias(q) for q, p in probs.items()]
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.where(v.isNotNull()).groupBy(*by).agg(*aggs)


def within_limits(df: DataFrame, measure: str, limits: tuple[float, float] | None) -> DataFrame:
    """Drop rows outside an axis range; they take no part in any statistic."""
    if limits is None:
        return df
    return df.where(F.col(measure).between(F.lit(float(limits[0])), F.lit(float(limits[1]))))


def _fences(quarts: DataFrame, by: Sequence[str]) -> DataFrame:
    reach = WHISKER_REACH * (F.col("q3") - F.col("q1"))
    return quarts.select(
        *[F.col(k).alias(k + "_f") for k in by],
        *QUARTILES,
        (F.col("q1") - reach).alias("_low_fence"),
        (F.col("q3") + reach).alias("_high_fence"),
    )


def _with_fences(df: DataFrame, by: Sequence[str], quarts: DataFrame) -> DataFrame:
    joined = df.join(_fences(quarts, by), same_keys(by, "_f"))
    return joined.drop(*[k + "_f" for k in by])


def _need_category(by: Sequence[str]) -> None:
    if not by:
        raise ValueError("box statistics need at least one category column")


def box_stats(
    df: DataFrame,
    by: Sequence[str],
    measure: str,
    limits: tuple[float, float] | None = None,
    method: str = "exact",
    chunks: int | None = None,
) -> DataFrame:
    """Data of a box plot: quartiles, whiskers (extremes within 1.5 box lengths), counts.

    ``method="grouped"`` is one plain plan for tables known to be small, such as a top-N
    report; otherwise the rows are counted by value once and both passes read the counts.
    """
    _need_category(by)
    counts = value_counts(within_limits(df, measure, limits), by, measure)
    if method == "exact":
        counts = staged(counts, "box-counts")
        quarts = staged(quantiles_of_counts(counts, by, QUARTILES, chunks), "quartiles")
    else:
        quarts = quantiles(within_limits(df, measure, limits), by, measure, QUARTILES, method)
    v, same = F.col("_v"), F.col("_same")
    inside = v.between(F.col("_low_fence"), F.col("_high_fence"))
    return (
        _with_fences(counts, by, quarts)
        .groupBy(*by)
        .agg(
            F.sum(same).alias("n"),
            *[F.max(q).alias(q) for q in QUARTILES],
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, same)), F.lit(0)).alias("n_outliers"),
        )
    )


def outliers(
    df: DataFrame,
    by: Sequence[str],
    measure: str,
    limits: tuple[float, float] | None = None,
    method: str = "exact",
    chunks: int | None = None,
) -> DataFrame:
    """The rows a box plot draws as single points, with all their columns.

    ``df`` is read several times; hand in a scan or a staged table.
    """
    _need_category(by)
    df = within_limits(df, measure, limits)
    quarts = quantiles(df, by, measure, QUARTILES, method, chunks)
    if method != "grouped":
        quarts = staged(quarts, "quartiles")
    fenced = _with_fences(df, by, quarts)
    outside = (F.col(measure) < F.col("_low_fence")) | (F.col(measure) > F.col("_high_fence"))
    return fenced.where(outside).drop(*QUARTILES, "_low_fence", "_high_fence")


def category_order(
    df: DataFrame,
    category: str,
    measure: str,
    method: str = "exact",
    chunks: int | None = None,
) -> DataFrame:
    """Categories numbered by ascending median of the measure, ties by name."""
    median = quantiles(df, [category], measure, {"median": 0.5}, method, chunks)
    medians = staged(median, "medians")
    return global_row_number(medians, "median", [category], chunks=chunks)
