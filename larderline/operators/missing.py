"""Missing values: dropping, counting, and carrying the last value forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.functions import present
from larderline.operators.spread import chunk_count, in_chunks


def keep_present(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def drop_incomplete(df: DataFrame, *subsets: Sequence[str]) -> DataFrame:
    """Drop rows with a missing value (NULL or NaN) in any column, or in the given ones.

    Every column is a test of its own, so tests on right-side columns can be pushed below a
    left join and turn it into an inner one. (``na.drop`` makes one test over all columns; on
    a wide table behind renamed columns the optimizer spends seconds on its rewritings.)
    """
    columns = dict.fromkeys(c for s in subsets for c in s) if subsets else df.columns
    for c in columns:
        df = df.where(~_missing(df, c))
    return df


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of missing values per column."""
    return df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in columns])


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def blank_sentinels(df: DataFrame, column: str, codes: Sequence[float]) -> DataFrame:
    """Read the given codes (say -1 for "not measured") as missing."""
    return df.withColumn(column, F.when(~F.col(column).isin(list(codes)), F.col(column)))


def carry_forward(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    leading: str = "keep",
    chunks: int | None = None,
) -> DataFrame:
    """Fill missing values of ``column`` with the last value before them in ``order_by``.

    ``leading="keep"`` leaves rows before the first value missing, ``"drop"`` removes them.
    ``order_by`` should be unique within a partition; rows are cut into chunks by all of it.

    No task ever sees a whole partition: the last value of each chunk is found by a partial
    aggregate, carried across chunks (one row per partition and chunk), and put in front of
    the next chunk as a seed row. The rows are written once with their chunk, so whatever
    ``df`` is, all steps read the same rows.
    """
    if leading not in ("keep", "drop"):
        raise ValueError("leading must be 'keep' or 'drop'")
    df = df.withColumn(column, present(df, column))
    order = [F.col(c) for c in order_by]
    rows = in_chunks(df, order, chunk_count(df, chunks), "in-order")

    keys = [*partition_by, "_chunk"]
    newest = F.max(F.when(F.col(column).isNotNull(), F.struct(*order_by, F.col(column).alias("_v"))))
    per_chunk = rows.groupBy(*keys).agg(newest.alias("_newest"))
    earlier = (
        Window.partitionBy(*partition_by)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seeds = per_chunk.select(
        *keys,
        F.last("_newest", ignorenulls=True).over(earlier)["_v"].alias(column),
        F.lit(0).alias("_real"),
    ).where(F.col(column).isNotNull())

    so_far = (
        Window.partitionBy(*keys)
        .orderBy("_real", *order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = (
        rows.withColumn("_real", F.lit(1))
        .unionByName(seeds, allowMissingColumns=True)
        .withColumn(column, F.last(column, ignorenulls=True).over(so_far))
        .where(F.col("_real") == 1)
        .drop("_real", "_chunk")
    )
    return keep_present(filled, column) if leading == "drop" else filled


def carry_forward_within(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str]
) -> DataFrame:
    """Same fill as one plain window, for partitions known to be small."""
    so_far = (
        Window.partitionBy(*partition_by)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(column, F.last(present(df, column), ignorenulls=True).over(so_far))
