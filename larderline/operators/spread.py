"""Ordered work shared by many tasks.

An ordered operation (fill forward, rank, exact quantile) over one group normally runs in one
task. Here Spark's range partitioning deals the rows out by all order columns, in their own
types; the number of its partition becomes a column, and the table is written once. The
written chunk numbers are what every later branch and every retry reads. Work inside chunks
runs in parallel, and only one small row per chunk has to be carried across.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.functions import present
from larderline.session import staged

ROWS_PER_CHUNK = 1_000_000
# A table is not cut below this size only to keep more tasks busy.
LEAST_ROWS_PER_CHUNK = 20_000


def same_keys(keys: Sequence[str], suffix: str) -> Column | None:
    """``key <=> key+suffix`` over all keys, or None when there are none."""
    out = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(k + suffix))
        out = part if out is None else out & part
    return out


def chunk_count(df: DataFrame, chunks: int | None = None) -> int:
    """Given number of chunks, or one that follows from the rows.

    A chunk gets at most a million rows. Smaller tables are cut into as many chunks as the
    session has shuffle partitions, if that leaves each enough rows to be worth a task.
    """
    if chunks is not None:
        return chunks
    rows = df.count()
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(
        math.ceil(rows / ROWS_PER_CHUNK), min(width, math.ceil(rows / LEAST_ROWS_PER_CHUNK)), 1
    )


def any_hash(df: DataFrame) -> Column:
    """A hash of the row, from all columns whose type can be hashed."""
    names = [
        f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return F.xxhash64(*[F.col(f"`{n}`") for n in names])


def in_chunks(df: DataFrame, order: Sequence[Column], chunks: int, name: str) -> DataFrame:
    """``df`` with ``_chunk``, written to the shared folder: chunks follow each other in order.

    Rows that tie in the whole order are told apart by a hash, so ties do not fill a chunk
    either. Full copies of one row stay together: where values repeat, count them first and
    hand in the counts, as the quantiles do.
    """
    ranged = df.repartitionByRange(max(chunks, 1), *order, any_hash(df))
    return staged(ranged.withColumn("_chunk", F.spark_partition_id()), name)


def global_row_number(
    df: DataFrame,
    measure: str,
    ties: Sequence[str],
    out: str = "position",
    descending: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Row number over the whole table by ``measure`` then ``ties``.

    Missing measures come first, or last if ``descending``. Equal to ``row_number() over
    (order by ...)`` without its single task: numbers are given inside chunks and shifted by
    the row counts of the chunks before them. Rows that tie in all columns are numbered in
    any order, but each number is given once.
    """
    df = df.withColumn(measure, present(df, measure))
    first = F.col(measure).desc_nulls_last() if descending else F.col(measure).asc_nulls_first()
    order = [first, *[F.col(t) for t in ties]]
    rows = in_chunks(df, order, chunk_count(df, chunks), "numbered")
    inside = Window.partitionBy("_chunk").orderBy(*order)
    counts = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per chunk from here, whatever the size of the input.
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(
        "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift")
    )
    return (
        rows.withColumn("_inside", F.row_number().over(inside))
        .join(shift, "_chunk")
        .withColumn(out, F.col("_inside") + F.col("_shift"))
        .drop("_chunk", "_inside", "_shift")
    )
