"""Left equi-joins: null-safe keys, name collisions, hot keys, and label write-back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderline.operators.missing import drop_incomplete
from larderline.operators.spread import any_hash
from larderline.session import staged

Keys = str | Sequence[str] | Mapping[str, str]


def _key_pairs(on: Keys) -> dict[str, str]:
    if isinstance(on, str):
        return {on: on}
    if isinstance(on, Mapping):
        return dict(on)
    return {k: k for k in on}


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a key repeats, since a left join would then multiply rows."""
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1)
    if not repeated.isEmpty():
        raise ValueError(f"keys {list(keys)} are not unique")
    return df


def left_join(
    left: DataFrame,
    right: DataFrame,
    on: Keys,
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_x", "_y"),
    unique: bool = False,
) -> DataFrame:
    """Keep every left row and add the right columns where the key matches.

    * ``null_safe`` lets a missing key match a missing key.
    * Non-key names found on both sides get ``suffixes`` before the join.
    * ``unique`` checks that the right key does not repeat.

    No side is hinted: Spark picks the join from file sizes, and from the bytes it has measured
    once a shuffle is written.
    """
    pairs = _key_pairs(on)
    left, right = _suffixed(left, right, pairs, suffixes)
    if unique:
        require_unique(right, list(pairs.values()))
    renamed = right.withColumnsRenamed({r: f"_key_{r}" for r in pairs.values()})
    condition = _match(pairs, null_safe)
    return left.join(renamed, condition, "left").drop(*[f"_key_{r}" for r in pairs.values()])


def _suffixed(
    left: DataFrame, right: DataFrame, pairs: Mapping[str, str], suffixes: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    taken = set(left.columns) - set(pairs)
    shared = [c for c in right.columns if c in taken and c not in pairs.values()]
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in shared if suffixes[0]}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in shared if suffixes[1]}),
    )


def _match(pairs: Mapping[str, str], null_safe: bool) -> Column:
    out = F.lit(True)
    for l, r in pairs.items():
        a, b = F.col(l), F.col(f"_key_{r}")
        out = out & (a.eqNullSafe(b) if null_safe else a == b)
    return out


def left_join_complete(
    left: DataFrame, right: DataFrame, on: Keys, required: Sequence[str], **options
) -> DataFrame:
    """Left join, then drop rows missing any of the ``required`` right-side columns.

    The optimizer sees that such rows cannot survive and runs an inner join.
    """
    return drop_incomplete(left_join(left, right, on, **options), required)


def join_chain(df: DataFrame, steps: Sequence[tuple[DataFrame, Keys]], **options) -> DataFrame:
    """Successive left joins, each dimension looked up by its own key."""
    for right, on in steps:
        df = left_join(df, right, on, **options)
    return df


def hot_keys(df: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """Keys (NULL included) with more rows than one task should get: ``key``, ``_parts``.

    ``_parts`` is the number of tasks a key's rows need. One aggregate over the key column.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    parts = F.ceil(F.col("_rows") / F.lit(rows_per_task)).cast("int").alias("_parts")
    return counts.where(F.col("_rows") > rows_per_task).select(key, parts)


def left_join_skewed(
    left: DataFrame,
    right: DataFrame,
    on: str,
    rows_per_task: int = 1_000_000,
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """:func:`left_join` that splits every key with more than ``rows_per_task`` left rows.

    The rows of such a key are dealt out to as many parts as it needs, by a hash of the whole row
    and the number of the task's partition: a retried task gives the same parts again, and
    copies of one row in different partitions still part. The matching right rows, and only
    those, are repeated once per part. Missing keys are spread the same way (unless null-safe
    they match nothing at all). There are at most rows / ``rows_per_task`` such keys; they are
    written once, and Spark joins them by the bytes that takes.
    """
    left, right = _suffixed(left, right, {on: on}, suffixes)
    hot = staged(hot_keys(left, on, rows_per_task).withColumnRenamed(on, "_hot"), "hot-keys")
    # The number of the partition is taken before the rows are moved for the look-up.
    marked = left.withColumn("_at", F.xxhash64(any_hash(left), F.spark_partition_id()))
    marked = marked.join(hot, F.col(on).eqNullSafe(F.col("_hot")), "left").drop("_hot")
    part = F.coalesce(F.pmod(F.col("_at"), F.col("_parts")).cast("int"), F.lit(0))
    marked = marked.withColumn("_part", part).drop("_at", "_parts")
    keyed = right.withColumnRenamed(on, f"_key_{on}")
    keyed = keyed.join(hot, F.col(f"_key_{on}").eqNullSafe(F.col("_hot")), "left").drop("_hot")
    last = F.coalesce(F.col("_parts") - 1, F.lit(0))
    keyed = keyed.withColumn("_of", F.explode(F.sequence(F.lit(0), last))).drop("_parts")
    condition = _match({on: on}, null_safe) & (F.col("_part") == F.col("_of"))
    return marked.join(keyed, condition, "left").drop(f"_key_{on}", "_part", "_of")


def has_missing(df: DataFrame, key: str) -> bool:
    """Whether a key is missing in some row: one look at the key column."""
    return not df.where(F.col(key).isNull()).select(key).isEmpty()


def write_back(df: DataFrame, labels: DataFrame, key: str, null_safe: bool = False) -> DataFrame:
    """Join a per-key result (one row per key) back to the rows it came from.

    A null-safe join leaves rows that Spark no longer knows to be placed by their key, and the next
    grouping by it moves them again. So ``labels`` are asked first whether a key is missing at
    all; hand in what derives from a staged table.
    """
    return left_join(df, labels, key, null_safe=null_safe and has_missing(labels, key))


def restrict_to(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the rows whose keys are among ``groups``."""
    wanted = groups.select(*[F.col(k).alias(f"_key_{k}") for k in keys])
    condition = _match({k: k for k in keys}, null_safe=True)
    return df.join(wanted, condition, "left_semi")
