"""Spark session settings, and tables written for reuse inside one run."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that the jobs need. With adaptive execution a join becomes a broadcast only
# after its side was measured, small shuffle partitions are joined and skewed ones are split.
# The "force" flag splits them even where a later aggregate could have kept the join's
# partitioning: better one more exchange than one task with a third of the rows.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Where a join keeps few rows of a large table, a filter of fixed size on the keys of its
    # small side takes out most of the others before the shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "16MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
}


def build_session(app: str = "larderline", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings above; ``spark__ui__enabled`` sets ``spark.ui.enabled``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**RUNTIME_CONF, "spark.sql.session.timeZone": "UTC"}
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a given session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``.

    Where it is unset, a session whose driver and executors are one process (``local``,
    ``local[n]``) gets a temporary folder; any other is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.conf.get("larderline.shared.dir", None)
    if known:
        return known
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="larderline-")
    spark.conf.set("larderline.shared.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, used once.

    What is written there belongs to the session and is removed when the driver's JVM ends.
    """
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4()}")
    system, target = _located(spark, path)
    system.deleteOnExit(target)
    return path


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Later steps then start from a table on disk: its plan is not run again for each of
    them, a lost executor costs nothing, and Spark knows its size when it picks a join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of staged tables whose readers have all been written."""
    for table in tables:
        system, target = _located(table.sparkSession, table.staged_path)
        system.delete(target, True)
