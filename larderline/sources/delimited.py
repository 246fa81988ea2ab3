"""Delimited text files in and out.

Empty cells and ``NA`` are read as missing. Quotes inside quoted text are doubled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.operators.spread import global_row_number

MISSING = "NA"
MALFORMED = "_malformed"


def files_named(
    spark: SparkSession, folder: str, glob: str = "*", pattern: str | None = None
) -> list[str]:
    """Paths of the files in ``folder`` whose name fits the glob and holds the pattern.

    Only names are listed; no file is opened. Anchor numbers in the pattern, for example
    ``(?<!\\d)(9|10|11)(?!\\d)``, or they will also match inside dates.
    """
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    )
    if pattern is not None:
        listing = listing.where(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    return sorted(row["path"] for row in listing.collect())


def read_named(
    spark: SparkSession, folder: str, pattern: str, glob: str = "*", **options
) -> DataFrame:
    """One scan over the files in ``folder`` whose name holds the pattern.

    The pattern is a filter on the file name, which Spark applies to its own listing of the folder:
    other files are not opened (but share the header), and no list of paths is gathered.
    """
    scan = read_delimited(spark, folder, glob=glob, **options)
    named = F.element_at(F.split("_metadata.file_path", "/"), -1).rlike(pattern)
    return scan.where(named)


def _reader(
    spark: SparkSession, sep: str, encoding: str, multiline: bool, trim: bool, malformed: str
):
    modes = {"fail": "FAILFAST", "report": "PERMISSIVE"}
    return (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("encoding", encoding)
        .option("nullValue", MISSING)
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("mode", modes[malformed])
        .option("columnNameOfCorruptRecord", MALFORMED)
        # Rows are compared with the whole header even if few columns are read.
        .option("columnPruning", False)
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
    )


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = "\t",
    encoding: str = "ISO-8859-1",
    schema: T.StructType | None = None,
    infer: bool = False,
    multiline: bool = False,
    trim: bool = False,
    malformed: str = "fail",
    glob: str = "*",
) -> DataFrame:
    """One scan over files that share a header; every column is text unless typed.

    Names come from the first file. Each file's own header is checked against them while it
    is read, and a file laid out otherwise fails the job instead of shifting columns.
    ``infer=True`` costs a pass over the data; prefer a declared ``schema``.

    A row with more or fewer cells than the header, or a cell that its declared type can't
    hold, stops the read (``malformed="fail"``). With ``malformed="report"`` it is kept, and the
    column ``_malformed`` holds its text (missing for good rows). Rows are split at line breaks
    unless ``multiline`` says that quoted cells hold some; then a file is one task.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = _reader(spark, sep, encoding, multiline, trim, malformed)
    reader = reader.option("pathGlobFilter", glob)
    if schema is None:
        named = reader.option("inferSchema", infer).csv(paths if infer else paths[0])
        schema = T.StructType([f for f in named.schema.fields if f.name != MALFORMED])
    if malformed == "report":
        schema = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    # Made-up names of blank headers are in no file and can't be compared with one.
    unnamed = infer or any(re.fullmatch(r"_c\d+", f.name) for f in schema.fields)
    return reader.option("enforceSchema", unnamed).schema(schema).csv(paths)


def read_aligned(
    spark: SparkSession, groups: Sequence[str | Sequence[str]], **options
) -> DataFrame:
    """Rows of file groups with different headers, matched by column name.

    Files in one group (say one survey wave) share a header and are one scan. A column that a
    group lacks is missing in its rows.
    """
    frames = [read_delimited(spark, g, **options) for g in groups]
    return append_by_name(frames)


def append_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all by column name; absent columns become missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | None = None,
    infer: bool = True,
    encoding: str = "UTF-8",
    multiline: bool = True,
    malformed: str = "fail",
) -> DataFrame:
    """Comma-separated file with typed columns and blanks around cells trimmed.

    Quoted cells may hold line breaks, as those of :func:`write_csv` do. State
    ``multiline=False`` for files known to have none: large ones are then read by many tasks.
    """
    infer = infer and schema is None
    return read_delimited(
        spark, paths, ",", encoding, schema, infer, multiline, trim=True, malformed=malformed
    )


def number_lines(df: DataFrame) -> DataFrame:
    """Add ``_file``, ``_block`` and ``_line``, which sort rows in file order.

    Take it straight after the read, before any shuffle.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def write_csv(
    df: DataFrame,
    path: str,
    sep: str = ",",
    encoding: str = "UTF-8",
    number_by: Sequence[str] | None = None,
    mode: str = "errorifexists",
    compression: str = "none",
) -> None:
    """Write with a header, missing cells as ``NA``, one file per task.

    ``compression="gzip"`` takes a fraction of the disk; such a file is read by one task.
    ``number_by`` puts a leading ``row`` column in front, numbered in that order.
    """
    if number_by:
        lead, *ties = number_by
        df = global_row_number(df, lead, ties, out="row").select("row", *df.columns)
    (
        df.write.mode(mode)
        .option("sep", sep)
        .option("header", True)
        .option("encoding", encoding)
        .option("nullValue", MISSING)
        .option("escape", '"')
        .option("compression", compression)
        .csv(path)
    )
