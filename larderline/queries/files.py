"""Delimited files written and read back in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.functions import to_number
from larderline.operators.projection import drop_matching
from larderline.queries.registry import query, table
from larderline.session import scratch_path
from larderline.sources import (
    read_aligned,
    read_csv,
    read_delimited,
    read_named,
    read_table,
    write_csv,
    write_table,
)


@query(
    "text_scan_cast",
    """select o_orderkey,
              try_cast(case when o_orderstatus = 'F' then cast(o_totalprice as varchar)
                            when o_orderstatus = 'P' then null
                            else o_orderstatus end as double) as amount
       from orders""",
)
def text_scan_cast(spark: SparkSession, sf: str) -> DataFrame:
    # Tab-delimited Latin-1 text, numbers mixed with letters and missing cells.
    status = F.col("o_orderstatus")
    text = F.when(status == "F", F.col("o_totalprice").cast("string")).when(status != "P", status)
    path = scratch_path(spark, "text-scan")
    orders = table(spark, sf, "orders").select("o_orderkey", text.alias("amount"))
    write_csv(orders, path, sep="\t", encoding="ISO-8859-1")
    scanned = read_delimited(spark, path)
    return scanned.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), to_number("amount").alias("amount")
    )


@query(
    "waves_read_together",
    """select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus,
              case when o_orderdate < date '1998-01-01' then o_orderpriority end
                as o_orderpriority
       from orders""",
)
def waves_read_together(spark: SparkSession, sf: str) -> DataFrame:
    # The second wave has its columns in another order and lacks one.
    orders = table(spark, sf, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    paths = [scratch_path(spark, f"wave-{w}") for w in (9, 10)]
    first = orders.where(early).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    second = orders.where(~early).select("o_orderstatus", "o_orderkey")
    for wave, path in zip((first, second), paths):
        write_csv(wave, path, sep="\t", encoding="ISO-8859-1")
    return read_aligned(spark, paths)


@query("csv_typed_round_trip", "select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def csv_typed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").drop("c_mktsegment")
    path = scratch_path(spark, "people")
    write_csv(people, path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in people.schema.fields])
    return read_csv(spark, path, schema)


@query("csv_inferred_read", "select p_partkey, p_name, p_retailprice from part")
def csv_inferred_read(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parts")
    write_csv(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    inferred = read_csv(spark, path)
    return inferred.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query(
    "csv_with_row_numbers",
    """select row_number() over (order by o_totalprice, o_orderkey) as row,
              o_orderkey, o_totalprice from orders""",
)
def csv_with_row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "numbered")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    write_csv(orders, path, number_by=["o_totalprice", "o_orderkey"])
    schema = "row bigint, o_orderkey bigint, o_totalprice double"
    return read_csv(spark, path, T.StructType.fromDDL(schema))


@query("quoted_text_round_trip", "select doc_id, lang, text from documents")
def quoted_text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    # Whole texts with line breaks, quotes and delimiters inside.
    path = scratch_path(spark, "texts")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    write_csv(docs, path)
    schema = T.StructType.fromDDL("doc_id bigint, lang string, text string")
    return read_csv(spark, path, schema)


def _named_file(df: DataFrame, path: str) -> None:
    """Write a small table as one tab-delimited file of the given name."""
    spark = df.sparkSession
    folder = scratch_path(spark, "one-file")
    write_csv(df.coalesce(1), folder, sep="\t", encoding="ISO-8859-1")
    at = spark._jvm.org.apache.hadoop.fs.Path
    system = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = system.globStatus(at(folder + "/part-*"))[0].getPath()
    system.mkdirs(at(path).getParent())
    system.rename(part, at(path))


@query(
    "files_by_name",
    """select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus
       from orders where o_orderstatus in ('F', 'O')""",
)
def files_by_name(spark: SparkSession, sf: str) -> DataFrame:
    # One folder. The wave is the number after "yr"; the dates behind it hold 9, 10 and 11 too.
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    folder = scratch_path(spark, "waves")
    names = {"F": "yr9_foodlevel_20121020", "O": "yr10_foodlevel_20130504",
             "P": "yr2_foodlevel_20101109"}
    for status, name in names.items():
        _named_file(orders.where(F.col("o_orderstatus") == status), f"{folder}/{name}.tab")
    _named_file(orders.limit(0), f"{folder}/yr110_foodlevel_20211020.tab")
    return read_named(spark, folder, r"yr(9|10|11)(?!\d)", glob="*foodlevel*")


@query("tsv_inferred_read", "select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def tsv_inferred_read(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "people")
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    write_csv(people, path, sep="\t", encoding="ISO-8859-1")
    inferred = read_delimited(spark, path, infer=True)
    return inferred.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("blank_headers_read", "select s_suppkey, s_name from supplier")
def blank_headers_read(spark: SparkSession, sf: str) -> DataFrame:
    # A file whose second and last header cells are blank; the columns get made-up names.
    path = scratch_path(spark, "blank-headers")
    suppliers = table(spark, sf, "supplier")
    unnamed = suppliers.select(
        "s_suppkey", F.lit(1).alias("  "), "s_name", F.col("s_acctbal").alias(" ")
    )
    write_csv(unnamed, path)
    named = drop_matching(read_csv(spark, path))
    return named.withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))


@query(
    "parquet_by_year",
    """select cast(year(o_orderdate) as integer) as order_year, o_orderkey, o_totalprice
       from orders where year(o_orderdate) = 1997""",
)
def parquet_by_year(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "by-year")
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("order_year"), "o_orderkey", "o_totalprice"
    )
    write_table(orders, path, ["order_year"])
    return read_table(spark, path).where(F.col("order_year") == 1997)
