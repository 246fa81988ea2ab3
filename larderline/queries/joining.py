"""Left joins in all the forms the jobs use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderline.operators.aggregates import strongest_label, summarise_numeric
from larderline.operators.joins import (
    join_chain,
    left_join,
    left_join_skewed,
    restrict_to,
    write_back,
)
from larderline.operators.ranking import top_n
from larderline.queries.registry import exact_mean_sql, query, rounded, table


@query(
    "left_join_person",
    """select o_orderkey, o_custkey, c_name, c_mktsegment, c_acctbal
       from orders left join customer on o_custkey = c_custkey""",
)
def left_join_person(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, sf, "customer").drop("c_nationkey")
    return left_join(orders, people, {"o_custkey": "c_custkey"})


@query(
    "left_join_unmatched",
    """select d.doc_id, lang, quality, toxic
       from documents d left join labels l on d.doc_id = l.doc_id""",
)
def left_join_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return left_join(docs, table(spark, sf, "labels"), "doc_id", unique=True)


@query(
    "left_join_nullsafe",
    """with o as (select o_orderkey,
                        case when o_orderstatus <> 'P' then o_orderstatus end as code
                 from orders),
            s as (select code, count(*) as lines from
                    (select case when l_returnflag <> 'A' then
                                   case when l_returnflag = 'R' then 'F' else 'O' end end as code
                     from lineitem) group by code)
       select o_orderkey, o.code, cast(lines as bigint) as lines
       from o left join s on o.code is not distinct from s.code""",
)
def left_join_nullsafe(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(status != "P", status).alias("code")
    )
    flag = F.col("l_returnflag")
    code = F.when(flag != "A", F.when(flag == "R", "F").otherwise("O"))
    counts = table(spark, sf, "lineitem").groupBy(code.alias("code")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    return left_join(orders, counts, "code", null_safe=True)


@query(
    "join_suffix",
    """select c.c_custkey as key, c.c_name as name_x, s.s_name as name_y,
              c.c_acctbal as balance_x, s.s_acctbal as balance_y
       from customer c left join supplier s on c.c_custkey = s.s_suppkey""",
)
def join_suffix(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
    )
    return left_join(people, suppliers, "key")


@query(
    "left_join_skewed",
    """select l_orderkey, l_linenumber, o_custkey, o_totalprice
       from (select l_orderkey, l_linenumber,
                    case when l_linenumber <= 2 then 7
                         when l_linenumber = 3 then null else l_orderkey end as k
             from lineitem)
       left join orders on k = o_orderkey""",
)
def join_with_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    # Two sevenths of the lines share one key and one seventh has none.
    number = F.col("l_linenumber")
    key = F.when(number <= 2, F.lit(7)).when(number > 3, F.col("l_orderkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("k"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice"
    )
    return left_join_skewed(lines, orders, "k", rows_per_task=5000).drop("k")


LINE_CLASS_SQL = """
    line_class as (
      select o_custkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
             p_brand, p_type,
             case when p_name ilike '%gizmo%' and l_quantity >= 50 then 'one'
                  when p_name ilike '%ring%' and l_quantity > 45 then 'two'
                  when p_name ilike '%bolt%' and l_quantity > 30 then 'three'
                  else 'four' end as class
      from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
    person_class as (
      select o_custkey,
             case min(case class when 'one' then 1 when 'two' then 2
                                 when 'three' then 3 else 4 end)
               when 1 then 'one' when 2 then 'two' when 3 then 'three' else 'four' end
               as person_class
      from line_class group by o_custkey)"""

CLASSES = ["one", "two", "three", "four"]


def line_class(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with person, part groups and a class by name keyword and quantity."""
    name, quantity = F.col("p_name"), F.col("l_quantity")
    label = (
        F.when(name.ilike("%gizmo%") & (quantity >= 50), "one")
        .when(name.ilike("%ring%") & (quantity > 45), "two")
        .when(name.ilike("%bolt%") & (quantity > 30), "three")
        .otherwise("four")
    )
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("class", label)
        .drop("o_orderkey", "p_partkey", "p_name")
    )


def person_class(lines: DataFrame) -> DataFrame:
    return strongest_label(lines, ["o_custkey"], "class", CLASSES, "person_class")


@query("priority_class", f"with {LINE_CLASS_SQL} select * from person_class")
def priority_class(spark: SparkSession, sf: str) -> DataFrame:
    return person_class(line_class(spark, sf))


@query(
    "label_rejoin",
    f"""with {LINE_CLASS_SQL}
        select l_orderkey, l_linenumber, l_partkey, l_quantity, l.o_custkey, class, person_class
        from line_class l left join person_class p on l.o_custkey = p.o_custkey""",
)
def label_rejoin(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_class(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "o_custkey", "class"
    )
    return write_back(lines, person_class(lines), "o_custkey")


@query(
    "enrich_chain",
    """with brand as (select p_brand, avg(p_retailprice) as brand_price,
                             avg(p_size) as brand_size from part group by p_brand),
            coef as (select p_brand, avg(l_discount) as coefficient
                     from lineitem join part on l_partkey = p_partkey
                     where p_brand <> 'Brand#3' group by p_brand)
       select l_orderkey, l_linenumber, l_partkey, p.p_brand, round(brand_price + 1e-7, 4) as brand_price,
              round(coefficient + 1e-7, 4) as coefficient,
              round(brand_size * coefficient + 1e-7, 4) as scaled_size
       from lineitem l left join part p on l_partkey = p_partkey
            left join brand b on p.p_brand = b.p_brand
            left join coef c on p.p_brand = c.p_brand""",
)
def enrich_chain(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount"
    )
    keys = {"l_partkey": "p_partkey"}
    brand_of = parts.select("p_partkey", "p_brand")
    brands = summarise_numeric(
        parts.drop("p_partkey"), ["p_brand"], "mean", ["p_retailprice", "p_size"]
    ).withColumnsRenamed({"p_retailprice": "brand_price", "p_size": "brand_size"})
    discounts = left_join(lines, brand_of, keys).where(
        F.col("p_brand").isNotNull() & (F.col("p_brand") != "Brand#3")
    )
    coefficients = summarise_numeric(discounts, ["p_brand"], "mean", ["l_discount"])
    coefficients = coefficients.withColumnRenamed("l_discount", "coefficient")
    chained = join_chain(
        lines.drop("l_discount"),
        [(brand_of, keys), (brands, "p_brand"), (coefficients, "p_brand")],
    ).withColumn("scaled_size", F.col("brand_size") * F.col("coefficient"))
    return rounded(chained.drop("brand_size"), ["brand_price", "coefficient", "scaled_size"])


@query(
    "restrict_to_topn",
    f"""with top as (select p_brand, p_type from
                      (select p_brand, p_type, {exact_mean_sql("l_extendedprice")} as m
                       from lineitem join part on l_partkey = p_partkey group by all)
                    order by m desc, p_brand, p_type limit 60)
       select l_orderkey, l_linenumber, l_partkey, p_brand, p_type
       from lineitem join part on l_partkey = p_partkey
       where (p_brand, p_type) in (select (p_brand, p_type) from top)""",
)
def restrict_to_topn(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    keys = ["p_brand", "p_type"]
    means = summarise_numeric(joined, keys, "mean", ["l_extendedprice"], ["l_extendedprice"])
    top = top_n(means, "l_extendedprice", 60, keys)
    return restrict_to(joined.drop("l_extendedprice"), top, keys)
