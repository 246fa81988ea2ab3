"""Top-N reports over brand and type groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderline.operators.aggregates import summarise_numeric
from larderline.operators.ranking import sort_by, top_n
from larderline.operators.spread import global_row_number
from larderline.plans.supply import chart_data, supply_ranking
from larderline.queries.joining import LINE_CLASS_SQL, line_class, person_class
from larderline.queries.registry import (
    exact_mean_sql,
    exact_sum_sql,
    query,
    rounded,
    significant_sql,
    table,
)

ENTITY = ["o_custkey", "l_partkey", "p_type", "p_brand"]
ITEM = ["p_type", "p_brand"]
PRICED = ["l_quantity", "l_extendedprice"]

TWO_LEVEL_SQL = f"""{LINE_CLASS_SQL},
    per_person as (
      select p.person_class, l.o_custkey, l_partkey, p_type, p_brand,
             {exact_sum_sql("l_quantity")} as l_quantity,
             {exact_sum_sql("l_extendedprice")} as l_extendedprice
      from line_class l join person_class p on l.o_custkey = p.o_custkey group by all)"""


def classed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Sums per person, class and part, with the person's class joined to the sums.

    The lines are summed before the join, so what is shuffled by person is one row per
    person and part, however often one person occurs.
    """
    lines = line_class(spark, sf)
    sums = summarise_numeric(lines, ENTITY, "sum", PRICED, PRICED)
    return sums.join(person_class(lines), "o_custkey")


@query(
    "topn_global",
    f"""with {TWO_LEVEL_SQL}
        select p_type, p_brand, round({exact_mean_sql("l_extendedprice")} + 1e-7, 4) as l_extendedprice,
               round({exact_mean_sql("l_quantity")} + 1e-7, 4) as l_quantity
        from per_person group by p_type, p_brand
        order by {exact_mean_sql("per_person.l_extendedprice")} desc, p_type, p_brand limit 60""",
)
def topn_global(spark: SparkSession, sf: str) -> DataFrame:
    top = supply_ranking(
        line_class(spark, sf), ENTITY, ITEM, "l_extendedprice", 60, also=["l_quantity"]
    )
    return rounded(top, ["l_extendedprice", "l_quantity"])


TOP_PER_CLASS_SQL = f"""with {TWO_LEVEL_SQL},
    ranked as (
      select *, row_number() over (partition by person_class
                                   order by price desc, p_type, p_brand) as position
      from (select person_class, p_type, p_brand, {exact_mean_sql("l_extendedprice")} as price,
                   {exact_mean_sql("l_quantity")} as quantity
            from per_person group by all))"""


@query(
    "topn_per_class",
    TOP_PER_CLASS_SQL
    + """select person_class, p_type, p_brand, round(price + 1e-7, 4) as l_extendedprice, position
         from ranked where position <= 20""",
)
def topn_per_class(spark: SparkSession, sf: str) -> DataFrame:
    top = supply_ranking(
        classed_lines(spark, sf), ENTITY, ITEM, "l_extendedprice", 20, by_class="person_class"
    )
    return rounded(top, ["l_extendedprice"])


@query(
    "topn_then_reorder",
    TOP_PER_CLASS_SQL
    + f"""select person_class, p_type, p_brand, round(price + 1e-7, 4) as l_extendedprice,
                round(quantity + 1e-7, 4) as l_quantity, position,
                row_number() over (partition by person_class
                                   order by quantity desc, p_type, p_brand) as shown_at
         from ranked where position <= 60""",
)
def topn_then_reorder(spark: SparkSession, sf: str) -> DataFrame:
    top = supply_ranking(
        classed_lines(spark, sf),
        ENTITY,
        ITEM,
        "l_extendedprice",
        60,
        by_class="person_class",
        show_by="l_quantity",
    )
    return rounded(top, ["l_extendedprice", "l_quantity"])


@query(
    "supply_small_units",
    f"""select p_brand, p_type from (
         select p_brand, p_type, {exact_mean_sql("p_retailprice * 1e-11::double")} as tiny from part group by all)
       order by tiny desc, p_brand, p_type limit 20""",
)
def supply_small_units(spark: SparkSession, sf: str) -> DataFrame:
    # Means near 1e-8: what an absolute rounding would make equal.
    parts = table(spark, sf, "part")
    tiny = parts.withColumn("tiny", F.col("p_retailprice") * F.lit(1e-11))
    return supply_ranking(tiny, [], ["p_brand", "p_type"], "tiny", 20).drop("tiny")


@query(
    "topn_missing_last",
    """select doc_id, quality, n_chars from (
         select d.doc_id, cast(quality as double) as quality, n_chars
         from documents d left join labels l on d.doc_id = l.doc_id)
       order by quality desc nulls last, doc_id limit 600""",
)
def topn_missing_last(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    joined = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    scored = joined.withColumn("quality", joined.quality.cast("double"))
    return top_n(scored, "quality", 600, ["doc_id"])


@query(
    "sort_by_measure",
    """select o_orderkey, o_totalprice,
              row_number() over (order by o_totalprice desc, o_orderkey) as position from orders""",
)
def sort_by_measure(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    numbered = global_row_number(orders, "o_totalprice", ["o_orderkey"], descending=True)
    return sort_by(numbered, "o_totalprice", ["o_orderkey"])


@query(
    "chart_of_top_groups",
    TOP_PER_CLASS_SQL
    + f""", top as (select * replace ({significant_sql("price")} as price) from ranked where position <= 20),
         boxed as (select person_class, p_type, quantile_cont(price, 0.25) as q1,
                          quantile_cont(price, 0.5) as median, quantile_cont(price, 0.75) as q3
                   from top where price between 40000 and 60000 group by all)
         select o.person_class, o.p_type, round(o.m + 1e-7, 4) as order_median,
                row_number() over (partition by o.person_class order by {significant_sql("o.m")}, o.p_type) as place,
                coalesce(b.n, 0) as n, round(q1 + 1e-7, 4) as q1, round(median + 1e-7, 4) as median,
                round(q3 + 1e-7, 4) as q3, round(whisker_low + 1e-7, 4) as whisker_low,
                round(whisker_high + 1e-7, 4) as whisker_high, n_outliers
         from (select person_class, p_type, quantile_cont(price, 0.5) as m
               from top group by all) o
         left join (
           select t.person_class, t.p_type, count(*) as n, any_value(q1) as q1,
                  any_value(median) as median, any_value(q3) as q3,
                  min(case when price between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)
                           then price end) as whisker_low,
                  max(case when price between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)
                           then price end) as whisker_high,
                  count(*) filter (where price not between q1 - 1.5 * (q3 - q1)
                                                     and q3 + 1.5 * (q3 - q1)) as n_outliers
           from top t join boxed b on t.person_class = b.person_class and t.p_type = b.p_type
           where price between 40000 and 60000 group by all) b
         on o.person_class = b.person_class and o.p_type = b.p_type""",
)
def chart_of_top_groups(spark: SparkSession, sf: str) -> DataFrame:
    top = supply_ranking(
        classed_lines(spark, sf), ENTITY, ITEM, "l_extendedprice", 20, by_class="person_class"
    )
    chart = chart_data(top, "p_type", "l_extendedprice", "person_class", (40000, 60000))
    return rounded(
        chart, ["order_median", "q1", "median", "q3", "whisker_low", "whisker_high"]
    )
