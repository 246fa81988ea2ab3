"""Grouped summaries, quantiles and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderline.operators.aggregates import (
    class_means,
    group_count,
    mean_and_sd,
    means_where,
    named_sums,
    summarise_numeric,
    two_level,
)
from larderline.operators.cohort_index import indexed_cohort_means
from larderline.operators.cohorts import Band, CohortRule, cohort_means, rules_from
from larderline.operators.missing import blank_sentinels
from larderline.operators.quantiles import (
    QUARTILES,
    box_stats,
    category_order,
    exact_quantiles,
    outliers,
)
from larderline.operators.sketches import (
    merged_sketches,
    quantile_sketches,
    rank_error,
    rank_gaps,
    sketch_quantiles,
)
from larderline.queries.joining import LINE_CLASS_SQL, line_class, person_class
from larderline.queries.registry import query, rounded, table
from larderline.session import staged


def _measured_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with part groups; "net" is missing for one whole brand."""
    net = F.when(F.col("p_brand") != "Brand#7", F.col("l_quantity") * (1 - F.col("l_discount")))
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").cast("string").alias("person"),
            F.col("l_partkey").cast("string").alias("food"),
            "p_brand",
            "p_type",
            "l_quantity",
            "l_extendedprice",
            net.alias("net"),
        )
    )


MEASURED_SQL = """
    measured as (
      select cast(o_custkey as varchar) as person, cast(l_partkey as varchar) as food,
             p_brand, p_type, l_quantity, l_extendedprice,
             case when p_brand <> 'Brand#7' then l_quantity * (1 - l_discount) end as net
      from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""

MEASURES = ["l_quantity", "l_extendedprice", "net"]


@query(
    "agg_numeric_mean",
    f"""with {MEASURED_SQL}
        select p_brand, p_type, round(avg(l_quantity) + 1e-7, 4) as l_quantity,
               round(avg(l_extendedprice) + 1e-7, 4) as l_extendedprice, round(avg(net) + 1e-7, 4) as net
        from measured group by all""",
)
def agg_numeric_mean(spark: SparkSession, sf: str) -> DataFrame:
    means = summarise_numeric(_measured_lines(spark, sf), ["p_brand", "p_type"])
    return rounded(means, MEASURES)


@query(
    "agg_numeric_sum",
    f"""with {MEASURED_SQL}
        select person, p_brand, round(coalesce(sum(l_quantity), 0) + 1e-7, 4) as l_quantity,
               round(coalesce(sum(l_extendedprice), 0) + 1e-7, 4) as l_extendedprice,
               round(coalesce(sum(net), 0) + 1e-7, 4) as net
        from measured group by all""",
)
def agg_numeric_sum(spark: SparkSession, sf: str) -> DataFrame:
    sums = summarise_numeric(_measured_lines(spark, sf), ["person", "p_brand"], "sum")
    return rounded(sums, MEASURES)


@query(
    "one_level_mean",
    f"""with {MEASURED_SQL}
        select food, p_brand, p_type, round(avg(l_quantity) + 1e-7, 4) as l_quantity,
               round(avg(net) + 1e-7, 4) as net
        from measured group by all""",
)
def one_level_mean(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["food", "p_brand", "p_type"]
    means = summarise_numeric(_measured_lines(spark, sf), keys, "mean", ["l_quantity", "net"])
    return rounded(means, ["l_quantity", "net"])


@query(
    "two_level_sum_mean",
    f"""with {MEASURED_SQL},
        inner_level as (
          select person, food, p_brand, p_type, coalesce(sum(l_quantity), 0) as l_quantity,
                 coalesce(sum(l_extendedprice), 0) as l_extendedprice,
                 coalesce(sum(net), 0) as net
          from measured group by all)
        select p_brand, p_type, round(avg(l_quantity) + 1e-7, 4) as l_quantity,
               round(avg(l_extendedprice) + 1e-7, 4) as l_extendedprice, round(avg(net) + 1e-7, 4) as net
        from inner_level group by all""",
)
def two_level_sum_mean(spark: SparkSession, sf: str) -> DataFrame:
    means = two_level(
        _measured_lines(spark, sf), ["person", "food", "p_brand", "p_type"], ["p_brand", "p_type"]
    )
    return rounded(means, MEASURES)


@query(
    "person_day_totals",
    """select user_id, cast(ts as date) as day, round(sum(value) + 1e-7, 4) as total,
              round(coalesce(sum(case when event_type = 'purchase' then value end), 0) + 1e-7, 4)
                as bought,
              round(coalesce(sum(case when event_type = 'error' then value end), 0) + 1e-7, 4) as failed
       from events group by all""",
)
def person_day_totals(spark: SparkSession, sf: str) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    events = table(spark, sf, "events").select(
        "user_id",
        F.col("ts").cast("date").alias("day"),
        "value",
        F.when(kind == "purchase", value).alias("purchase"),
        F.when(kind == "error", value).alias("error"),
    )
    sums = {"total": "value", "bought": "purchase", "failed": "error"}
    return rounded(named_sums(events, ["user_id", "day"], sums), list(sums))


@query(
    "sum_strict",
    """select user_id, cast(ts as date) as day,
              round(case when count(*) filter (where event_type = 'error') = 0
                         then sum(value) end + 1e-7, 4) as total
       from events group by all""",
)
def sum_strict(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        "user_id",
        F.col("ts").cast("date").alias("day"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    return rounded(named_sums(events, ["user_id", "day"], {"total": "value"}, strict=True), ["total"])


@query(
    "global_means",
    """select round(avg(o_totalprice) filter (where o_orderstatus = 'F') + 1e-7, 4) as filled,
              round(avg(o_totalprice) filter (where o_orderpriority = '5-LOW') + 1e-7, 4) as low,
              round(avg(o_totalprice) filter (where o_orderkey < 0) + 1e-7, 4) as nobody
       from orders""",
)
def global_means(spark: SparkSession, sf: str) -> DataFrame:
    means = {
        "filled": (F.col("o_orderstatus") == "F", "o_totalprice"),
        "low": (F.col("o_orderpriority") == "5-LOW", "o_totalprice"),
        "nobody": (F.col("o_orderkey") < 0, "o_totalprice"),
    }
    return rounded(means_where(table(spark, sf, "orders"), means), list(means))


@query(
    "mean_sd",
    """select user_id, event_type, round(avg(value) + 1e-7, 4) as mean_value,
              round(stddev_samp(value) + 1e-7, 4) as sd_value
       from events group by all""",
)
def mean_sd(spark: SparkSession, sf: str) -> DataFrame:
    spread = mean_and_sd(table(spark, sf, "events"), "value", ["user_id", "event_type"])
    return rounded(spread, ["mean_value", "sd_value"])


@query(
    "class_means",
    f"""with {LINE_CLASS_SQL}
        select person_class, round(avg(l_quantity) + 1e-7, 4) as mean_l_quantity,
               round(avg(l_extendedprice) + 1e-7, 4) as mean_l_extendedprice
        from line_class l join person_class p on l.o_custkey = p.o_custkey group by all""",
)
def means_by_class(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_class(spark, sf)
    joined = lines.join(person_class(lines), "o_custkey")
    means = class_means(joined, ["person_class"], ["l_quantity", "l_extendedprice"])
    return rounded(means, ["mean_l_quantity", "mean_l_extendedprice"])


@query(
    "group_count",
    "select p_type, p_brand, count(*) as n from part group by all",
)
def count_groups(spark: SparkSession, sf: str) -> DataFrame:
    return group_count(table(spark, sf, "part"), ["p_type", "p_brand"])


PRICE_LIMITS = (5000, 90000)
BOX_SQL = """
    priced as (
      select p_type, p_brand, l_orderkey, l_linenumber, l_extendedprice
      from lineitem join part on l_partkey = p_partkey
      where l_extendedprice between 5000 and 90000),
    quarts as (
      select p_type, quantile_cont(l_extendedprice, 0.25) as q1,
             quantile_cont(l_extendedprice, 0.5) as median,
             quantile_cont(l_extendedprice, 0.75) as q3
      from priced group by p_type),
    fenced as (
      select p.*, q1, median, q3, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high
      from priced p join quarts q on p.p_type = q.p_type)"""


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop(
        "p_partkey", "l_partkey"
    )


@query(
    "box_stats",
    f"""with {BOX_SQL}
        select p_type, count(*) as n, round(any_value(q1) + 1e-7, 4) as q1,
               round(any_value(median) + 1e-7, 4) as median, round(any_value(q3) + 1e-7, 4) as q3,
               min(case when l_extendedprice between low and high then l_extendedprice end)
                 as whisker_low,
               max(case when l_extendedprice between low and high then l_extendedprice end)
                 as whisker_high,
               count(*) filter (where l_extendedprice not between low and high) as n_outliers
        from fenced group by p_type""",
)
def price_boxes(spark: SparkSession, sf: str) -> DataFrame:
    boxes = box_stats(_priced(spark, sf), ["p_type"], "l_extendedprice", PRICE_LIMITS)
    return rounded(boxes, ["q1", "median", "q3"])


@query(
    "box_outliers",
    """with quarts as (
         select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
         from events group by event_type)
       select e.event_id, e.event_type, e.value
       from events e join quarts q on e.event_type = q.event_type
       where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""",
)
def value_outliers(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return outliers(events, ["event_type"], "value")


@query(
    "exact_quantiles",
    """select l_returnflag, l_linestatus, round(quantile_cont(l_quantity, 0.1) + 1e-7, 4) as p10,
              round(quantile_cont(l_quantity, 0.5) + 1e-7, 4) as p50,
              round(quantile_cont(l_quantity, 0.99) + 1e-7, 4) as p99
       from lineitem group by all""",
)
def quantity_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    lines = table(spark, sf, "lineitem")
    by = ["l_returnflag", "l_linestatus"]
    found = exact_quantiles(lines, by, "l_quantity", probs)
    return rounded(found, list(probs))


@query(
    "category_order",
    """select p_brand, round(m + 1e-7, 4) as median,
              row_number() over (order by m, p_brand) as position
       from (select p_brand, quantile_cont(l_extendedprice, 0.5) as m
             from lineitem join part on l_partkey = p_partkey group by p_brand)""",
)
def brands_by_median(spark: SparkSession, sf: str) -> DataFrame:
    ordered = category_order(_priced(spark, sf), "p_brand", "l_extendedprice")
    return rounded(ordered, ["median"])


RULE_FIELDS = "cohort sex age_lo age_lo_incl age_hi age_hi_incl e_lo e_lo_incl e_hi e_hi_incl"
SPEND_RULES = [
    dict(zip(RULE_FIELDS.split(), row))
    for row in [
        ("builders", "BUILDING", 0, False, 6500, False, 100000, True, None, False),
        ("households", "HOUSEHOLD", 0, True, 6500, True, 50000, False, 350000, False),
        ("in debt", None, None, False, 0, False, None, False, None, False),
        ("wealthy", None, 6400, False, None, False, 80000, False, 400000, True),
    ]
]

COHORT_MEMBERS_SQL = """
    days as (
      select o_custkey, cast(o_orderdate as date) as day, c_mktsegment, c_acctbal,
             sum(o_totalprice) as spent, count(*) as orders
      from orders join customer on o_custkey = c_custkey group by all),
    members as (
      select 'builders' as cohort, * from days
      where c_mktsegment = 'BUILDING' and c_acctbal > 0 and c_acctbal < 6500 and spent >= 100000
      union all
      select 'households', * from days
      where c_mktsegment = 'HOUSEHOLD' and c_acctbal >= 0 and c_acctbal <= 6500
            and spent > 50000 and spent < 350000
      union all
      select 'in debt', * from days where c_acctbal < 0
      union all
      select 'wealthy', * from days
      where c_acctbal > 6400 and spent > 80000 and spent <= 400000)"""


@query(
    "cohort_means",
    f"""with {LINE_CLASS_SQL}, {COHORT_MEMBERS_SQL}
        select cohort, person_class, round(avg(spent) + 1e-7, 4) as mean_spent,
               round(avg(orders) + 1e-7, 4) as mean_orders
        from members m left join person_class p on m.o_custkey = p.o_custkey group by all""",
)
def means_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice"
    )
    people = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    days = (
        orders.groupBy("o_custkey", "day")
        .agg(F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("orders"))
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
    )
    classed = days.join(person_class(line_class(spark, sf)), "o_custkey", "left")
    means = cohort_means(
        classed,
        rules_from(SPEND_RULES),
        "c_mktsegment",
        "c_acctbal",
        "spent",
        ["spent", "orders"],
        ["person_class"],
    )
    return rounded(means, ["mean_spent", "mean_orders"])


@query(
    "cohort_weight_sentinel",
    """with people as (
         select c_mktsegment, c_nationkey,
                case when c_nationkey not in (3, 4) then c_acctbal end as weight
         from customer)
       select cohort, round(avg(weight) + 1e-7, 4) as mean_weight from (
         select 'young builders' as cohort, weight from people
         where c_mktsegment = 'BUILDING' and c_nationkey < 12
         union all
         select 'everyone old', weight from people where c_nationkey >= 10)
       group by cohort""",
)
def weights_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    # Two nations stand for "not measured" and carry the code -1 instead of a weight.
    coded = F.when(F.col("c_nationkey").isin(3, 4), F.lit(-1.0)).otherwise(F.col("c_acctbal"))
    people = table(spark, sf, "customer").withColumn("weight", coded)
    rules = [
        CohortRule("young builders", "BUILDING", Band(high=12, high_closed=False)),
        CohortRule("everyone old", None, Band(low=10)),
    ]
    measured = blank_sentinels(people, "weight", [-1])
    means = cohort_means(measured, rules, "c_mktsegment", "c_nationkey", None, ["weight"])
    return rounded(means, ["mean_weight"])


@query(
    "sketched_quartiles",
    """select l_returnflag, count(l_extendedprice) as n, true as q1_near, true as median_near,
              true as q3_near
       from lineitem group by l_returnflag""",
)
def quartiles_from_stored_sketches(spark: SparkSession, sf: str) -> DataFrame:
    # Sketches per flag, status and year are stored; quartiles per flag come from merging them, and
    # their exact ranks must lie within the stated error.
    lines = table(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        F.year("l_shipdate").alias("year"),
        "l_extendedprice",
    )
    finest = ["l_returnflag", "l_linestatus", "year"]
    stored = staged(quantile_sketches(lines, finest, "l_extendedprice"), "sketches")
    by = ["l_returnflag"]
    answers = staged(sketch_quantiles(merged_sketches(stored, by), by), "answers")
    gaps = rank_gaps(lines, by, "l_extendedprice", answers)
    near = [(F.col(q) <= 2 * rank_error()).alias(f"{q}_near") for q in QUARTILES]
    return gaps.select(*by, "n", *near)


@query(
    "cohorts_by_rule_table",
    """select 's' || s_suppkey as cohort, round(avg(c_acctbal) + 1e-7, 4) as mean_c_acctbal,
              round(avg(c_nationkey) + 1e-7, 4) as mean_c_nationkey
       from supplier join customer
         on (s_suppkey % 5 = 0 or s_nationkey = c_nationkey)
            and (s_suppkey % 11 = 0 or c_acctbal > s_acctbal
                 or (s_suppkey % 2 = 0 and c_acctbal = s_acctbal))
            and c_acctbal < s_acctbal + 400 and c_custkey > s_suppkey
       group by s_suppkey""",
)
def means_by_rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """One rule for each supplier: customers of its nation, or of all, with a like balance."""
    key, low = F.col("s_suppkey"), F.col("s_acctbal")
    rules = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), key).alias("cohort"),
        F.when(key % 5 != 0, F.col("s_nationkey")).alias("sex"),
        F.when(key % 11 != 0, low).alias("age_lo"),
        (key % 2 == 0).alias("age_lo_incl"),
        (low + 400).alias("age_hi"),
        F.lit(False).alias("age_hi_incl"),
        key.alias("e_lo"),
        F.lit(False).alias("e_lo_incl"),
        F.lit(None).cast("bigint").alias("e_hi"),
        F.lit(False).alias("e_hi_incl"),
    )
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    measures = ["c_acctbal", "c_nationkey"]
    means = indexed_cohort_means(people, rules, "c_nationkey", "c_acctbal", "c_custkey", measures)
    return rounded(means, ["mean_c_acctbal", "mean_c_nationkey"])
