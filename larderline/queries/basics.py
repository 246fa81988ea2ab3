"""Projections, filters, scalar functions and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderline.functions import (
    first_label,
    matches_any,
    pair_products,
    per_hundred,
    plain_id,
    to_number,
)
from larderline.operators.aggregates import named_sums
from larderline.operators.cohorts import Band, keep_window
from larderline.operators.joins import left_join, left_join_complete
from larderline.operators.labels import add_flags, add_flags_by_text, add_label
from larderline.operators.missing import (
    blank_sentinels,
    carry_forward,
    carry_forward_within,
    distinct_values,
    drop_incomplete,
    keep_present,
    null_counts,
)
from larderline.operators.projection import cast_positions, discard, drop_matching, keep, rename
from larderline.operators.spread import global_row_number
from larderline.queries.registry import query, rounded, table
from larderline.sources.delimited import append_by_name


@query("select_keep", "select p_partkey, p_name, p_brand from part")
def select_keep(spark: SparkSession, sf: str) -> DataFrame:
    return keep(table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand"])


@query("select_drop", "select p_partkey, p_name, p_brand, p_type from part")
def select_drop(spark: SparkSession, sf: str) -> DataFrame:
    # Two columns named as the CSV reader names blank headers, dropped by that pattern.
    blank = table(spark, sf, "part").withColumns({"_c37": F.lit(None), "_c38": F.lit(None)})
    return discard(drop_matching(blank), ["p_size", "p_retailprice"])


@query("rename_cols", "select p_partkey as food_number, p_name as food_name from part")
def rename_cols(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return rename(part, {"p_partkey": "food_number", "p_name": "food_name"})


@query(
    "cast_positions",
    """select l_orderkey, l_linenumber,
              try_cast(case when l_tax = 0 then l_returnflag
                            else cast(l_quantity as varchar) end as double) as quantity,
              try_cast(case when l_tax = 0 then 'NA'
                            else cast(l_discount as varchar) end as double) as discount
       from lineitem""",
)
def positional_casts(spark: SparkSession, sf: str) -> DataFrame:
    untaxed = F.col("l_tax") == 0
    text = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(untaxed, F.col("l_returnflag"))
        .otherwise(F.col("l_quantity").cast("string"))
        .alias("quantity"),
        F.when(untaxed, F.lit("NA"))
        .otherwise(F.col("l_discount").cast("string"))
        .alias("discount"),
    )
    return cast_positions(text, 3, 4)


@query("id_to_string", "select cast(o_custkey as varchar) as person, o_orderkey from orders")
def id_to_string(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.select(plain_id(F.col("o_custkey").cast("double")).alias("person"), "o_orderkey")


@query(
    "density_ratio",
    """select l_orderkey, l_linenumber,
              round(l_extendedprice / nullif(l_discount, 0) * 100 + 1e-7, 4) as density
       from lineitem""",
)
def density_ratio(spark: SparkSession, sf: str) -> DataFrame:
    density = per_hundred("l_extendedprice", "l_discount").alias("density")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", density)
    return rounded(lines, ["density"])


@query(
    "pairwise_product",
    """select l_orderkey, l_linenumber,
              round(l_quantity * (1 - l_discount) + 1e-7, 4) as net_quantity,
              round(l_extendedprice * (1 + l_tax) + 1e-7, 4) as gross_price,
              round(l_quantity * l_extendedprice + 1e-7, 4) as volume
       from lineitem""",
)
def pairwise_product(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumns(
        {"keep_share": 1 - F.col("l_discount"), "with_tax": 1 + F.col("l_tax")}
    )
    products = pair_products(
        {
            "net_quantity": ("l_quantity", "keep_share"),
            "gross_price": ("l_extendedprice", "with_tax"),
            "volume": ("l_quantity", "l_extendedprice"),
        }
    )
    made = lines.withColumns(products).select("l_orderkey", "l_linenumber", *products)
    return rounded(made, list(products))


PART_RULES = {
    "has_gizmo": {"p_name": ["GIZMO", "small.ring"], "p_type": ["^promo$"]},
    "has_ring": {"p_name": ["ring"]},
    "has_bolt": {"p_name": ["Bolt"]},
}
PART_FLAGS_SQL = """
    select p_partkey,
           regexp_matches(p_name, 'GIZMO|small.ring', 'i')
             or regexp_matches(p_type, '^promo$', 'i') as has_gizmo,
           regexp_matches(p_name, 'ring', 'i') as has_ring,
           regexp_matches(p_name, 'Bolt', 'i') as has_bolt
    from part"""


@query("keyword_flags", PART_FLAGS_SQL)
def keyword_flags(spark: SparkSession, sf: str) -> DataFrame:
    flagged = add_flags(table(spark, sf, "part"), PART_RULES)
    return flagged.select("p_partkey", *PART_RULES)


@query("keyword_flags_by_text", PART_FLAGS_SQL)
def keyword_flags_by_text(spark: SparkSession, sf: str) -> DataFrame:
    flagged = add_flags_by_text(table(spark, sf, "part"), PART_RULES)
    return flagged.select("p_partkey", *PART_RULES)


@query(
    "keyword_options",
    r"""select doc_id,
               regexp_matches(text, 'the|ration', 'i') as anywhere,
               regexp_matches(text, '\b(?:the|ration)\b', 'i') as whole_word,
               contains(lower(text), 'on.') as literal,
               regexp_matches(text, 'on.', 'i') as as_pattern
        from documents""",
)
def keyword_options(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        matches_any("text", ["the", "ration"]).alias("anywhere"),
        matches_any("text", ["the", "ration"], whole_word=True).alias("whole_word"),
        matches_any("text", ["on."], literal=True).alias("literal"),
        matches_any("text", ["on."]).alias("as_pattern"),
    )


@query(
    "keyword_missing_text",
    """select l_orderkey, l_linenumber,
              coalesce(regexp_matches(case when l_tax <> 0 then l_returnflag end, 'r', 'i'),
                       false) as returned
       from lineitem""",
)
def keyword_missing_text(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    text = F.when(F.col("l_tax") != 0, F.col("l_returnflag"))
    return lines.select("l_orderkey", "l_linenumber", matches_any(text, ["r"]).alias("returned"))


@query(
    "priority_label",
    """select p_partkey,
              case when p_name ilike '%gizmo%' then 'first'
                   when p_name ilike '%ring%' then 'second'
                   when p_name ilike '%bolt%' then 'third' else 'rest' end as label
       from part""",
)
def priority_label(spark: SparkSession, sf: str) -> DataFrame:
    rules = {f"is_{w}": {"p_name": [w]} for w in ("gizmo", "ring", "bolt")}
    cases = [("is_gizmo", "first"), ("is_ring", "second"), ("is_bolt", "third")]
    flagged = add_flags(table(spark, sf, "part"), rules)
    return add_label(flagged, "label", cases, "rest").select("p_partkey", "label")


@query(
    "filter_eq",
    """select l_orderkey, l_linenumber, l_quantity from lineitem
       where l_returnflag = 'R' and l_linestatus = 'F'""",
)
def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    wanted = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return lines.where(wanted).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "having_window",
    """select o_custkey, cast(o_orderdate as date) as day, round(sum(o_totalprice) + 1e-7, 2) as spent
       from orders group by all
       having sum(o_totalprice) > 50000 and sum(o_totalprice) <= 400000""",
)
def having_window(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    days = named_sums(orders, ["o_custkey", "day"], {"spent": "o_totalprice"})
    return rounded(keep_window(days, "spent", Band(50000, 400000, low_closed=False)), ["spent"], 2)


def _labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return left_join(docs, table(spark, sf, "labels"), "doc_id")


@query(
    "dropna_any",
    """select d.doc_id, lang, source, n_chars, quality, toxic
       from documents d join labels l on d.doc_id = l.doc_id""",
)
def dropna_any(spark: SparkSession, sf: str) -> DataFrame:
    return drop_incomplete(_labelled_documents(spark, sf))


@query(
    "dropna_subset",
    """select d.doc_id, lang, quality, case when toxic = 1 then toxic end as toxic
       from documents d join labels l on d.doc_id = l.doc_id where quality is not null""",
)
def dropna_subset(spark: SparkSession, sf: str) -> DataFrame:
    # "toxic" is sparse and stays out of the required columns.
    labels = table(spark, sf, "labels").withColumn("toxic", F.when(F.col("toxic") == 1, 1))
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return left_join_complete(docs, labels, "doc_id", ["quality"])


@query("distinct_values", "select distinct lang, source from documents")
def distinct_documents(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_values(table(spark, sf, "documents"), ["lang", "source"])


@query(
    "null_counts",
    """select count(*) filter (where quality is null) as quality,
              count(*) filter (where toxic is null) as toxic,
              count(*) filter (where lang is null) as lang
       from documents d left join labels l on d.doc_id = l.doc_id""",
)
def missing_labels(spark: SparkSession, sf: str) -> DataFrame:
    return null_counts(_labelled_documents(spark, sf), ["quality", "toxic", "lang"])


@query(
    "blank_sentinels",
    """select o_orderkey, case when o_orderkey in (1, 2, 3) then null else o_totalprice end
              as o_totalprice
       from orders where o_orderkey is not null""",
)
def sentinel_codes(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    coded = orders.withColumn(
        "o_totalprice",
        F.when(F.col("o_orderkey").isin(1, 2, 3), F.lit(-1.0)).otherwise(F.col("o_totalprice")),
    )
    return blank_sentinels(coded, "o_totalprice", [-1])


LOCF_SQL = """
    select doc_id, lang, quality from (
      select d.doc_id, lang,
             last_value(quality ignore nulls) over (
               partition by lang order by d.doc_id
               rows between unbounded preceding and current row) as quality
      from documents d left join labels l on d.doc_id = l.doc_id
      where source is not null)"""


def _patchy_labels(spark: SparkSession, sf: str) -> DataFrame:
    joined = keep_present(_labelled_documents(spark, sf), "source")
    return joined.select("doc_id", "lang", "quality")


@query("locf", LOCF_SQL)
def locf(spark: SparkSession, sf: str) -> DataFrame:
    return carry_forward(_patchy_labels(spark, sf), "quality", ["doc_id"], ["lang"])


@query("locf_small_groups", LOCF_SQL)
def locf_small_groups(spark: SparkSession, sf: str) -> DataFrame:
    return carry_forward_within(_patchy_labels(spark, sf), "quality", ["doc_id"], ["lang"])


@query("locf_drop_leading", LOCF_SQL + " where quality is not null")
def locf_drop_leading(spark: SparkSession, sf: str) -> DataFrame:
    rows = _patchy_labels(spark, sf)
    return carry_forward(rows, "quality", ["doc_id"], ["lang"], leading="drop")


@query(
    "locf_one_sequence",
    """select event_id, ts,
              last_value(case when event_type = 'signup' then user_id end ignore nulls) over (
                order by ts, event_id rows between unbounded preceding and current row)
                as last_signup
       from events""",
)
def locf_one_sequence(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.when(F.col("event_type") == "signup", F.col("user_id")).alias("last_signup"),
    )
    return carry_forward(events, "last_signup", ["ts", "event_id"])


# Neighbouring whole numbers that no double can tell apart, each on many rows.
LARGE = 2**60


def _large_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.lit(LARGE) + F.col("user_id") % 100).alias("big"),
        "event_type",
        "event_id",
        F.when(F.col("event_type") == "signup", F.col("user_id")).alias("last_signup"),
    )


@query(
    "locf_large_ids",
    f"""select {LARGE} + user_id % 100 as big, event_type, event_id,
              last_value(case when event_type = 'signup' then user_id end ignore nulls) over (
                order by {LARGE} + user_id % 100, event_type, event_id
                rows between unbounded preceding and current row) as last_signup
       from events""",
)
def locf_large_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = _large_ids(spark, sf)
    return carry_forward(rows, "last_signup", ["big", "event_type", "event_id"], chunks=50)


@query(
    "row_numbers_large_ids",
    f"""select {LARGE} + user_id % 100 as big, event_type, event_id,
              row_number() over (order by {LARGE} + user_id % 100, event_type, event_id)
                as position
       from events""",
)
def row_numbers_large_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = _large_ids(spark, sf).drop("last_signup")
    return global_row_number(rows, "big", ["event_type", "event_id"], chunks=50)


@query(
    "id_text_exact",
    f"""select c_custkey, {2**53} + c_custkey as whole_id, text_id from (
         select c_custkey, case c_custkey % 3
           when 0 then lpad(cast(c_custkey as varchar), 9, '0')
           when 1 then '12345678901' || lpad(cast(c_custkey as varchar), 6, '0')
           else cast(c_custkey as varchar) || 'e3' end as text_id from customer)""",
)
def id_text_exact(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    text = (
        F.when(key % 3 == 0, F.lpad(key.cast("string"), 9, "0"))
        .when(key % 3 == 1, F.concat(F.lit("12345678901"), F.lpad(key.cast("string"), 6, "0")))
        .otherwise(F.concat(key.cast("string"), F.lit("e3")))
    )
    whole = plain_id(F.lit(2**53) + key).cast("bigint")
    return table(spark, sf, "customer").select(
        "c_custkey", whole.alias("whole_id"), plain_id(text).alias("text_id")
    )


@query(
    "keyword_accents",
    """select doc_id, regexp_matches(upper(text), 'ément|ción|über', 'i') as accented
       from documents""",
)
def keyword_accents(spark: SparkSession, sf: str) -> DataFrame:
    found = matches_any(F.upper("text"), ["ément", "ción", "über"])
    return table(spark, sf, "documents").select("doc_id", found.alias("accented"))


@query(
    "union_by_name",
    """select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment
       from customer
       union all
       select s_suppkey, s_name, s_acctbal, null from supplier""",
)
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    people = rename(
        table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_name", "c_acctbal"),
        {
            "c_custkey": "id",
            "c_name": "name",
            "c_acctbal": "balance",
            "c_mktsegment": "segment",
        },
    )
    suppliers = rename(
        table(spark, sf, "supplier").select("s_name", "s_acctbal", "s_suppkey"),
        {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"},
    )
    return append_by_name([people, suppliers])


@query(
    "text_to_number",
    """select o_orderkey,
              try_cast(case when o_orderstatus = 'F' then cast(o_totalprice as varchar)
                            else o_orderstatus end as double) as amount,
              case when o_totalprice > 300000 then 'high'
                   when o_orderstatus = 'F' then 'filled' else 'other' end as label
       from orders""",
)
def text_to_number(spark: SparkSession, sf: str) -> DataFrame:
    filled = F.col("o_orderstatus") == "F"
    text = F.when(filled, F.col("o_totalprice").cast("string")).otherwise(F.col("o_orderstatus"))
    label = first_label([(F.col("o_totalprice") > 300000, "high"), (filled, "filled")], "other")
    return table(spark, sf, "orders").select(
        "o_orderkey", to_number(text).alias("amount"), label.alias("label")
    )
