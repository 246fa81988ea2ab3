"""A diary, person file and food files read out of the benchmark tables.

Each order line becomes a diary row: the customer is the person, the order date the day, the
part the food, brand and type the food groups. Quantities and prices give the nutrients. Words
added to some food names by quantity make all diet classes and product forms occur. The SQL
twin of every frame stands next to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderline.functions import plain_id
from larderline.plans import fixed_values as fixed
from larderline.plans.diary import classify, deduplicate, person_attributes, with_person
from larderline.plans.enrichment import (
    CONTENT,
    REQUIRED_CONTENT,
    composition,
    digestibility,
    enrich,
    food_matches,
    top_groups,
    with_matches,
)
from larderline.plans.schema import DIARY
from larderline.queries.registry import exact_mean_sql, exact_sum_sql, table
from larderline.session import staged

MEASURES = [
    "TotalGrams",
    "Proteing",
    "Energykcal",
    "EnergykJ",
    "Fatg",
    "Carbohydrateg",
    "Waterg",
]
KEYS = [
    "seriali",
    "SurveyYear",
    "DayNo",
    "AgeR",
    "Sex",
    "Country",
    "FoodName",
    "FoodNumber",
    "MainFoodGroupCode",
    "MainFoodGroupDesc",
    "SubFoodGroupCode",
    "SubFoodGroupDesc",
]
GROUPS = KEYS[-4:]


def raw_diary(spark: SparkSession, sf: str, by_person: bool = False) -> DataFrame:
    """Diary rows as read; ``by_person`` brings the rows of a person together while they are
    narrow, so that grouping by person and more moves nothing, however people are joined."""
    name, quantity = F.col("p_name"), F.col("l_quantity")
    dish = (
        F.when(name.endswith("gizmo") & (quantity >= 50), "beef stew")
        .when(name.endswith("ring") & (quantity > 45), "fish pie")
        .when(name.endswith("bolt") & (quantity > 30), "Egg salad")
        .when(name.endswith("rod"), "Protein Shake")
        .when(name.endswith("widget"), "Complan")
    )
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # People come last, by the id that the diary is grouped by: where that join moves the rows,
    # they are not yet widened by keys and averages.
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("_person"), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("seriali", F.col("o_custkey").cast("string"))
        .drop("o_custkey", "l_orderkey", "o_orderkey", "p_partkey")
    )
    if by_person:
        joined = joined.repartition("seriali")
    joined = joined.join(people, F.col("seriali") == F.col("_person"))
    return joined.select(
        "seriali",
        F.year("o_orderdate").cast("string").alias("SurveyYear"),
        F.col("o_orderdate").cast("date").cast("string").alias("DayNo"),
        _age().alias("AgeR"),
        _sex().alias("Sex"),
        F.col("c_nationkey").cast("string").alias("Country"),
        F.concat_ws(" ", name, dish).alias("FoodName"),
        F.col("l_partkey").cast("string").alias("FoodNumber"),
        F.col("p_type").alias("MainFoodGroupCode"),
        F.concat(F.lit("main "), F.col("p_type")).alias("MainFoodGroupDesc"),
        _sub_code().alias("SubFoodGroupCode"),
        F.concat(F.lit("sub "), _sub_code()).alias("SubFoodGroupDesc"),
        F.when(F.col("l_tax") == 0, F.lit(0.0)).otherwise(quantity * 10).alias("TotalGrams"),
        (quantity * (1 - F.col("l_discount"))).alias("Proteing"),
        (quantity * 20).alias("Energykcal"),
        (quantity * 84).alias("EnergykJ"),
        F.when(F.col("l_discount") != 0, F.col("l_discount") * 100).alias("Fatg"),
        (F.col("l_tax") * 100).alias("Carbohydrateg"),
        (F.col("l_extendedprice") / 100).alias("Waterg"),
    )


def _age():
    return F.floor((F.col("c_acctbal") + 1000) / 110).cast("int")


def _sex():
    male = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "MACHINERY")
    return F.when(male, 1).otherwise(2)


def _sub_code():
    return F.concat_ws("-", "p_brand", "p_type")


RAW_SQL = """
    raw_diary as (
      select cast(o_custkey as varchar) as seriali,
             cast(year(o_orderdate) as varchar) as SurveyYear,
             cast(cast(o_orderdate as date) as varchar) as DayNo,
             cast(floor((c_acctbal + 1000) / 110) as integer) as AgeR,
             case when c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
                  then 1 else 2 end as Sex,
             cast(c_nationkey as varchar) as Country,
             concat_ws(' ', p_name,
               case when p_name like '%gizmo' and l_quantity >= 50 then 'beef stew'
                    when p_name like '%ring' and l_quantity > 45 then 'fish pie'
                    when p_name like '%bolt' and l_quantity > 30 then 'Egg salad'
                    when p_name like '%rod' then 'Protein Shake'
                    when p_name like '%widget' then 'Complan' end) as FoodName,
             cast(l_partkey as varchar) as FoodNumber,
             p_type as MainFoodGroupCode, 'main ' || p_type as MainFoodGroupDesc,
             p_brand || '-' || p_type as SubFoodGroupCode,
             'sub ' || p_brand || '-' || p_type as SubFoodGroupDesc,
             case when l_tax = 0 then 0.0::double else l_quantity * 10 end as TotalGrams,
             l_quantity * (1 - l_discount) as Proteing,
             l_quantity * 20 as Energykcal, l_quantity * 84 as EnergykJ,
             case when l_discount <> 0 then l_discount * 100 end as Fatg,
             l_tax * 100 as Carbohydrateg, l_extendedprice / 100 as Waterg
      from lineitem join orders on l_orderkey = o_orderkey
           join customer on o_custkey = c_custkey join part on l_partkey = p_partkey)"""

_AVERAGES = ", ".join(f"avg({m}) as {m}" for m in MEASURES)
DIARY_SQL = f"""{RAW_SQL},
    diary as (select {", ".join(KEYS)}, {_AVERAGES} from raw_diary group by all)"""


def diary(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The de-duplicated diary; see :func:`reported` for ``columns``."""
    return deduplicate(raw_diary(spark, sf, by_person=True))


def person_file(spark: SparkSession, sf: str) -> DataFrame:
    """Person attributes; the id is a double, and two nations were "not measured"."""
    reported = (
        F.when(F.col("c_mktsegment") == "FURNITURE", "1")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "2")
        .otherwise("3")
    )
    weight = F.when(F.col("c_nationkey").isin(3, 4), -1.0).otherwise(F.abs("c_acctbal") / 100)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("double").alias("seriali"),
        reported.alias("Veg"),
        _sex().alias("Sex"),
        _age().alias("AgeR"),
        weight.alias("Weight"),
        F.col("c_nationkey").alias("region"),
    )


PERSON_SQL = """
    person as (
      select cast(c_custkey as varchar) as seriali,
             case c_mktsegment when 'FURNITURE' then '1' when 'HOUSEHOLD' then '2'
                               else '3' end as Veg,
             case when c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
                  then 1 else 2 end as Sex,
             cast(floor((c_acctbal + 1000) / 110) as integer) as AgeR,
             case when c_nationkey in (3, 4) then -1.0 else abs(c_acctbal) / 100 end as Weight,
             c_nationkey as region
      from customer)"""


def people(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return person_attributes(person_file(spark, sf), columns)


def reported(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The diary with what its people report to eat. Nothing is written, so Spark sees by itself
    which ``columns`` are used."""
    return with_person(diary(spark, sf), people(spark, sf, "Veg"))


REPORTED_SQL = f"""{DIARY_SQL}, {PERSON_SQL},
    reported as (select d.*, Veg from diary d left join person p on d.seriali = p.seriali)"""


def _any_of(column: str, words: list[str]) -> str:
    pattern = "|".join(words).replace("'", "''")
    return f"regexp_matches({column}, '{pattern}', 'i')"


CLASSIFIED_SQL = f"""{DIARY_SQL},
    labelled as (
      select *, case
        when {_any_of("MainFoodGroupDesc", fixed.MEAT_GROUPS)}
             or {_any_of("FoodName", fixed.MEAT_FOODS)} then 'Neither'
        when {_any_of("MainFoodGroupDesc", fixed.FISH_GROUPS)}
             or {_any_of("FoodName", fixed.FISH_FOODS)} then 'Pescatarian'
        when {_any_of("MainFoodGroupDesc", fixed.DAIRY_EGG_GROUPS)}
             or {_any_of("FoodName", fixed.DAIRY_EGG_FOODS)} then 'Vegetarian'
        else 'Vegan' end as Diet
      from diary),
    diets as (
      select seriali, case when bool_or(Diet = 'Neither') then 'Neither'
                           when bool_or(Diet = 'Pescatarian') then 'Pescatarian'
                           when bool_or(Diet = 'Vegetarian') then 'Vegetarian'
                           else 'Vegan' end as Overall_Diet
      from labelled group by seriali),
    classified as (
      select l.*, Overall_Diet from labelled l join diets t on l.seriali = t.seriali)"""


def _staged_diary(spark: SparkSession, sf: str, columns: Sequence[str] | None) -> DataFrame:
    """The de-duplicated diary, written with the named columns and those that classes and top
    groups are found by; by default with all."""
    rows = diary(spark, sf)
    if columns is not None:
        wanted = {*columns, "seriali", "DayNo", "FoodName", *GROUPS, "TotalGrams", "Proteing"}
        rows = rows.select(*[c for c in rows.columns if c in wanted])
    return staged(rows, "diary")


def classified(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    return classify(_staged_diary(spark, sf, columns))


def composition_file(spark: SparkSession, sf: str) -> DataFrame:
    """Several rows per sub-group; one content unknown for a brand, the last one sparse."""
    size = F.col("p_size")
    contents = {c: size * i / 100.0 + i for i, c in enumerate(CONTENT, start=1)}
    contents["METg"] = F.when(F.col("p_brand") != "Brand#7", contents["METg"])
    contents["HYPg"] = F.when(size <= 25, contents["HYPg"])
    return table(spark, sf, "part").select(
        _sub_code().alias("SubFoodGroupCode"), *[v.alias(k) for k, v in contents.items()]
    )


_UNKNOWN = {"METg": "p_brand <> 'Brand#7'", "HYPg": "p_size <= 25"}
_CONTENT_SQL = ", ".join(
    f"avg(case when {_UNKNOWN.get(c, 'true')} then p_size * {i} / 100.0::double + {i} end) as {c}"
    for i, c in enumerate(CONTENT, start=1)
)


def match_file(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sub-group; averages are text, and not numbers for one brand."""
    groups = table(spark, sf, "part").groupBy("p_brand", "p_type")
    facts = groups.agg(
        F.min("p_partkey").alias("Sr_no"),
        F.avg("p_retailprice").alias("price"),
        F.min("p_size").alias("least"),
    )
    known = F.col("p_brand") != "Brand#9"
    averages = [
        F.when(known, ((F.col("least") + i) / 10.0).cast("string")).otherwise("n/a").alias(c)
        for i, c in enumerate(fixed.MATCH_NUMBERS, start=1)
    ]
    return facts.select(
        "Sr_no",
        F.col("p_type").alias("MainFoodGroupCode"),
        F.col("p_type").alias("MainFoodGroupDesc"),
        _sub_code().alias("SubFoodGroupCode"),
        _sub_code().alias("SubFoodGroupDesc"),
        F.lit(100.0).alias("TotalGrams"),
        F.col("least").alias("Proteing"),
        (F.col("price") / 10).alias("Protein_g100g"),
        *averages,
    )


def digest_file(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients per sub-group among columns to be dropped; incomplete for one brand."""
    groups = table(spark, sf, "part").groupBy("p_brand", "p_type")
    facts = groups.agg(F.avg("p_size").alias("size"), F.min("p_name").alias("Food_item_name"))
    complete = F.col("p_brand") != "Brand#3"
    coefficients = [
        F.when(complete, F.col("size") / (50 + i)).alias(coef)
        for i, (_, _, coef) in enumerate(fixed.DIGESTIBLE, start=1)
    ]
    dropped = [c for c in [*fixed.DIGEST_MATCHING, *fixed.DIGEST_FOOD_LIST]]
    return facts.select(
        _sub_code().alias("SubFoodGroupCode"),
        "Food_item_name",
        (F.col("size") / 50).alias("Protein_Dig"),
        *coefficients,
        *[F.lit(0).alias(c) for c in dropped],
        F.lit(None).cast("string").alias("_c37"),
    )


_MATCH_SQL = ", ".join(
    f"(least + {i}) / 10.0::double as {c}" for i, c in enumerate(fixed.MATCH_NUMBERS, start=1)
)
_COEF_SQL = ", ".join(
    f"size / {50 + i} as {coef}" for i, (_, _, coef) in enumerate(fixed.DIGESTIBLE, start=1)
)
_AMOUNT_SQL = ", ".join(
    f"{content} * {coef} as Digest_{name}" for name, content, coef in fixed.DIGESTIBLE
)

MATCHES_SQL = f"""
    matches as (
      select SubFoodGroupCode, price / 10 as Protein_g100g, {_MATCH_SQL}
      from (select p_brand || '-' || p_type as SubFoodGroupCode, avg(p_retailprice) as price,
                   min(p_size) as least
            from part where p_brand <> 'Brand#9' group by all))"""

TOP_GROUPS_SQL = f"""
    top_groups as (
      select {", ".join(GROUPS)} from (
        select {", ".join(GROUPS)}, {exact_mean_sql("Proteing")} as m from (
          select seriali, DayNo, {", ".join(GROUPS)}, coalesce({exact_sum_sql("Proteing")}, 0) as Proteing
          from classified group by all) group by all)
      order by m desc nulls last, {", ".join(GROUPS)} limit 60)"""

# Top groups with contents; the rest of the chain as the jobs define it.
ENRICHED_SQL = f"""{CLASSIFIED_SQL}, {MATCHES_SQL}, {TOP_GROUPS_SQL},
    contents as (
      select p_brand || '-' || p_type as SubFoodGroupCode, {_CONTENT_SQL}
      from part group by all),
    wide as (
      select t.SubFoodGroupCode, c.* exclude (SubFoodGroupCode), Protein_g100g
      from top_groups t left join contents c on t.SubFoodGroupCode = c.SubFoodGroupCode
           left join matches m on t.SubFoodGroupCode = m.SubFoodGroupCode),
    coefficients as (
      select SubFoodGroupCode, Digest_food, size / 50 as Protein_Dig, {_COEF_SQL}
      from (select p_brand || '-' || p_type as SubFoodGroupCode, avg(p_size) as size,
                   min(p_name) as Digest_food
            from part where p_brand <> 'Brand#3' group by all)),
    amounts as (
      select w.SubFoodGroupCode, Protein_g100g * Protein_Dig as Digest_protein_g100g, {_AMOUNT_SQL}
      from wide w left join coefficients k on w.SubFoodGroupCode = k.SubFoodGroupCode),
    enriched as (
      select d.*, w.* exclude (SubFoodGroupCode), k.* exclude (SubFoodGroupCode),
             a.* exclude (SubFoodGroupCode), Protein_Dig * Proteing as Digest_total_protein
      from classified d left join wide w on d.SubFoodGroupCode = w.SubFoodGroupCode
           left join coefficients k on d.SubFoodGroupCode = k.SubFoodGroupCode
           left join amounts a on d.SubFoodGroupCode = a.SubFoodGroupCode
      where {" and ".join(f"{c} is not null" for c in REQUIRED_CONTENT)})"""

MATCHED_SQL = f"""{CLASSIFIED_SQL}, {MATCHES_SQL},
    matched as (
      select d.*, m.* exclude (SubFoodGroupCode)
      from classified d join matches m on d.SubFoodGroupCode = m.SubFoodGroupCode)"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return food_matches(match_file(spark, sf))


def matched(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    return with_matches(classified(spark, sf, columns), matches(spark, sf))


def enriched(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    rows = _staged_diary(spark, sf, columns)
    contents = composition(composition_file(spark, sf), matches(spark, sf))
    coefficients = digestibility(digest_file(spark, sf))
    # Person-days are added up where their rows are: amounts move, not the wider sums of few rows.
    top = top_groups(rows.repartition(DIARY.person))
    # Only the rows of the top groups are moved to the classes of their people.
    return classify(rows, enrich(rows, top, contents, coefficients))


def food_list(spark: SparkSession, sf: str) -> DataFrame:
    """A food list with its code only on the first row of each run, and sparse ids."""
    starts = F.col("p_partkey") == F.floor(F.col("p_partkey") / 7) * 7 + 3
    has_id = F.col("p_size") > 10
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row"),
        F.when(starts, _sub_code()).alias("SubFoodGroupCode"),
        F.when(has_id, plain_id(F.col("p_partkey"))).alias("NDB no"),
        F.col("p_name").alias("FDC Id"),
    )


SOURCES = {
    "deduplicated": (diary, DIARY_SQL, "diary"),
    "reported": (reported, REPORTED_SQL, "reported"),
    "classified": (classified, CLASSIFIED_SQL, "classified"),
    "matched": (matched, MATCHED_SQL, "matched"),
    "enriched": (enriched, ENRICHED_SQL, "enriched"),
}
