"""The intake jobs end to end over the stand-in diary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.operators.aggregates import group_count
from larderline.operators.joins import left_join
from larderline.operators.missing import distinct_values
from larderline.operators.quantiles import box_stats, category_order
from larderline.plans import fixed_values as fixed
from larderline.plans.diary import (
    deduplicate,
    diet_flags,
    ingest,
    person_diets,
    reported_and_actual,
    row_diet,
    with_diet,
    with_person,
)
from larderline.plans.enrichment import top_groups
from larderline.plans.intake import (
    DAY_TOTALS,
    class_report,
    day_totals,
    demographics,
    energy_spread,
    intake_levels,
    intake_report,
    raw_day_totals,
    weight_report,
)
from larderline.plans.lookups import filled_codes
from larderline.plans.products import nutrition_products, product_labels, product_means
from larderline.plans.schema import DIARY
from larderline.plans.waves import add_waves, wave_figures
from larderline.queries import standin
from larderline.queries.registry import query, rounded, table
from larderline.session import scratch_path, staged
from larderline.sources import read_csv, write_csv

_KEYS = ", ".join(standin.KEYS)


def _rounded_sql(names, digits: int = 4) -> str:
    return ", ".join(f"round({n} + 1e-7, {digits}) as {n}" for n in names)


@query(
    "diary_deduplicated",
    f"with {standin.DIARY_SQL} select {_KEYS}, {_rounded_sql(standin.MEASURES)} from diary",
)
def diary_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(standin.diary(spark, sf), standin.MEASURES)


@query(
    "diary_summed",
    f"""with {standin.RAW_SQL}
        select {_KEYS}, {", ".join(f"round(coalesce(sum({m}), 0) + 1e-7, 4) as {m}"
                                   for m in standin.MEASURES)}
        from raw_diary group by all""",
)
def diary_summed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deduplicate(standin.raw_diary(spark, sf, by_person=True), how="sum"), standin.MEASURES)


@query(
    "diary_from_files",
    f"""with {standin.RAW_SQL},
        waves as (select * replace (case when SurveyYear < '1998' then Fatg end as Fatg)
                  from raw_diary)
        select {_KEYS}, {", ".join(f"round(avg({m}) + 1e-7, 4) as {m}" for m in standin.MEASURES)}
        from waves group by all""",
)
def diary_from_files(spark: SparkSession, sf: str) -> DataFrame:
    # Two waves as tab-delimited Latin-1 text; the later one lacks a nutrient.
    raw = standin.raw_diary(spark, sf)
    early = F.col("SurveyYear") < "1998"
    waves = [raw.where(early), raw.where(~early).drop("Fatg")]
    paths = [scratch_path(spark, f"diary-wave-{i}") for i in range(len(waves))]
    for wave, path in zip(waves, paths):
        write_csv(wave, path, sep="\t", encoding="ISO-8859-1", compression="gzip")
    rows = ingest(spark, paths, positions=None, measures=standin.MEASURES)
    return rounded(rows, standin.MEASURES)


@query(
    "protein_by_main_group_boxes",
    f"""with {standin.DIARY_SQL},
        quarts as (select MainFoodGroupDesc, quantile_cont(Proteing, 0.25) as q1,
                          quantile_cont(Proteing, 0.5) as median,
                          quantile_cont(Proteing, 0.75) as q3
                   from diary group by MainFoodGroupDesc),
        fenced as (select d.MainFoodGroupDesc, Proteing, q1, median, q3,
                          Proteing between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as near
                   from diary d join quarts q on d.MainFoodGroupDesc = q.MainFoodGroupDesc)
        select MainFoodGroupDesc, count(*) as n, round(any_value(q1) + 1e-7, 4) as q1,
               round(any_value(median) + 1e-7, 4) as median, round(any_value(q3) + 1e-7, 4) as q3,
               round(min(Proteing) filter (where near) + 1e-7, 4) as whisker_low,
               round(max(Proteing) filter (where near) + 1e-7, 4) as whisker_high,
               count(*) filter (where not near) as n_outliers
        from fenced group by MainFoodGroupDesc""",
)
def protein_by_main_group_boxes(spark: SparkSession, sf: str) -> DataFrame:
    boxes = box_stats(standin.diary(spark, sf), ["MainFoodGroupDesc"], "Proteing")
    return rounded(boxes, ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query(
    "main_groups_by_median_protein",
    f"""with {standin.DIARY_SQL}
        select MainFoodGroupDesc, round(m + 1e-7, 4) as median,
               row_number() over (order by m, MainFoodGroupDesc) as position
        from (select MainFoodGroupDesc, quantile_cont(Proteing, 0.5) as m
              from diary group by MainFoodGroupDesc)""",
)
def main_groups_by_median_protein(spark: SparkSession, sf: str) -> DataFrame:
    ordered = category_order(standin.diary(spark, sf), "MainFoodGroupDesc", "Proteing")
    return rounded(ordered, ["median"])


def _labelled(spark: SparkSession, sf: str, by_text: bool = True) -> DataFrame:
    return row_diet(diet_flags(standin.diary(spark, sf), by_text=by_text))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows of the diary as read: enough to tell what a person eats."""
    return row_diet(diet_flags(standin.raw_diary(spark, sf)))


@query(
    "diet_row_labels",
    f"with {standin.CLASSIFIED_SQL} select seriali, DayNo, FoodNumber, FoodName, Diet from labelled",
)
def diet_row_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf, by_text=False).select("seriali", "DayNo", "FoodNumber", "FoodName", "Diet")


@query(
    "diet_row_labels_by_text",
    f"with {standin.CLASSIFIED_SQL} select seriali, DayNo, FoodNumber, FoodName, Diet from labelled",
)
def diet_row_labels_by_text(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _labelled(spark, sf)
    return labelled.select("seriali", "DayNo", "FoodNumber", "FoodName", "Diet")


@query(
    "person_diets",
    f"""with {standin.CLASSIFIED_SQL}, {standin.PERSON_SQL}
        select t.seriali, Overall_Diet, Veg
        from diets t left join person p on t.seriali = p.seriali""",
)
def diets_of_people(spark: SparkSession, sf: str) -> DataFrame:
    return person_diets(_evidence(spark, sf), standin.people(spark, sf, "Veg"))


@query(
    "reported_and_actual_diets",
    f"""with {standin.CLASSIFIED_SQL}, {standin.PERSON_SQL}
        select Veg, Overall_Diet, count(*) as n
        from diets t left join person p on t.seriali = p.seriali group by all""",
)
def reported_and_actual_diets(spark: SparkSession, sf: str) -> DataFrame:
    return reported_and_actual(person_diets(_evidence(spark, sf), standin.people(spark, sf, "Veg")))


@query(
    "classified_diary",
    f"""with {standin.CLASSIFIED_SQL}
        select seriali, DayNo, FoodNumber, SubFoodGroupCode, round(Proteing + 1e-7, 4) as Proteing,
               Diet, Overall_Diet from classified""",
)
def classified_diary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_classified_rows(spark, sf), ["Proteing"])


_CLASSIFIED = "seriali DayNo FoodNumber SubFoodGroupCode Proteing Diet Overall_Diet".split()


def _classified_rows(spark: SparkSession, sf: str) -> DataFrame:
    # The de-duplicated diary is written once; labels and classes are both read from it.
    diary = staged(standin.diary(spark, sf), "diary")
    labelled = row_diet(diet_flags(diary))
    return with_diet(labelled, person_diets(labelled)).select(*_CLASSIFIED)


@query(
    "classified_diary_file",
    f"""with {standin.CLASSIFIED_SQL}
        select seriali, DayNo, FoodNumber, SubFoodGroupCode, round(Proteing + 1e-7, 4) as Proteing,
               Diet, Overall_Diet from classified""",
)
def classified_diary_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "classified")
    write_csv(_classified_rows(spark, sf), path)
    kinds = ", ".join(f"{c} {'double' if c == 'Proteing' else 'string'}" for c in _CLASSIFIED)
    back = read_csv(spark, path, T.StructType.fromDDL(kinds), multiline=False)
    return rounded(back, ["Proteing"])


@query(
    "diary_with_person",
    f"""with {standin.CLASSIFIED_SQL}, {standin.PERSON_SQL}
        select c.seriali, DayNo, FoodNumber, c.AgeR, c.Sex, p.AgeR as AgeR_person,
               p.Sex as Sex_person, round(Weight + 1e-7, 4) as Weight, region
        from classified c left join person p on c.seriali = p.seriali""",
)
def diary_with_person(spark: SparkSession, sf: str) -> DataFrame:
    attributes = standin.people(spark, sf, "AgeR", "Sex", "Weight", "region")
    joined = with_person(standin.classified(spark, sf), attributes)
    columns = ["seriali", "DayNo", "FoodNumber", "AgeR", "Sex", "AgeR_person", "Sex_person"]
    return rounded(joined.select(*columns, "Weight", "region"), ["Weight"])


ENRICHED = ["Proteing", "Protein_g100g", "LYSg", "HYPg", "Digest_LYS", "Digest_HIST"]
ENRICHED += ["Digest_protein_g100g", "Digest_total_protein"]


@query(
    "enriched_diary",
    f"""with {standin.ENRICHED_SQL}
        select seriali, DayNo, FoodNumber, SubFoodGroupCode, Digest_food, {_rounded_sql(ENRICHED)}
        from enriched""",
)
def enriched_diary(spark: SparkSession, sf: str) -> DataFrame:
    rows = standin.enriched(spark, sf).select(
        "seriali", "DayNo", "FoodNumber", "SubFoodGroupCode", "Digest_food", *ENRICHED
    )
    return rounded(rows, ENRICHED)


MATCHED = ["Protein_g100g", *fixed.MATCH_NUMBERS]


@query(
    "top_groups_with_matches",
    f"""with {standin.CLASSIFIED_SQL}, {standin.MATCHES_SQL}, {standin.TOP_GROUPS_SQL}
        select {", ".join("t." + g for g in standin.GROUPS)}, {_rounded_sql(MATCHED)}
        from top_groups t left join matches m on t.SubFoodGroupCode = m.SubFoodGroupCode""",
)
def top_groups_with_matches(spark: SparkSession, sf: str) -> DataFrame:
    top = top_groups(standin.diary(spark, sf)).select(*standin.GROUPS)
    joined = left_join(top, standin.matches(spark, sf), "SubFoodGroupCode", null_safe=True)
    return rounded(joined, MATCHED)


@query(
    "match_rows_per_group",
    """select p_type as MainFoodGroupCode, p_brand || '-' || p_type as SubFoodGroupCode,
              count(distinct p_brand) as n
       from part group by all""",
)
def match_rows_per_group(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["MainFoodGroupCode", "SubFoodGroupCode"]
    return group_count(standin.match_file(spark, sf), keys)


_PERSON_DAY = "seriali, DayNo, AgeR, Sex"
_TOTALS_SQL = ", ".join(f"coalesce(sum({c}), 0) as {n}" for n, c in DAY_TOTALS.items())
TOTALS_SQL = f"""{standin.ENRICHED_SQL},
    totals as (select {_PERSON_DAY}, Overall_Diet, {_TOTALS_SQL} from enriched group by all)"""


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    columns = [*DIARY.person_day, *DAY_TOTALS.values()]
    return day_totals(standin.enriched(spark, sf, columns))


@query(
    "person_day_intake",
    f"""with {TOTALS_SQL}
        select {_PERSON_DAY}, Overall_Diet, {_rounded_sql(DAY_TOTALS)} from totals""",
)
def person_day_intake(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_totals(spark, sf), list(DAY_TOTALS))


_WEIGHED = ["sum_energy", "sum_LYSg", "sum_dig_LYS", "sum_HISTg", "sum_dig_HIST"]


@query(
    "person_day_intake_by_weight",
    f"""with {standin.ENRICHED_SQL}
        select {_PERSON_DAY}, Overall_Diet, round(coalesce(sum(Energykcal), 0) + 1e-7, 4)
                 as sum_energy,
               round(coalesce(sum(LYSg * TotalGrams / 100), 0) + 1e-7, 4) as "sum_LYSg",
               round(coalesce(sum(Digest_LYS * TotalGrams / 100), 0) + 1e-7, 4) as "sum_dig_LYS",
               round(coalesce(sum(HISTNg * TotalGrams / 100), 0) + 1e-7, 4) as "sum_HISTg",
               round(coalesce(sum(Digest_HIST * TotalGrams / 100), 0) + 1e-7, 4) as "sum_dig_HIST"
        from enriched group by all""",
)
def person_day_intake_by_weight(spark: SparkSession, sf: str) -> DataFrame:
    totals = day_totals(standin.enriched(spark, sf), weight="TotalGrams")
    days = totals.select("seriali", "DayNo", "AgeR", "Sex", "Overall_Diet", *_WEIGHED)
    return rounded(days, _WEIGHED)


@query(
    "raw_person_day_totals",
    f"""with {standin.RAW_SQL}
        select {_PERSON_DAY},
               round(case when count(*) = count(Proteing) then sum(Proteing) end + 1e-7, 4)
                 as sum_Proteing,
               round(case when count(*) = count(Energykcal) then sum(Energykcal) end + 1e-7, 4)
                 as sum_Energykcal
        from (select * replace (case when TotalGrams > 0 then Energykcal end as Energykcal)
              from raw_diary)
        group by all""",
)
def raw_person_day_totals(spark: SparkSession, sf: str) -> DataFrame:
    raw = standin.raw_diary(spark, sf)
    gaps = raw.withColumn("Energykcal", F.when(F.col("TotalGrams") > 0, F.col("Energykcal")))
    return rounded(raw_day_totals(gaps), ["sum_Proteing", "sum_Energykcal"])


@query(
    "averaged_person_day_totals",
    f"""with {standin.DIARY_SQL}
        select {_PERSON_DAY},
               round(case when count(*) = count(Proteing) then sum(Proteing) end + 1e-7, 4)
                 as sum_Proteing,
               round(case when count(*) = count(Energykcal) then sum(Energykcal) end + 1e-7, 4)
                 as sum_Energykcal
        from (select * replace (case when TotalGrams > 0 then Energykcal end as Energykcal)
              from diary)
        group by all""",
)
def averaged_person_day_totals(spark: SparkSession, sf: str) -> DataFrame:
    # The same totals over the diary whose repeat servings were averaged first.
    diary = standin.diary(spark, sf)
    gaps = diary.withColumn("Energykcal", F.when(F.col("TotalGrams") > 0, F.col("Energykcal")))
    return rounded(raw_day_totals(gaps), ["sum_Proteing", "sum_Energykcal"])


INTAKE = [m for m in DAY_TOTALS if m != "sum_energy"]
_INTAKE_RULES_SQL = """
    members as (
      select 'adult male' as cohort, * from totals
      where Sex = 1 and AgeR > 18 and AgeR < 65 and sum_energy >= 800
      union all select 'adult female', * from totals
      where Sex = 2 and AgeR > 18 and AgeR < 65 and sum_energy >= 500
      union all select 'older female', * from totals
      where Sex = 2 and AgeR > 64 and sum_energy > 500 and sum_energy < 3500
      union all select 'older male', * from totals
      where Sex = 1 and AgeR > 64 and sum_energy > 800 and sum_energy < 4000
      union all select 'infants', * from totals where AgeR < 4
      union all select 'children', * from totals
      where AgeR >= 4 and AgeR <= 10 and sum_energy > 250 and sum_energy < 2500
      union all select 'adolescent male', * from totals
      where Sex = 1 and AgeR > 10 and AgeR < 19 and sum_energy between 500 and 3500
      union all select 'adolescent female', * from totals
      where Sex = 2 and AgeR between 11 and 18 and sum_energy between 500 and 3500)"""


@query(
    "intake_by_cohort",
    f"""with {TOTALS_SQL}, {_INTAKE_RULES_SQL}
        select cohort, Overall_Diet,
               {", ".join(f"round(avg({m}) + 1e-7, 4) as mean_{m}" for m in INTAKE)}
        from members group by all""",
)
def intake_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    means = intake_report(_totals(spark, sf))
    return rounded(means, ["mean_" + m for m in INTAKE])


_CHECKS_SQL = """
    checked as (
      select 'adult male' as cohort, * from days
      where Sex = 1 and AgeR >= 19 and AgeR <= 64 and energy >= 800
      union all select 'adult female', * from days
      where Sex = 2 and AgeR >= 19 and AgeR <= 64 and energy >= 500
      union all select 'older male', * from days where Sex = 1 and AgeR >= 65 and energy >= 800
      union all select 'older female', * from days where Sex = 2 and AgeR >= 65 and energy >= 500)"""


@query(
    "protein_checks_raw",
    f"""with {standin.RAW_SQL},
        days as (select {_PERSON_DAY}, sum(Proteing) as protein, sum(Energykcal) as energy
                 from raw_diary group by all), {_CHECKS_SQL}
        select cohort, round(avg(protein) + 1e-7, 4) as mean_sum_Proteing from checked group by cohort""",
)
def protein_checks_raw(spark: SparkSession, sf: str) -> DataFrame:
    means = intake_report(
        raw_day_totals(standin.raw_diary(spark, sf)),
        fixed.PROTEIN_CHECKS,
        ["sum_Proteing"],
        classes=[],
        energy="sum_Energykcal",
    )
    return rounded(means, ["mean_sum_Proteing"])


@query(
    "protein_checks_top_groups",
    f"""with {TOTALS_SQL}, days as (select *, sum_energy as energy from totals), {_CHECKS_SQL}
        select cohort, round(avg(sum_Proteing) + 1e-7, 4) as mean_sum_Proteing
        from checked group by cohort""",
)
def protein_checks_top_groups(spark: SparkSession, sf: str) -> DataFrame:
    means = intake_report(
        _totals(spark, sf), fixed.PROTEIN_CHECKS, ["sum_Proteing"], classes=[]
    )
    return rounded(means, ["mean_sum_Proteing"])


@query(
    "energy_mean_and_sd",
    f"""with {TOTALS_SQL}, days as (select *, sum_energy as energy from totals), {_CHECKS_SQL}
        select cohort, round(avg(sum_energy) + 1e-7, 4) as mean_sum_energy,
               round(stddev_samp(sum_energy) + 1e-7, 4) as sd_sum_energy
        from checked group by cohort""",
)
def energy_mean_and_sd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(energy_spread(_totals(spark, sf)), ["mean_sum_energy", "sd_sum_energy"])


@query(
    "class_means_of_one_sex",
    f"""with {TOTALS_SQL}
        select Overall_Diet, {", ".join(f"round(avg({m}) + 1e-7, 4) as mean_{m}" for m in INTAKE)}
        from totals where Sex = 1 group by Overall_Diet""",
)
def class_means_of_one_sex(spark: SparkSession, sf: str) -> DataFrame:
    means = class_report(_totals(spark, sf), 1, INTAKE)
    return rounded(means, ["mean_" + m for m in INTAKE])


DEMOGRAPHICS_SQL = f"""{standin.CLASSIFIED_SQL}, {standin.PERSON_SQL},
    demographics as (
      select t.seriali, Overall_Diet, Sex, AgeR, Weight, region
      from diets t left join person p on t.seriali = p.seriali)"""


def _demographics(spark: SparkSession, sf: str) -> DataFrame:
    attributes = standin.people(spark, sf, "Sex", "AgeR", "Weight", "region")
    return demographics(person_diets(_evidence(spark, sf)), attributes)


@query(
    "demographics_file",
    f"""with {DEMOGRAPHICS_SQL}
        select seriali, Overall_Diet, Sex, AgeR, round(Weight + 1e-7, 4) as Weight, region
        from demographics""",
)
def demographics_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "demographics")
    people = _demographics(spark, sf)
    write_csv(people, path)
    return rounded(read_csv(spark, path, people.schema, multiline=False), ["Weight"])


@query(
    "demographics",
    f"""with {DEMOGRAPHICS_SQL}
        select seriali, Overall_Diet, Sex, AgeR, round(Weight + 1e-7, 4) as Weight, region
        from demographics""",
)
def demographics_of_people(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_demographics(spark, sf), ["Weight"])


_WEIGHTS_SQL = """
    banded as (
      select 'adult male' as cohort, Weight from people where Sex = 1 and AgeR > 18 and AgeR < 65
      union all select 'adult female', Weight from people
      where Sex = 2 and AgeR > 18 and AgeR < 65
      union all select 'older male', Weight from people where Sex = 1 and AgeR > 64
      union all select 'older female', Weight from people where Sex = 2 and AgeR > 64
      union all select 'infants', Weight from people where AgeR < 4
      union all select 'children', Weight from people where AgeR > 3 and AgeR < 11
      union all select 'adolescent male', Weight from people
      where Sex = 1 and AgeR > 10 and AgeR < 19
      union all select 'adolescent female', Weight from people
      where Sex = 2 and AgeR > 10 and AgeR < 19)
    select cohort, round(avg(Weight) + 1e-7, 4) as "mean_Weight" from banded group by cohort"""


@query(
    "weights_as_recorded",
    f"with {DEMOGRAPHICS_SQL}, people as (select * from demographics), {_WEIGHTS_SQL}",
)
def weights_as_recorded(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weight_report(_demographics(spark, sf)), ["mean_Weight"])


@query(
    "weights_measured",
    f"""with {DEMOGRAPHICS_SQL},
        people as (select * replace (case when Weight <> -1 then Weight end as Weight)
                   from demographics), {_WEIGHTS_SQL}""",
)
def weights_measured(spark: SparkSession, sf: str) -> DataFrame:
    means = weight_report(_demographics(spark, sf), not_measured=fixed.NOT_MEASURED)
    return rounded(means, ["mean_Weight"])


PRODUCT_CODE = "Brand#5-PROMO"
PRODUCTS_SQL = f"""{standin.CLASSIFIED_SQL},
    products as (
      select *, Proteing / nullif(TotalGrams, 0) * 100 as Proteing100g,
             {standin._any_of("FoodName", fixed.POWDER_WORDS)} as nutrition_powders,
             {standin._any_of("FoodName", fixed.DRINK_WORDS)} as nutrition_drinks,
             {standin._any_of("FoodName", fixed.BAR_WORDS)} as nutrition_bars
      from classified where SubFoodGroupCode = '{PRODUCT_CODE}')"""


def _products(spark: SparkSession, sf: str) -> DataFrame:
    return nutrition_products(standin.classified(spark, sf), PRODUCT_CODE)


@query(
    "nutrition_products",
    f"""with {PRODUCTS_SQL}
        select seriali, DayNo, FoodNumber, FoodName, Overall_Diet,
               round(Proteing + 1e-7, 4) as Proteing, round(Proteing100g + 1e-7, 4) as Proteing100g,
               nutrition_powders, nutrition_drinks, nutrition_bars from products""",
)
def products_of_one_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = _products(spark, sf).select(
        "seriali",
        "DayNo",
        "FoodNumber",
        "FoodName",
        "Overall_Diet",
        "Proteing",
        "Proteing100g",
        "nutrition_powders",
        "nutrition_drinks",
        "nutrition_bars",
    )
    return rounded(rows, ["Proteing", "Proteing100g"])


@query(
    "product_labels",
    f"""with {PRODUCTS_SQL}
        select seriali, DayNo, FoodName, FoodNumber,
               case when nutrition_powders then 'Powders' when nutrition_drinks then 'Drinks'
                    else 'Bars' end as form from products""",
)
def labels_of_products(spark: SparkSession, sf: str) -> DataFrame:
    return product_labels(_products(spark, sf))


@query(
    "product_means_by_diet",
    f"""with {PRODUCTS_SQL}
        select Overall_Diet, round(avg(Proteing) + 1e-7, 4) as "mean_Proteing",
               round(avg(Proteing100g) + 1e-7, 4) as "mean_Proteing100g"
        from products group by Overall_Diet""",
)
def product_means_by_diet(spark: SparkSession, sf: str) -> DataFrame:
    means = product_means(_products(spark, sf), ["Proteing", "Proteing100g"])
    return rounded(means, ["mean_Proteing", "mean_Proteing100g"])


@query(
    "enriched_product_means",
    f"""with {standin.ENRICHED_SQL}
        select Overall_Diet, round(avg(Proteing) + 1e-7, 4) as "mean_Proteing",
               round(avg(Protein_g100g) + 1e-7, 4) as "mean_Protein_g100g",
               round(avg(LYSg) + 1e-7, 4) as "mean_LYSg"
        from enriched where MainFoodGroupCode = 'PROMO' group by Overall_Diet""",
)
def enriched_product_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = standin.enriched(spark, sf).where(F.col("MainFoodGroupCode") == "PROMO")
    means = product_means(rows, ["Proteing", "Protein_g100g", "LYSg"])
    return rounded(means, ["mean_Proteing", "mean_Protein_g100g", "mean_LYSg"])


@query(
    "filled_code_list",
    """select * from (
         select last_value(code ignore nulls) over (
                  order by p_partkey rows between unbounded preceding and current row)
                  as "SubFoodGroupCode",
                cast(p_partkey as varchar) as "NDB no", p_name as "FDC Id"
         from (select *, case when p_partkey = floor(p_partkey / 7) * 7 + 3
                              then p_brand || '-' || p_type end as code
               from part where p_size > 10))
       where "SubFoodGroupCode" is not null""",
)
def filled_code_list(spark: SparkSession, sf: str) -> DataFrame:
    return filled_codes(standin.food_list(spark, sf), ["row"])


@query(
    "ages_in_diary",
    f"with {standin.DIARY_SQL} select distinct AgeR from diary",
)
def ages_in_diary(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_values(standin.diary(spark, sf), ["AgeR"])


@query(
    "intake_by_cohort_and_class",
    f"""with {TOTALS_SQL}, {_INTAKE_RULES_SQL}
        select case when grouping(Overall_Diet) = 1 then 'cohort' else 'class' end as level,
               cohort, Overall_Diet,
               {", ".join(f"round(avg({m}) + 1e-7, 4) as mean_{m}" for m in INTAKE)}
        from members group by grouping sets ((cohort, Overall_Diet), (cohort))""",
)
def intake_with_and_without_class(spark: SparkSession, sf: str) -> DataFrame:
    means = intake_levels(_totals(spark, sf))
    return rounded(means, ["mean_" + m for m in INTAKE])


@query(
    "waves_from_states",
    """select 'mean' as figure, l_returnflag, year, round(avg(l_quantity) + 1e-7, 4) as l_quantity,
              round(avg(l_discount) + 1e-7, 4) as l_discount
       from (select *, year(l_shipdate) as year from lineitem) group by l_returnflag, year
       union all
       select 'sum', l_returnflag, null, round(sum(l_quantity) + 1e-7, 4),
              round(sum(l_discount) + 1e-7, 4)
       from lineitem group by l_returnflag""",
)
def waves_from_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of the years to 1996 and of the later ones are stored apart, then read together."""
    lines = table(spark, sf, "lineitem").select(
        "l_returnflag", F.year("l_shipdate").alias("year"), "l_quantity", "l_discount"
    )
    path, measures = scratch_path(spark, "waves"), ["l_quantity", "l_discount"]
    for waves in (F.col("year") <= 1996, F.col("year") > 1996):
        add_waves(lines.where(waves), path, ["l_returnflag"], measures, "year")
    means = wave_figures(spark, path, ["l_returnflag", "year"], measures)
    sums = wave_figures(spark, path, ["l_returnflag"], measures, "sum")
    both = means.withColumn("figure", F.lit("mean")).unionByName(
        sums.withColumns({"figure": F.lit("sum"), "year": F.lit(None).cast("int")})
    )
    return rounded(both, measures)
