"""The jobs on a small hand-made diary with the expected rows written out."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from larderline.operators.aggregates import strongest_label
from larderline.plans import fixed_values as fixed
from larderline.plans.diary import (
    classify,
    deduplicate,
    diet_flags,
    person_attributes,
    person_diets,
    reported_and_actual,
    row_diet,
    type_diary,
    with_diet,
    with_person,
)
from larderline.plans.enrichment import CONTENT, composition, digestibility, enrich, food_matches
from larderline.plans.intake import (
    DAY_TOTALS,
    day_totals,
    demographics,
    energy_spread,
    raw_day_totals,
)
from larderline.plans.products import nutrition_products, product_labels, product_means
from larderline.queries import standin
from larderline.session import scratch_path
from larderline.sources import read_csv, write_csv

COLUMNS = (
    "seriali SurveyYear DayNo AgeR Sex Country FoodName FoodNumber SubFoodGroupCode "
    "SubFoodGroupDesc MainFoodGroupCode MainFoodGroupDesc TotalGrams Proteing Energykcal"
).split()


def line(person, day, age, sex, food, sub, main, grams, protein, energy):
    return (
        person, "9", day, age, sex, "E", food, food[:4], sub, f"sub {sub}", main[:2], main,
        grams, protein, energy,
    )


RAW = [
    line("101", "1", "30", "1", "Roast chicken", "A", "CHICKEN AND TURKEY DISHES", "100", "30", "900"),
    line("101", "1", "30", "1", "Roast chicken", "A", "CHICKEN AND TURKEY DISHES", "300", "50", "bad"),
    line("101", "2", "30", "1", "Lentil soup", "B", "VEGETABLES", "200", "10", "NA"),
    line("102", "1", "3", "2", "Fish fingers", "C", "WHITE FISH COATED OR FRIED", "80", "12", "200"),
    line("102", "1", "3", "2", "Lentil soup", "B", "VEGETABLES", "100", None, "90"),
    line("103", "1", "70", "2", "Egg mayo", "D", "EGGS AND EGG DISHES", "50", "6", "600"),
    line("104", "1", "18", "2", "Veggie burger", "B", "VEGETABLES", "0", "9", "500"),
    line("105", "1", "19", "1", "Lentil soup", "B", "VEGETABLES", "100", "5", "800"),
    line("105", "1", "19", "1", "PROTEIN SHAKE dry", "50E", "SUPPLEMENTS", "40", "20", "150"),
    line("105", "2", "19", "1", None or "Ensure", "50E", "SUPPLEMENTS", "0", "8", "150"),
]


@pytest.fixture(scope="module")
def raw(spark):
    text = ", ".join(f"{c} string" for c in COLUMNS)
    return type_diary(spark.createDataFrame(RAW, text), positions=(13, 15))


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame(
        [(101.0, "1", 1, 30, 80.0), (102.0, "2", 2, 3, -1.0), (104.0, "2", 2, 18, 55.0)],
        "seriali double, Veg string, Sex int, AgeR int, Weight double",
    )
    return person_attributes(df, ["Veg", "Sex", "AgeR", "Weight"])


def test_typing(raw):
    types = dict(raw.dtypes)
    assert (types["AgeR"], types["Sex"], types["Energykcal"]) == ("int", "int", "double")
    assert raw.where("Energykcal is null").count() == 2


def test_deduplication_averages_or_adds(raw):
    def chicken(how):
        kept = deduplicate(raw, how=how).where(F.col("FoodName") == "Roast chicken")
        (row,) = kept.collect()
        return row.TotalGrams, row.Proteing, row.Energykcal

    assert chicken("mean") == (200.0, 40.0, 900.0)
    assert chicken("sum") == (400.0, 80.0, 900.0)


def test_diets(raw, people):
    want = {
        "101": "Neither",
        "102": "Pescatarian",
        "103": "Vegetarian",
        "104": "Vegetarian",  # "EGG" is found inside "Veggie"
        "105": "Vegan",
    }
    for by_text in (True, False):
        labelled = row_diet(diet_flags(raw, by_text=by_text))
        assert dict(rows(person_diets(labelled))) == want
    strict = row_diet(diet_flags(raw, by_text=False, whole_word=True))
    assert dict(rows(person_diets(strict)))["104"] == "Vegan"
    diets = person_diets(labelled, people)
    assert rows(reported_and_actual(diets).where("Veg is not null")) == [
        ("1", "Neither", 1),
        ("2", "Pescatarian", 1),
        ("2", "Vegetarian", 1),
    ]


def test_diet_by_rank_equals_diet_by_flags(raw):
    flagged = diet_flags(raw, by_text=False)
    by_rank = dict(
        rows(strongest_label(row_diet(flagged), ["seriali"], "Diet", fixed.DIETS, "d"))
    )
    any_of = flagged.groupBy("seriali").agg(
        *[F.bool_or(f).alias(f) for f, _ in fixed.DIET_CASES]
    )
    by_flag = {
        r.seriali: next((label for f, label in fixed.DIET_CASES if r[f]), "Vegan")
        for r in any_of.collect()
    }
    assert by_rank == by_flag


def test_class_is_the_same_from_raw_or_deduplicated_rows(raw):
    diary = deduplicate(raw)
    assert rows(classify(raw, diary)) == rows(classify(diary))
    assert classify(diary).count() == diary.count()


def test_person_columns_do_not_collide(raw, people):
    joined = with_person(raw, people)
    assert {"AgeR", "Sex", "AgeR_person", "Sex_person"} <= set(joined.columns)
    assert joined.count() == raw.count()


def test_day_totals_with_and_without_missing_days(raw):
    days = {(r.seriali, r.DayNo): r for r in raw_day_totals(raw).collect()}
    assert days["101", "1"].sum_Energykcal is None and days["101", "1"].sum_Proteing == 80.0
    assert days["102", "1"].sum_Proteing is None and days["102", "1"].sum_Energykcal == 290.0
    assert days["105", "1"].sum_Energykcal == 950.0


def test_products(raw):
    diary = classify(raw)
    products = nutrition_products(diary, nutrients=["Energykcal", "Proteing"])
    got = {r.FoodName: (r.form, r.Proteing100g) for r in products.collect()}
    # A powder word wins over a drink word; no weight, no density.
    assert got == {"PROTEIN SHAKE dry": ("Powders", 50.0), "Ensure": ("Drinks", None)}
    assert rows(product_means(products)) == [("Vegan", 14.0)]
    assert product_labels(products).columns[-1] == "form"


def food_frames(spark):
    contents = [("A", 1.0), ("A", 3.0), ("B", 4.0), (None, 9.0)]
    raw_contents = spark.createDataFrame(contents, "SubFoodGroupCode string, x double").select(
        "SubFoodGroupCode",
        *[(F.col("x") * i).alias(c) for i, c in enumerate(CONTENT, 1) if c != "HYPg"],
        F.lit(None).cast("double").alias("HYPg"),
    )
    match_rows = [
        (i, "m", "m", s, s, 1.0, 1.0, d, a, "1", "1", "1", "1")
        for i, (s, d, a) in enumerate([("A", 20.0, "1"), ("B", 10.0, "1"), ("C", 5.0, "n/a")])
    ]
    matches = spark.createDataFrame(match_rows, fixed.MATCH_COLUMNS)
    coef_names = ["Protein_Dig", *[c for _, _, c in fixed.DIGESTIBLE]]
    coef_rows = [("A", "hen", *([0.5] * 13)), ("B", "pea", *([0.9] * 12), None)]
    text = "SubFoodGroupCode string, Food_item_name string, "
    coefs = spark.createDataFrame(coef_rows, text + ", ".join(f"{c} double" for c in coef_names))
    coefs = coefs.withColumns({"_c37": F.lit(None), "NDB no": F.lit("1"), "Sr_no": F.lit(1)})
    return raw_contents, food_matches(matches), digestibility(coefs)


def test_enrichment(spark, raw):
    raw_contents, matches, coefs = food_frames(spark)
    assert rows(matches.select("SubFoodGroupCode")) == [("A",), ("B",)]
    assert coefs.columns[:3] == ["SubFoodGroupCode", "Digest_food", "Protein_Dig"]
    assert rows(coefs.select("SubFoodGroupCode", "Digest_food")) == [("A", "hen")]
    contents = composition(raw_contents, matches)
    diary = classify(raw, deduplicate(raw))
    top = spark.createDataFrame([("A",), ("B",), ("C",)], "SubFoodGroupCode string")
    enriched = enrich(diary, top, contents, coefs)
    # C has no contents and is dropped; B has no complete coefficients and stays.
    assert {r[0] for r in enriched.select("SubFoodGroupCode").collect()} == {"A", "B"}
    chicken = enriched.where("SubFoodGroupCode = 'A'").first()
    assert (chicken.TRPg, chicken.Digest_TRP, chicken.HYPg) == (2.0, 1.0, None)
    assert (chicken.Digest_total_protein, chicken.Digest_protein_g100g) == (20.0, 10.0)
    totals = day_totals(enriched)
    assert set(DAY_TOTALS) <= set(totals.columns) and len(DAY_TOTALS) == 27
    soup = totals.where("seriali = '101' and DayNo = '2'").first()
    assert (soup.sum_TRPg, soup.sum_dig_TRP, soup.sum_energy) == (4.0, 0.0, 0.0)
    weighted = day_totals(enriched, weight="TotalGrams").where("seriali = '101' and DayNo = '2'")
    assert weighted.first().sum_TRPg == 8.0  # 200 g at 4 per 100 g
    assert rows(energy_spread(totals)) == [
        ("adult male", 850.0, pytest.approx(50 * 2**0.5)),
    ]


def test_repeated_coefficients_fan_out(spark, raw):
    raw_contents, matches, coefs = food_frames(spark)
    contents = composition(raw_contents, matches)
    top = spark.createDataFrame([("A",)], "SubFoodGroupCode string")
    diary = classify(raw, deduplicate(raw))
    once = enrich(diary, top, contents, coefs).count()
    # Both the coefficients and the amounts made from them are then matched twice.
    assert enrich(diary, top, contents, coefs.union(coefs)).count() == 4 * once


def test_classified_diary_and_demographics_as_files(spark, raw, people):
    diary = classify(raw, deduplicate(raw)).select("seriali", "FoodName", "Overall_Diet")
    who = demographics(person_diets(row_diet(diet_flags(raw))), people)
    for frame in (diary, who):
        path = scratch_path(spark, "report")
        write_csv(frame, path)
        assert rows(read_csv(spark, path, frame.schema)) == rows(frame)


def test_the_diary_is_deduplicated_where_the_last_join_left_it(spark, tmp_path):
    tables = {
        "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double",
        "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp",
        "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
        "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    }
    for name, columns in tables.items():
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    # Large people: the rows move by person for the join, and not again by all twelve keys.
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = standin.diary(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert "hashpartitioning(seriali#" in plan
    assert not re.search(r"hashpartitioning\(seriali#\d+L?, SurveyYear", plan)


def test_the_diary_moves_once_by_person_where_people_are_broadcast(spark, tmp_path):
    when = "timestamp '1997-05-01 00:00:00'"
    tables = {
        "lineitem": "1L l_orderkey, 7L l_partkey, 50D l_quantity, 900D l_extendedprice, 0D l_discount, 0D l_tax",
        "orders": f"1L o_orderkey, 3L o_custkey, {when} o_orderdate",
        "customer": "3L c_custkey, 1 c_nationkey, 10D c_acctbal, 'BUILDING' c_mktsegment",
        "part": "7L p_partkey, 'hot gizmo' p_name, 'Brand#1' p_brand, 'LARGE' p_type",
    }
    for name, columns in tables.items():
        spark.sql(f"select {columns}").write.parquet(f"{tmp_path}/{name}.parquet")
    diary = standin.diary(spark, str(tmp_path))
    for made in (diary, raw_day_totals(diary), deduplicate(standin.raw_diary(spark, str(tmp_path), True), how="sum")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        assert re.findall(r"hashpartitioning\((.*?)#\d+L?, ", plan) == ["seriali"]
    assert [(r.seriali, r.FoodName, r.Waterg) for r in diary.collect()] == [("3", "hot gizmo beef stew", 9.0)]


def test_person_days_are_added_up_where_their_rows_are(spark, monkeypatch):
    kinds = ", ".join([*[f"{c} string" for c in standin.KEYS], *[f"{m} double" for m in standin.MEASURES]])
    made = spark.createDataFrame([("a",) * len(standin.KEYS) + (1.0,) * len(standin.MEASURES)], kinds)
    part = "7L p_partkey, 'hot gizmo' p_name, 'Brand#1' p_brand, 'LARGE' p_type, 5 p_size, 2D p_retailprice"
    monkeypatch.setattr(standin, "table", lambda spark, sf, name: spark.sql(f"select {part}"))
    monkeypatch.setattr(standin, "_staged_diary", lambda spark, sf, columns: made)
    monkeypatch.setattr(standin, "enrich", lambda rows, top, contents, coefficients: top)
    monkeypatch.setattr(standin, "classify", lambda rows, diary: diary)
    plan = standin.enriched(spark, "")._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((\w+)#\d+L?, (\w+)", plan)[-1][0] == "seriali"
    assert not re.search(r"hashpartitioning\(seriali#\d+, DayNo", plan)


def test_classes_and_answers_leave_the_rows_by_person(spark):
    diary = spark.createDataFrame([("1", "egg", 1.0)], "seriali string, FoodName string, x double")
    diets = spark.createDataFrame([("1", "Vegan")], "seriali string, Overall_Diet string")
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for join in (with_diet, with_person):
            joined = join(diary, diets).groupBy("seriali", "FoodName", "Overall_Diet").sum("x")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "coalesce(seriali" not in plan
            # One exchange for each side, none for the grouping.
            assert plan.count("hashpartitioning(") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)


def test_a_missing_person_still_gets_a_class_and_answers(spark):
    diary = spark.createDataFrame([("1", "a"), (None, "b"), ("2", "c")], "seriali string, FoodName string")
    who = "seriali string, Overall_Diet string"
    diets = spark.createDataFrame([("1", "Vegan"), (None, "Neither")], who)
    want = [("1", "a", "Vegan"), ("2", "c", None), (None, "b", "Neither")]
    columns = ["seriali", "FoodName", "Overall_Diet"]
    assert rows(with_diet(diary, diets).select(columns)) == sorted(want, key=repr)
    assert rows(with_person(diary, diets).select(columns)) == sorted(want, key=repr)


def test_only_wanted_columns_of_the_diary_are_written(spark, monkeypatch):
    empty = {c: "string" for c in standin.KEYS} | {m: "double" for m in standin.MEASURES}
    made = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in empty.items()))
    monkeypatch.setattr(standin, "diary", lambda spark, sf: made)
    written = []
    monkeypatch.setattr(standin, "staged", lambda df, name: written.append(df.columns) or df)
    standin.classified(spark, "", ["Fatg"])
    standin.classified(spark, "")
    gone = {"SurveyYear", "FoodNumber", "AgeR", "Waterg"}
    assert "Fatg" in written[0] and not gone & set(written[0])
    assert set(written[1]) == set(empty)
