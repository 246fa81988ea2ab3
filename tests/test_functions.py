from conftest import rows
from pyspark.sql import functions as F

from larderline.functions import (
    columns_at,
    first_label,
    keyword_pattern,
    label_of_rank,
    matches_any,
    numeric_columns,
    pair_products,
    per_hundred,
    plain_id,
    rank_of_label,
    to_int,
    to_number,
)
from larderline.operators.projection import (
    cast_ids,
    cast_positions,
    discard,
    drop_matching,
    keep,
    rename,
)
from larderline.operators.projection import cast_numbers


def values(spark, column, data, ddl):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {ddl}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_bad_numbers_become_missing(spark):
    texts = ["1.5", " 2 ", "x", "", "1.5d", "2F", "1e3", None, "Infinity"]
    got = values(spark, to_number("v"), texts, "string")
    assert got == [1.5, 2.0, None, None, None, None, 1000.0, None, float("inf")]


def test_ages_compare_as_numbers(spark):
    df = spark.createDataFrame([("3",), ("10",), ("64",)], "age string")
    adults = df.withColumn("age", to_int("age")).where(F.col("age") > 18)
    assert [r.age for r in adults.collect()] == [64]


def test_ids_keep_plain_digits(spark):
    assert values(spark, plain_id("v"), [101011021.0, 7.0, None], "double") == [
        "101011021",
        "7",
        None,
    ]
    texts = ["A1", "007", "12345678901234567", "1e3"]
    assert values(spark, plain_id("v"), texts, "string") == texts
    large = [9007199254740993, 2**60 + 1]
    assert values(spark, plain_id("v"), large, "bigint") == [str(x) for x in large]


def test_accents_are_letters(spark):
    texts = ["CRÈME BRÛLÉE", "crème", "DÉCRÈME"]
    assert values(spark, matches_any("v", ["crème"]), texts, "string") == [True, True, True]
    whole = matches_any("v", ["crème"], whole_word=True)
    assert values(spark, whole, texts, "string") == [True, True, False]


def test_numeric_columns_are_cast_without_text_tests(spark):
    df = spark.createDataFrame([(1, "2"), (3, "1.5d")], "a int, b string")
    cast = cast_numbers(df, ["a", "b"])
    assert [tuple(r) for r in cast.collect()] == [(1.0, 2.0), (3.0, None)]
    plan = cast.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "endswith" not in plan.lower()


def test_keyword_matching(spark):
    texts = ["veggie burger", "an egg", None, "yoghurt", "MILK, WHOLE", "MILK. WHOLE"]
    assert values(spark, matches_any("v", ["EGG"]), texts, "string") == [
        True,
        True,
        False,
        False,
        False,
        False,
    ]
    whole = values(spark, matches_any("v", ["EGG"], whole_word=True), texts, "string")
    assert whole == [False, True, False, False, False, False]
    wild = values(spark, matches_any("v", ["milk. whole"]), texts, "string")
    assert wild == [False] * 4 + [True, True]
    quoted = values(spark, matches_any("v", ["milk. whole"], literal=True), texts, "string")
    assert quoted == [False] * 5 + [True]
    assert keyword_pattern(["A", "B"]) == "(?iu)A|B"


def test_density_of_zero_weight_is_missing(spark):
    df = spark.createDataFrame([(3.0, 6.0), (3.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(per_hundred("a", "b")).collect()] == [50.0, None, None]


def test_first_label_wins_and_missing_conditions_fall_through(spark):
    df = spark.createDataFrame(
        [(None, True), (True, True), (False, False), (None, None)], "a boolean, b boolean"
    )
    label = first_label([(F.col("a"), "A"), (F.col("b"), "B")], "rest")
    assert [r[0] for r in df.select(label).collect()] == ["B", "A", "rest", "rest"]


def test_label_ranks_are_inverse(spark):
    order = ["strong", "middle", "weak"]
    df = spark.createDataFrame([(x,) for x in order], "v string")
    back = df.withColumn("r", rank_of_label("v", order)).withColumn("b", label_of_rank("r", order))
    assert all(r.v == r.b for r in back.collect())


def test_column_sets(spark):
    df = spark.createDataFrame([("1", "2", "x", 4)], "a string, b string, c string, d int")
    assert numeric_columns(df) == ["d"]
    assert list(columns_at(df, 2, 3)) == ["b", "c"]
    assert rows(cast_positions(df, 1, 3)) == [(1.0, 2.0, None, 4)]
    assert keep(df, ["a"]).columns == ["a"]
    assert discard(df, ["a", "nope"]).columns == ["b", "c", "d"]
    assert rename(df, {"a": "z"}).columns == ["z", "b", "c", "d"]
    blank = df.withColumnRenamed("b", "_c37")
    assert drop_matching(blank).columns == ["a", "c", "d"]
    assert cast_ids(df, ["d"]).first()["d"] == "4"


def test_pair_products(spark):
    df = spark.createDataFrame([(2.0, 3.0), (None, 3.0)], "a double, k double")
    got = df.withColumns(pair_products({"ak": ("a", "k")})).select("ak").collect()
    assert [r.ak for r in got] == [6.0, None]
