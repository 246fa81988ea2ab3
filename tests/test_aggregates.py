import random

from conftest import rows
from pyspark.sql import functions as F

from larderline.operators.aggregates import (
    class_means,
    group_count,
    mean_and_sd,
    means_where,
    named_sums,
    strongest_label,
    summarise_numeric,
    two_level,
)

NAN = float("nan")


def test_all_missing_sums_to_zero_and_has_no_mean(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", NAN), ("b", None), ("b", NAN)], "k string, x double"
    )
    assert rows(summarise_numeric(df, ["k"], "sum"), "k") == [("a", 1.0), ("b", 0.0)]
    assert rows(summarise_numeric(df, ["k"], "mean"), "k") == [("a", 1.0), ("b", None)]
    assert rows(summarise_numeric(df, ["k"], "strict_sum"), "k") == [("a", None), ("b", None)]


def test_only_numeric_columns_are_summarised(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "t", True)], "k string, i int, x double, t string, f boolean")
    assert summarise_numeric(df, ["k"]).columns == ["k", "i", "x"]


def test_outer_mean_counts_inner_groups(spark):
    # Two people had the item: 10 in five servings, and 2; a third ate it with no amount known.
    df = spark.createDataFrame(
        [("p", "f", 2.0)] * 5 + [("q", "f", 2.0), ("r", "f", None)],
        "person string, item string, x double",
    )
    got = two_level(df, ["person", "item"], ["item"])
    assert rows(got) == [("f", (10 + 2 + 0) / 3)]
    assert rows(summarise_numeric(df, ["item"])) == [("f", 2.0)]


def test_strict_totals(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", None, 3.0), ("b", 4.0, 5.0)], "k string, x double, y double"
    )
    got = named_sums(df, ["k"], {"sx": "x", "sy": "y"}, strict=True)
    assert rows(got, "k") == [("a", None, 5.0), ("b", 4.0, 5.0)]


def test_means_in_one_pass(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (2, 8.0)], "s int, x double")
    means = {"one": (F.col("s") == 1, "x"), "two": (F.col("s") == 2, "x"), "none": (F.col("s") > 9, "x")}
    assert rows(means_where(df, means)) == [(2.0, 6.0, None)]


def test_sd_of_one_value_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, x double")
    assert rows(mean_and_sd(df, "x", ["k"]), "k") == [("a", 1.0, None), ("b", 2.0, 2.0**0.5)]


def test_class_means_and_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "k string, x double")
    assert rows(class_means(df, ["k"], ["x"]), "k") == [("a", 1.0), ("b", 3.0)]
    assert [tuple(r) for r in group_count(df, ["k"]).collect()] == [("b", 2), ("a", 1)]


def test_strongest_label_equals_boolean_form(spark):
    rng = random.Random(2)
    order = ["Neither", "Pescatarian", "Vegetarian", "Vegan"]
    data = [(rng.randrange(60), rng.choice(order[rng.randrange(4) :])) for _ in range(150)]
    df = spark.createDataFrame(data, "p int, d string")
    got = dict(rows(strongest_label(df, ["p"], "d", order, "best")))
    want = {p: next(o for o in order if (p, o) in set(data)) for p, _ in data}
    assert got == want
