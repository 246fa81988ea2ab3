import random

from conftest import rows

from larderline.operators.ranking import reorder_top, top_n, top_n_per_class
from larderline.plans.supply import REPORTS, chart_data, reported_servings, supply_ranking

NAN = float("nan")


def test_missing_and_nan_rank_last_and_ties_go_by_key(spark):
    df = spark.createDataFrame(
        [("d", 1.0), ("c", NAN), ("b", 1.0), ("a", None), ("e", 2.0)], "k string, x double"
    )
    assert [r.k for r in top_n(df, "x", 5, ["k"]).collect()] == ["e", "b", "d", "a", "c"]
    assert [r.k for r in top_n(df, "x", 2, ["k"]).collect()] == ["e", "b"]


def test_rounded_ranking_ignores_noise(spark):
    df = spark.createDataFrame([("b", 0.1 + 0.2), ("a", 0.3)], "k string, x double")
    assert [r.k for r in top_n(df, "x", 2, ["k"], digits=6).collect()] == ["a", "b"]


def test_one_pass_over_classes_equals_filtered_top_ns(spark):
    rng = random.Random(6)
    data = [(rng.choice("vwx"), i, rng.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(data, "c string, i int, x int")
    together = top_n_per_class(df, ["c"], "x", 7, ["i"]).drop("position")
    apart = [t for c in "vwx" for t in rows(top_n(df.where(f"c = '{c}'"), "x", 7, ["i"]))]
    assert rows(together) == sorted(apart, key=repr)


def test_reorder_keeps_the_chosen_rows(spark):
    df = spark.createDataFrame([("a", 9, 1), ("b", 8, 3), ("c", 1, 99)], "k string, x int, y int")
    shown = reorder_top(top_n(df, "x", 2, ["k"]), "y", ["k"])
    assert rows(shown, "shown_at") == [("b", 8, 3, 1), ("a", 9, 1, 2)]


def test_supply_shapes(spark):
    df = spark.createDataFrame(
        [
            ("p", "v", "f", "g", 1.0, 5.0),
            ("p", "v", "f", "g", 2.0, 5.0),
            ("q", "v", "f", "g", 5.0, 1.0),
            ("q", "v", "h", "j", 3.0, 9.0),
            ("r", "w", "h", "j", 7.0, 4.0),
        ],
        "person string, diet string, food string, grp string, x double, y double",
    )
    entity, item = ["person", "food", "grp"], ["grp"]
    overall = supply_ranking(df, entity, item, "x", 5)
    assert [tuple(r) for r in overall.collect()] == [("j", 5.0), ("g", 4.0)]
    per_class = supply_ranking(df, [*entity, "diet"], item, "x", 1, by_class="diet")
    assert rows(per_class) == [("v", "g", 4.0, 1), ("w", "j", 7.0, 1)]
    plain = supply_ranking(df, [], item, "x", 1)
    assert [tuple(r) for r in plain.collect()] == [("j", 5.0)]
    shown = supply_ranking(df, entity, item, "x", 2, show_by="y")
    assert [r.grp for r in shown.orderBy("shown_at").collect()] == ["j", "g"]


def test_chart_keeps_categories_that_the_limits_empty(spark):
    top = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("b", 90.0), ("c", 2.5)], "cat string, x double"
    )
    got = chart_data(top, "cat", "x", limits=(0, 45)).orderBy("place")
    assert [(r.cat, r.place, r.n, r.median) for r in got.collect()] == [
        ("a", 1, 2, 2.0),
        ("c", 2, 1, 2.5),
        ("b", 3, 0, None),
    ]


def test_reported_servings_are_distinct_rows(spark):
    row = ("p", "m", "M", "s", "S", 10.0, 4.0)
    cols = "seriali string, MainFoodGroupCode string, MainFoodGroupDesc string, " \
           "SubFoodGroupCode string, SubFoodGroupDesc string, TotalGrams double, " \
           "Proteing double, Veg string"
    data = [(*row, "2"), (*row, "2"), (*row[:6], 9.0, "1"), (*row[:6], 5.0, "2")]
    got = reported_servings(spark.createDataFrame(data, cols)).collect()
    assert [r.Proteing for r in got] == [5.0, 4.0]


def test_every_published_ranking_is_listed():
    # 20 definitions stand for the 43 published rankings: most cover four classes at once.
    assert len(REPORTS) == 20
    assert {r.n for r in REPORTS.values()} == {20, 60}
