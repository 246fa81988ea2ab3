import pytest
from conftest import rows
from pyspark.sql import functions as F

from larderline.operators.spread import any_hash
from larderline.operators.joins import (
    hot_keys,
    join_chain,
    left_join,
    left_join_complete,
    left_join_skewed,
    require_unique,
    restrict_to,
)
from larderline.sources.delimited import append_by_name


@pytest.fixture
def fact(spark):
    return spark.createDataFrame(
        [("a", 1, 10), ("b", 2, 20), (None, 3, 30), ("z", 4, 40)], "k string, i int, v int"
    )


@pytest.fixture
def dim(spark):
    return spark.createDataFrame(
        [("a", 100, "x"), ("b", 200, "y"), (None, 300, "n")], "k string, v int, w string"
    )


def test_unmatched_rows_stay_and_names_get_suffixes(fact, dim):
    joined = left_join(fact, dim, "k")
    assert joined.columns == ["k", "i", "v_x", "v_y", "w"]
    assert rows(joined, "i") == [
        ("a", 1, 10, 100, "x"),
        ("b", 2, 20, 200, "y"),
        (None, 3, 30, None, None),
        ("z", 4, 40, None, None),
    ]
    assert left_join(fact, dim, "k", suffixes=("", "_d")).columns == ["k", "i", "v", "v_d", "w"]


def test_missing_key_meets_missing_key_only_when_asked(fact, dim):
    matched = left_join(fact, dim, "k", null_safe=True).where("i = 3").first()
    assert matched.v_y == 300


def test_repeated_codes_fan_out_and_can_be_refused(spark, fact, dim):
    twice = dim.union(dim)
    assert left_join(fact, twice, "k").count() == 6
    assert left_join(fact, dim, "k").count() == fact.count()
    with pytest.raises(ValueError):
        require_unique(twice, ["k"])
    with pytest.raises(ValueError):
        left_join(fact, twice, "k", unique=True)


def test_label_made_from_the_same_table_joins_back(fact):
    label = fact.groupBy("k").max("i").withColumnRenamed("max(i)", "top")
    assert left_join(fact, label, "k", null_safe=True).where("top = i").count() == 4


def test_required_columns_make_the_join_inner(fact, dim):
    joined = left_join_complete(fact, dim, "k", ["w"])
    assert rows(joined.select("i"), "i") == [(1,), (2,)]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" in plan and "LeftOuter" not in plan


def test_chain(spark, fact, dim):
    more = spark.createDataFrame([("x", 7)], "w string, q int")
    chained = join_chain(fact, [(dim, "k"), (more, "w")])
    assert rows(chained.select("i", "q"), "i") == [(1, 7), (2, None), (3, None), (4, None)]


@pytest.mark.parametrize("null_safe", [False, True])
def test_skewed_join_equals_plain_join(spark, null_safe):
    data = [("hot" if i % 3 else None if i % 2 else f"k{i % 17}", i) for i in range(600)]
    left = spark.createDataFrame(data, "k string, i int").repartition(4)
    right = spark.createDataFrame(
        [("hot", 1), ("k1", 2), ("k3", 3), ("hot", 4), (None, 5)], "k string, v int"
    )
    assert {r.k: r._parts for r in hot_keys(left, "k", 60).collect()} == {"hot": 7, None: 2}
    plain = left_join(left, right, "k", null_safe=null_safe)
    salted = left_join_skewed(left, right, "k", rows_per_task=60, null_safe=null_safe)
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)


def test_copies_of_one_row_are_spread(spark):
    left = spark.range(0, 4000, 1, 8).selectExpr("'hot' as k", "1 as i")
    right = spark.createDataFrame([("hot", 5)], "k string, v int")
    joined = left_join_skewed(left, right, "k", rows_per_task=500)
    assert joined.agg({"v": "sum"}).first()[0] == 5 * 4000
    salts = left.select(F.pmod(F.xxhash64("k", "i", F.spark_partition_id()), F.lit(8)))
    assert salts.distinct().count() > 1


def test_restrict_keeps_missing_groups_too(fact, dim):
    kept = restrict_to(fact, dim.where("w <> 'y'"), ["k"])
    assert rows(kept.select("i"), "i") == [(1,), (3,)]


def test_append_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    b = spark.createDataFrame([("y",)], "t string")
    assert rows(append_by_name([a, b])) == [(1, "x"), (None, "y")]


def test_parts_of_hot_keys_are_of_the_wanted_size(spark):
    # One key holds 30 % of the rows, another 1.9 %; both are more than a task should get.
    n = F.col("id")
    key = F.when(n % 1000 < 300, "a").when(n % 1000 < 319, "b").otherwise(n.cast("string"))
    left = spark.range(0, 100_000, 1, 8).select(key.alias("k"), n.alias("i"))
    target = 1000
    parts = {r.k: r._parts for r in hot_keys(left, "k", target).collect()}
    assert parts == {"a": 30, "b": 2}
    dealt = F.pmod(F.xxhash64(any_hash(left), F.spark_partition_id()), F.lit(30))
    sizes = left.where("k = 'a'").groupBy(dealt).count().collect()
    assert max(r["count"] for r in sizes) < 2 * target
    right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    joined = left_join_skewed(left, right, "k", rows_per_task=target)
    assert joined.agg(F.sum("v"), F.count("*")).first()[:] == (30_000 + 2 * 1900, 100_000)
