"""Sums and means that do not depend on the order of the rows."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from larderline.operators.aggregates import summarise_numeric
from larderline.operators.exact import exact_totals


def sums(df, *keys):
    got = exact_totals(df, keys, ["x"])
    return got.select(*keys, F.col("_sum_x").alias("s"), (F.col("_sum_x") / F.nullif("_n_x", F.lit(0))).alias("m"))


def numbers(rng, n):
    return [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-8, 12) for _ in range(n)]


def test_same_bits_under_any_partitioning(spark):
    rng = random.Random(1)
    rows = [(i % 3, x) for i, x in enumerate(numbers(rng, 6000))]
    found = set()
    for parts in (1, 3, 8):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g int, x double").repartition(parts)
        got = sums(df, "g")
        found.add(tuple((r.g, r.s.hex(), r.m.hex()) for r in got.orderBy("g").collect()))
    assert len(found) == 1
    for g, s, m in next(iter(found)):
        xs = [x for k, x in rows if k == g]
        want = float(sum(map(Fraction, xs)))
        assert abs(float.fromhex(s) - want) <= 2 * math.ulp(want)
        assert float.fromhex(m) == float.fromhex(s) / len(xs)


@pytest.mark.parametrize(
    "values",
    [
        [1e16, 1.0, -1e16], [1e21, -1e21, 1e-9], [0.1] * 10, [-0.1, 0.1], [-5.0, -2.25], [0.0],
        [2.0**74, 2.0**-80], [1e-20, -3e-20], [None, 2.5, None],
    ],
)
def test_sums_round_once(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = sums(df).first().s
    want = float(sum(Fraction(v) for v in values if v is not None))
    assert got == pytest.approx(want, rel=4e-16, abs=2.0**-79)


def test_nothing_and_numbers_out_of_range(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", 1e30), ("b", 1.0), ("c", float("inf")), ("d", float("nan")), ("d", 1.0)],
        "g string, x double",
    )
    got = {r.g: (r.s, r.m) for r in sums(df, "g").collect()}
    assert got["a"] == (None, None)
    assert got["b"] == (1e30, 5e29) and got["c"][0] == float("inf") and got["d"] == (1.0, 1.0)
    assert sums(df.where("false")).first().s is None


def test_equal_sums_of_different_rows_are_equal(spark):
    rows = [("a", 0.5), ("a", 0.25), ("b", 0.75), ("c", -0.25), ("c", 1.0), ("d", 0.75), ("d", 0.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert len({r.s for r in sums(df, "g").collect()}) == 1


def test_summaries_of_all_types(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.5, None), ("a", 2, None, None), ("b", 5, 1.5, 2.5)], "g string, n int, x double, y double"
    )
    means = {r.g: tuple(r)[1:] for r in summarise_numeric(df, ["g"], "mean", exact=["n", "x", "y"]).collect()}
    assert means == {"a": (1.5, 0.5, None), "b": (5.0, 1.5, 2.5)}
    both = {r.g: tuple(r)[1:] for r in summarise_numeric(df, ["g"], "sum", exact=["x", "y"]).collect()}
    assert both == {"a": (3, 0.5, 0.0), "b": (5, 1.5, 2.5)}


def test_means_that_differ_in_the_twelfth_digit_rank_by_the_measure(spark):
    from larderline.plans.supply import supply_ranking

    rows = [("a", 1, 1.00000000001), ("b", 1, 1.00000000002), ("c", 1, 0.5), ("c", 1, 0.50000000002), ("d", 1, 1.0)]
    df = spark.createDataFrame(rows, "item string, who int, x double")
    top = supply_ranking(df, ["who"], ["item"], "x", 3)
    assert [r.item for r in top.collect()] == ["b", "c", "a"]
