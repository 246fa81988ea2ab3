import random

import numpy as np
import pytest
from conftest import rows

from larderline.operators.quantiles import (
    box_stats,
    category_order,
    chunked_counts,
    exact_quantiles,
    outliers,
    quantiles,
    value_counts,
)
from larderline.session import staged


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    out = []
    for _ in range(3000):
        # One group holds two thirds of the rows, one a single row, one has no name.
        g = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None])
        v = rng.choice([round(rng.gauss(50, 20), 1), 7.0, None, float("nan")])
        out.append((g, v))
    return out + [("single", 3.0), ("empty", None)]


def known(data, g):
    return np.array([v for k, v in data if k == g and v is not None and v == v])


@pytest.mark.parametrize("chunks", [1, 2, 16, 64])
def test_exact_quantiles_match_numpy(spark, data, chunks):
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    probs = {"p0": 0.0, "p1": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_quantiles(df, ["g"], "v", probs, chunks=chunks).collect()
    assert {r.g for r in got} == {"hot", "a", "b", None, "single"}
    for r in got:
        want = np.quantile(known(data, r.g), list(probs.values()))
        assert [r[q] for q in probs] == pytest.approx(list(want))


def test_quantiles_over_everything(spark, data):
    df = spark.createDataFrame(data, "g string, v double")
    everything = np.array([v for _, v in data if v is not None and v == v])
    got = exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert got.m == pytest.approx(np.median(everything))


@pytest.mark.parametrize("method", ["exact", "grouped"])
def test_box_statistics(spark, data, method):
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    for r in box_stats(df, ["g"], "v", method=method).collect():
        x = known(data, r.g)
        q1, m, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        near = x[(x >= lo) & (x <= hi)]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, m, q3))
        assert (r.n, r.n_outliers) == (len(x), len(x) - len(near))
        assert (r.whisker_low, r.whisker_high) == (near.min(), near.max())


def test_limits_apply_before_the_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 100]], "g string, v double")
    assert box_stats(df, ["g"], "v", method="grouped").first().median == 2.5
    assert box_stats(df, ["g"], "v", (0, 45), "grouped").first().median == 2.0


def test_outlier_rows(spark):
    df = spark.createDataFrame(
        [(i, "a", float(v)) for i, v in enumerate([1, 2, 2, 3, 3, 3, 4, 50])],
        "i int, g string, v double",
    )
    assert rows(outliers(df, ["g"], "v")) == [(7, "a", 50.0)]


def test_categories_by_median(spark, data):
    df = spark.createDataFrame(data, "g string, v double")
    ordered = category_order(df.where("g is not null"), "g", "v").orderBy("position").collect()
    medians = {g: np.median(known(data, g)) for g in ["hot", "a", "b", "single"]}
    assert [r.g for r in ordered] == sorted(medians, key=lambda g: (medians[g], g))
    assert [r.position for r in ordered] == [1, 2, 3, 4]


def test_approximate_is_near(spark):
    df = spark.range(10_001).selectExpr("'a' as g", "cast(id as double) as v")
    got = quantiles(df, ["g"], "v", {"m": 0.5}, "approximate").first()
    assert abs(got.m - 5000) <= 2
    with pytest.raises(ValueError):
        quantiles(df, ["g"], "v", {"m": 0.5}, "other")


def test_a_value_of_a_third_of_the_rows_fills_no_chunk(spark):
    rng = random.Random(9)
    values = [7.0 if rng.random() < 0.34 else rng.gauss(7, 3) for _ in range(30_000)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    counts = staged(value_counts(df, ["g"], "v"), "test-counts")
    sizes = [r["count"] for r in chunked_counts(counts, 12).groupBy("_chunk").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * sum(sizes) / 12
    got = exact_quantiles(df, ["g"], "v", {"q": 0.4, "m": 0.5}, chunks=12).first()
    assert [got.q, got.m] == pytest.approx(list(np.quantile(values, [0.4, 0.5])))


@pytest.mark.parametrize("work", ["quantiles", "box"])
def test_the_source_is_read_once(spark, work):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.range(1000).selectExpr("id % 3 as g", "cast(id % 50 as double) as v")
    source = source.mapInArrow(counted, source.schema)
    if work == "quantiles":
        exact_quantiles(source, ["g"], "v", {"m": 0.5}, chunks=4).collect()
    else:
        box_stats(source, ["g"], "v", chunks=4).collect()
    assert seen.value == 1000


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert exact_quantiles(df, ["g"], "v", {"m": 0.5}).count() == 0
    assert box_stats(df, ["g"], "v").count() == 0
