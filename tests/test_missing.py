import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from larderline.operators.missing import (
    blank_sentinels,
    carry_forward,
    carry_forward_within,
    drop_incomplete,
    keep_present,
    null_counts,
)
from larderline.operators.spread import global_row_number, in_chunks
from larderline.plans.lookups import filled_codes


def test_drop_incomplete_treats_nan_as_missing(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a"), (2, float("nan"), "a"), (3, None, "a"), (4, 1.0, None)],
        "i int, x double, t string",
    )
    assert [r.i for r in drop_incomplete(df).collect()] == [1]
    assert [r.i for r in drop_incomplete(df, ["x"]).orderBy("i").collect()] == [1, 4]
    assert rows(null_counts(df, ["x", "t"])) == [(2, 1)]


def test_sentinels(spark):
    df = spark.createDataFrame([(-1.0,), (70.0,), (None,)], "w double")
    assert rows(blank_sentinels(df, "w", [-1])) == rows(
        spark.createDataFrame([(None,), (70.0,), (None,)], "w double")
    )


def sparse_rows(seed, n=400, hot_share=0.4):
    rng = random.Random(seed)
    return [
        (
            "hot" if rng.random() < hot_share else rng.choice(["a", "b", None]),
            k,
            rng.randrange(100) if rng.random() < 0.2 else None,
        )
        for k in range(n)
    ]


@pytest.mark.parametrize("chunks", [1, 2, 7, 64])
def test_both_fills_agree(spark, chunks):
    df = spark.createDataFrame(sparse_rows(chunks), "p string, k int, v int").repartition(6)
    chunked = carry_forward(df, "v", ["k"], ["p"], chunks=chunks)
    plain = carry_forward_within(df, "v", ["k"], ["p"])
    assert rows(chunked, "k") == rows(plain, "k")


def test_fill_matches_a_loop_without_partitions(spark):
    data = sparse_rows(5)
    df = spark.createDataFrame(data, "p string, k int, v int").select("k", "v").repartition(5)
    last, want = None, []
    for _, k, v in data:
        last = v if v is not None else last
        want.append((k, last))
    assert rows(carry_forward(df, "v", ["k"], chunks=9), "k") == want
    kept = rows(carry_forward(df, "v", ["k"], leading="drop", chunks=9), "k")
    assert kept == [w for w in want if w[1] is not None]


@pytest.mark.parametrize("ddl", ["string", "date", "timestamp", "double"])
def test_fill_by_other_order_types(spark, ddl):
    base = spark.createDataFrame([(p, k, v) for p, k, v in sparse_rows(3)], "p string, k int, v int")
    key = {
        "string": F.format_string("%05d", "k"),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")),
        "timestamp": F.timestamp_seconds(F.col("k") * 1000),
        "double": F.col("k") / 3,
    }[ddl]
    df = base.withColumn("key", key)
    chunked = carry_forward(df, "v", ["key"], ["p"], chunks=8)
    assert rows(chunked, "k") == rows(carry_forward_within(df, "v", ["key"], ["p"]), "k")


def test_fill_happens_after_the_filter(spark):
    food_list = spark.createDataFrame(
        [
            (1, None, "10", "f"),
            (2, "A", None, "f"),  # the code stands on a row without id and is not carried
            (3, None, "11", "f"),
            (4, "B", "12", "f"),
            (5, None, "13", "f"),
            (6, None, None, "f"),
            (7, None, "14", "f"),
        ],
        ["row", "SubFoodGroupCode", "NDB no", "FDC Id"],
    )
    got = filled_codes(food_list, ["row"])
    assert rows(got) == [("B", "12", "f"), ("B", "13", "f"), ("B", "14", "f")]
    assert keep_present(food_list, "NDB no").count() == 5


def chunk_sizes(df, order, chunks):
    rows_ = in_chunks(df, [F.col(c) for c in order], chunks, "test")
    return [r["count"] for r in rows_.groupBy("_chunk").count().collect()]


def test_chunks_are_even_and_ordered(spark):
    df = spark.range(10_000).select((F.col("id") * F.col("id")).alias("x"))
    chunked = in_chunks(df, [F.col("x")], 10, "test")
    got = chunked.groupBy("_chunk").agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    ).orderBy("_chunk").collect()
    assert len(got) == 10 and max(r.n for r in got) < 1500
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("constant", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_no_chunk_exceeds_twice_its_share(spark, constant):
    # Three order columns of which the first ones, or all, have one value.
    df = spark.range(40_000).select(
        *[(F.lit(7) if c in constant else F.col("id")).alias(c) for c in "abc"],
        F.col("id").alias("i"),
    )
    assert max(chunk_sizes(df, ["a", "b", "c"], 20)) < 2 * 40_000 / 20


def test_large_whole_numbers_keep_their_order(spark):
    df = spark.range(5000).select(
        (F.lit(2**60) + F.col("id") % 100).alias("big"), (F.col("id") % 7).alias("t"), "id"
    ).repartition(6)
    numbered = global_row_number(df, "big", ["t", "id"], chunks=20)
    want = sorted(((r.big, r.t, r.id) for r in df.collect()))
    assert [tuple(r)[:3] for r in numbered.orderBy("position").collect()] == want
    assert sorted(r.position for r in numbered.collect()) == list(range(1, 5001))


@pytest.mark.parametrize("descending", [False, True])
def test_global_row_number(spark, descending):
    rng = random.Random(1)
    data = [(i, rng.choice([None, rng.randrange(50)])) for i in range(500)]
    df = spark.createDataFrame(data, "i int, x int").repartition(5)
    got = {
        r.i: r.position
        for r in global_row_number(df, "x", ["i"], descending=descending, chunks=6).collect()
    }
    sign = -1 if descending else 1
    nulls_last = descending
    order = sorted(data, key=lambda r: ((r[1] is None) == nulls_last, sign * (r[1] or 0), r[0]))
    assert [got[i] for i, _ in order] == list(range(1, 501))


def test_text_with_a_common_prefix_is_cut_evenly(spark):
    df = spark.range(5000).select(F.format_string("Customer#%09d", "id").alias("k"))
    sizes = chunk_sizes(df, ["k"], 10)
    assert len(sizes) == 10 and max(sizes) < 1000
    numbered = global_row_number(df, "k", [], chunks=7)
    assert numbered.where("cast(substring(k, 10) as int) + 1 <> position").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_ties_do_not_fill_a_chunk(spark, descending):
    # Half of the rows share one value and a fifth has none.
    rng = random.Random(8)
    data = [
        (i, None if i % 5 == 0 else 50 if i % 2 else rng.randrange(100)) for i in range(4000)
    ]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "i int, x int").repartition(4)
    assert max(chunk_sizes(df, ["x", "i"], 20)) < 600
    numbered = global_row_number(df, "x", ["i"], descending=descending, chunks=20)
    sign = -1 if descending else 1
    want = sorted(data, key=lambda r: ((r[1] is None) == descending, sign * (r[1] or 0), r[0]))
    assert [r.i for r in numbered.orderBy("position").collect()] == [i for i, _ in want]


def test_fill_with_a_constant_leading_key(spark):
    data = [("file", k, v) for _, k, v in sparse_rows(9)]
    df = spark.createDataFrame(data, "f string, k int, v int").repartition(3)
    plain = carry_forward_within(df, "v", ["k"], ["f"])
    assert rows(carry_forward(df, "v", ["f", "k"], chunks=8), "k") == rows(plain, "k")
