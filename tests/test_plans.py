"""What the physical plans must and must not contain."""

import contextlib
import io
import os

import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from larderline.operators.aggregates import summarise_numeric
from larderline.operators.joins import left_join, restrict_to
from larderline.operators.ranking import top_n, top_n_per_class
from larderline.queries import REGISTRY
from larderline.queries.registry import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


@contextlib.contextmanager
def conf(spark, settings):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_no_python_in_any_plan(spark):
    for name in ("intake_by_cohort", "topn_per_class", "box_stats", "locf", "keyword_flags"):
        text = plan(REGISTRY[name].run(spark, SF))
        assert "Python" not in text and "ArrowEval" not in text, name


def test_no_cross_joins(spark):
    for name in ("cohort_means", "intake_by_cohort", "box_stats", "category_order", "locf"):
        text = plan(REGISTRY[name].run(spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_top_n_is_merged_from_partial_top_ns(spark):
    lines = table(spark, SF, "lineitem")
    assert "TakeOrderedAndProject" in plan(top_n(lines, "l_quantity", 5, ["l_orderkey"]))
    per_class = top_n_per_class(lines, ["l_returnflag"], "l_quantity", 5, ["l_orderkey"])
    assert plan(per_class).count("WindowGroupLimit") >= 2


def test_scan_reads_only_what_is_used(spark):
    means = summarise_numeric(table(spark, SF, "lineitem"), ["l_returnflag"])
    text = plan(means.where("l_returnflag = 'R'").select("l_returnflag", "l_tax"))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in text
    schema = next(x for x in text.splitlines() if "ReadSchema" in x)
    assert "l_tax" in schema and "l_quantity" not in schema


def test_person_filter_goes_below_the_aggregate(spark):
    days = summarise_numeric(table(spark, SF, "orders"), ["o_custkey"], "sum", ["o_totalprice"])
    text = plan(days.where("o_custkey = 7 and o_totalprice > 100"))
    assert "EqualTo(o_custkey,7)" in text and "GreaterThan(o_totalprice" not in text


def test_null_safe_join_stays_an_equi_join(spark):
    orders, people = table(spark, SF, "orders"), table(spark, SF, "customer")
    keys = {"o_custkey": "c_custkey"}
    assert "BroadcastHashJoin" in plan(left_join(orders, people, keys, null_safe=True))
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert "SortMergeJoin" in plan(left_join(orders, people, keys, null_safe=True))
        # Nothing is hinted: without sizes to go by, no side is broadcast.
        top = top_n(people, "c_acctbal", 20, ["c_custkey"]).select(
            F.col("c_custkey").alias("o_custkey")
        )
        assert "SortMergeJoin" in plan(restrict_to(orders, top, ["o_custkey"]))


BIG_JOINS = [
    "label_rejoin",
    "left_join_skewed",
    "topn_per_class",
    "box_stats",
    "person_diets",
    "classified_diary",
    "enriched_diary",
    "intake_by_cohort",
]


@pytest.mark.parametrize("name", BIG_JOINS)
def test_same_result_when_nothing_is_small(spark, name):
    """As on tables too large to broadcast: shuffled joins, hot partitions split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    q = REGISTRY[name]
    with conf(spark, settings):
        assert differences(q.run(spark, SF), duck(SF).execute(q.sql)) == []


def test_hot_person_is_split_at_run_time(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    with conf(spark, settings):
        n = F.col("id")
        left = spark.range(0, 60_000, 1, 8).select(
            F.when(n % 3 == 0, 7).otherwise(n).alias("k"), F.uuid().alias("pad")
        )
        right = spark.range(60_000).select(n.alias("k"), (n * 2).alias("v"))
        joined = left_join(left, right, "k")
        totals = joined.groupBy("k").agg(F.sum("v").alias("s"))
        assert totals.where("k = 7").first().s == 14 * 20_001
        totals.collect()
        executed = totals._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in executed
