import random

import pytest
from conftest import rows

from larderline.operators.aggregates import class_means
from larderline.operators.cohort_index import RULE, assign_by_index, indexed_cohort_means
from larderline.operators.cohorts import assign_cohorts, rules_from

RULES = (
    "cohort string, sex int, age_lo double, age_lo_incl boolean, age_hi double, "
    "age_hi_incl boolean, e_lo double, e_lo_incl boolean, e_hi double, e_hi_incl boolean"
)


def some_rules(n, seed):
    rnd = random.Random(seed)

    def band():
        a, b = (rnd.choice([None, *range(12)]) for _ in "ab")
        return (None if a is None else float(a), rnd.random() < 0.5,
                None if b is None else float(b), rnd.random() < 0.5)

    return [(f"r{i}", rnd.choice([None, 1, 2]), *band(), *band()) for i in range(n)]


def members(rule, sex, age, e):
    _, want, *ends = rule

    def holds(v, lo, lo_incl, hi, hi_incl):
        if v is None:
            return lo is None and hi is None
        above = lo is None or v > lo or (lo_incl and v == lo)
        return above and (hi is None or v < hi or (hi_incl and v == hi))

    return (want is None or want == sex) and holds(age, *ends[:4]) and holds(e, *ends[4:])


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 7), (3, 60)])
def test_equals_brute_force_and_the_expression_form(spark, seed, n):
    rules = some_rules(n, seed)
    rnd = random.Random(seed + 10)
    halves = [None, *(x / 2 for x in range(-2, 26)), float("inf")]
    data = [
        (i, rnd.choice([None, 1, 2, 3]), rnd.choice(halves), rnd.choice(halves)) for i in range(300)
    ]
    df = spark.createDataFrame(data, "id int, s int, a double, e double")
    table = spark.createDataFrame(rules, RULES)
    got = rows(assign_by_index(df, table, "s", "a", "e"))
    want = [(*d, r[0]) for d in data for r in rules if members(r, *d[1:])]
    assert got == sorted(want, key=repr)
    assert got == rows(assign_cohorts(df, rules_from(table.collect()), "s", "a", "e"))


def test_no_rules_no_rows_and_no_ends(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, 5.0)], "id int, s int, a double")
    none = spark.createDataFrame([], RULES)
    assert assign_by_index(df, none, "s", "a").count() == 0
    everyone = spark.createDataFrame([("all", None, *[None] * 8)], RULES)
    assert rows(assign_by_index(df, everyone, "s", "a").select("id", "cohort")) == [
        (1, "all"), (2, "all")]
    assert assign_by_index(df.where("false"), everyone, "s", "a").count() == 0


def test_ten_thousand_rules_keep_the_plan_and_the_pairs_small(spark):
    many = spark.range(10_000).selectExpr(
        "concat('r', id) as cohort", "cast(null as int) as sex", "id / 10 as age_lo",
        "id % 2 = 0 as age_lo_incl", "id / 10 + 0.25 as age_hi", "id % 3 = 0 as age_hi_incl",
        *[f"cast(null as {'boolean' if c.endswith('incl') else 'double'}) as {c}" for c in RULE[6:]],
    )
    df = spark.range(2_000).selectExpr("id", "1 as s", "id / 2 as a", "id as x")

    def plan(rules):
        found = indexed_cohort_means(df, rules, "s", "a", None, ["x"])
        return len(found._jdf.queryExecution().executedPlan().toString())

    assert plan(many) <= plan(many.where("cohort < 'r2'")) + 500
    got = assign_by_index(df, many, "s", "a").groupBy("cohort").count().count()
    want = 0
    for i in range(10_000):
        lo, hi = i / 10, i / 10 + 0.25
        first = int(lo * 2) - 1
        want += any(
            (a > lo or (i % 2 == 0 and a == lo)) and (a < hi or (i % 3 == 0 and a == hi))
            for a in (k / 2 for k in range(max(first, 0), min(first + 4, 2_000)))
        )
    assert got == want


@pytest.mark.parametrize("energy,classes", [("e", []), ("e", ["k"]), (None, ["k"])])
def test_means_equal_those_of_the_pairs(spark, energy, classes):
    rnd = random.Random(7)
    halves = [None, *(x / 2 for x in range(-2, 26)), float("inf"), float("nan"), -0.0]
    odd = [None, 1e300, float("inf"), float("nan"), -0.25, 1e-9]
    data = [
        (rnd.choice([None, 1, 2, 3]), rnd.choice(halves), rnd.choice(halves), rnd.choice([None, "x", "y"]),
         rnd.randrange(-1000, 1000) / 7, rnd.choice(odd), i)
        for i in range(200)
    ]
    df = spark.createDataFrame(data, "s int, a double, e double, k string, m double, o double, n bigint")
    rules = some_rules(40, 5)
    rules += [("r1", *rules[0][1:]), (None, None, *[None] * 8)]
    table = spark.createDataFrame(rules, RULES)
    got = indexed_cohort_means(df, table, "s", "a", energy, ["m", "o", "n"], classes)
    pairs = assign_by_index(df, table, "s", "a", energy)
    want = class_means(pairs, ["cohort", *classes], ["m", "o", "n"])
    assert got.columns == want.columns
    got, want = rows(got), rows(want)
    assert len(got) == len(want) > 10
    by = 1 + len(classes)
    for g, w in zip(got, want):
        assert g[:by] == w[:by]
        for a, b in zip(g[by:], w[by:]):
            assert a == b if None in (a, b) else a == pytest.approx(b, rel=1e-12, abs=1e-12, nan_ok=True)


def test_means_of_many_wide_rules_make_no_pairs(spark):
    # 3000 rows and 3000 rules that all hold for half of the rows: 4.5 million pairs.
    df = spark.range(3000).selectExpr("1 as s", "id as a", "id as e", "cast(id as double) as x")
    table = spark.range(3000).selectExpr(
        "concat('r', id) as cohort", "1 as sex", "id / 2 as age_lo", "true as age_lo_incl",
        "id / 2 + 1500 as age_hi", "false as age_hi_incl",
        *[f"cast(null as {'boolean' if c.endswith('incl') else 'double'}) as {c}" for c in RULE[6:]],
    )
    means = indexed_cohort_means(df, table, "s", "a", "e", ["x"])
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "_r_e_lo" not in plan and "_points" not in plan
    found = {int(r.cohort[1:]): r.mean_x for r in means.collect()}
    assert len(found) == 3000
    for i, mean in found.items():
        first, last = -(-i // 2), -(-(i + 3000) // 2) - 1
        assert mean == (first + last) / 2
