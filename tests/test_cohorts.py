import pytest
from conftest import rows

from larderline.operators.cohorts import (
    Band,
    CohortRule,
    assign_cohorts,
    cohort_means,
    keep_window,
    rules_from,
)
from larderline.plans import fixed_values as fixed
from larderline.plans.intake import intake_report, weight_report


@pytest.fixture(scope="module")
def days(spark):
    data = [
        (sex, age, float(kcal))
        for sex in (1, 2)
        for age in (3, 4, 10, 11, 18, 19, 64, 65)
        for kcal in (250, 251, 499, 500, 501, 799, 800, 801, 2499, 2500, 3499, 3500, 3999, 4000)
    ]
    return spark.createDataFrame(data, "Sex int, AgeR int, sum_energy double")


def in_words(sex, age, e):
    """The cohort table again, written out by hand."""
    out = []
    if sex == 1 and 18 < age < 65 and e >= 800:
        out.append("adult male")
    if sex == 2 and 18 < age < 65 and e >= 500:
        out.append("adult female")
    if sex == 2 and age > 64 and 500 < e < 3500:
        out.append("older female")
    if sex == 1 and age > 64 and 800 < e < 4000:
        out.append("older male")
    if age < 4:
        out.append("infants")
    if 4 <= age <= 10 and 250 < e < 2500:
        out.append("children")
    if sex == 1 and 10 < age < 19 and 500 <= e <= 3500:
        out.append("adolescent male")
    if sex == 2 and 11 <= age <= 18 and 500 <= e <= 3500:
        out.append("adolescent female")
    return out


def test_open_and_closed_ends(days):
    members = assign_cohorts(days, fixed.INTAKE_COHORTS, "Sex", "AgeR", "sum_energy")
    want = [(*d, c) for d in rows(days) for c in in_words(*d)]
    assert rows(members) == sorted(want, key=repr)


def test_one_pass_equals_separate_means(days):
    together = dict(rows(intake_report(days, measures=["sum_energy"], classes=[])))
    for rule in fixed.INTAKE_COHORTS:
        apart = days.where(rule.holds("Sex", "AgeR", "sum_energy")).agg({"sum_energy": "avg"})
        assert together[rule.name] == pytest.approx(apart.first()[0])


def test_overlapping_cohorts_each_get_their_rows(spark):
    df = spark.createDataFrame([(1, 30, 10.0), (1, 50, 20.0)], "s int, a int, x double")
    rules = [CohortRule("all"), CohortRule("old", age=Band(low=40)), CohortRule("none", sex=9)]
    got = cohort_means(df, rules, "s", "a", None, ["x"])
    assert rows(got) == [("all", 15.0), ("old", 20.0)]


def test_missing_age_is_in_no_age_band(spark):
    df = spark.createDataFrame([(1, None, 900.0)], "Sex int, AgeR int, sum_energy double")
    assert assign_cohorts(df, fixed.INTAKE_COHORTS, "Sex", "AgeR", "sum_energy").count() == 0


def test_rules_come_from_a_table(spark):
    table = spark.createDataFrame(
        [("c", 1, 18, False, 65, False, 800.0, True, None, False)],
        "cohort string, sex int, age_lo int, age_lo_incl boolean, age_hi int, "
        "age_hi_incl boolean, e_lo double, e_lo_incl boolean, e_hi double, e_hi_incl boolean",
    )
    (rule,) = rules_from(table.collect())
    assert rule == CohortRule("c", 1, Band(18, 65, False, False), Band(800.0, None, True, False))


def test_weights_with_and_without_codes(spark):
    people = spark.createDataFrame(
        [(1, 30, 80.0), (1, 40, -1.0), (2, 3, 12.0), (2, 70, None)],
        "Sex int, AgeR int, Weight double",
    )
    assert dict(rows(weight_report(people)))["adult male"] == 39.5
    measured = dict(rows(weight_report(people, not_measured=[-1])))
    assert measured == {"adult male": 80.0, "infants": 12.0, "older female": None}


def test_window_on_totals(days):
    floor = keep_window(days, "sum_energy", Band(800)).agg({"sum_energy": "min"}).first()[0]
    assert floor == 800.0
    window = keep_window(days, "sum_energy", Band(800, 4000, False, False))
    assert sorted({r.sum_energy for r in window.collect()})[::5] == [801.0, 3999.0]
