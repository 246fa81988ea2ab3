import os

import pytest
from conftest import rows

from larderline.operators.aggregates import summarise_numeric
from larderline.operators.exact import exact_states, merged_states, totals_of_states
from larderline.operators.lattice import level_means
from larderline.plans.schema import DIARY
from larderline.plans.supply import REPORTS
from larderline.plans.together import rankings_together
from larderline.plans.waves import add_waves, wave_figures

LEVELS = {"fine": ["a", "b"], "a only": ["a"], "all": []}


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(3_000).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('a', id % 5) end as a",
        "cast(id % 4 as int) as b", "cast(2010 + id % 3 as int) as wave",
        "case when id % 11 > 0 then (id - 1500) / 7.0d * pow(10, id % 20 - 9) end as x",
        "case when id % 4 = 1 then null else id * 0.1d end as y",
    )


def test_levels_have_the_bits_of_single_reports(df):
    got = level_means(df, LEVELS, ["x", "y"], "")
    for level, keys in LEVELS.items():
        alone = summarise_numeric(df, keys, "mean", ["x", "y"], ["x", "y"])
        assert rows(got.where(got.level == level).select(*keys, "x", "y")) == rows(alone)
    assert got.count() == 4 * 7 + 7 + 1


def test_one_scan_and_no_rows(df, tmp_path, spark):
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = level_means(stored, LEVELS, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    assert level_means(df.where("false"), {"a": ["a"], "ab": ["a", "b"]}, ["x"]).count() == 0
    with pytest.raises(ValueError):
        level_means(df, {"one": ["a"], "two": ["a"]}, ["x"])


def test_states_merge_in_any_order(df):
    parts = exact_states(df, ["a", "b", "wave"], ["x", "y"])
    through_a = merged_states(merged_states(parts, ["a", "b"], ["x", "y"]), ["b"], ["x", "y"])
    direct = exact_states(df, ["b"], ["x", "y"])
    assert rows(totals_of_states(through_a, ["x", "y"]).select("b", "_sum_x", "_sum_y", "_n_x")) == rows(
        totals_of_states(direct, ["x", "y"]).select("b", "_sum_x", "_sum_y", "_n_x")
    )


def test_a_further_wave_reads_only_itself(spark, df, tmp_path):
    path = str(tmp_path / "states")
    add_waves(df.where("wave < 2012"), path, ["a", "b"], ["x", "y"], "wave")
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if "part" in f}
    add_waves(df.where("wave = 2012"), path, ["a", "b"], ["x", "y"], "wave")
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if "part" in f}
    assert before.items() <= after.items()
    for how in ("mean", "sum"):
        for keys in (["a", "b"], ["a"], [], ["wave"]):
            whole = summarise_numeric(df, keys, how, ["x", "y"], ["x", "y"])
            assert rows(wave_figures(spark, path, keys, ["x", "y"], how)) == rows(whole)
    # Adding a wave again replaces it.
    add_waves(df.where("wave = 2012 and b = 0"), path, ["a", "b"], ["x", "y"], "wave")
    whole = summarise_numeric(df.where("wave < 2012 or b = 0"), ["a"], "sum", ["x"], ["x"])
    assert rows(wave_figures(spark, path, ["a"], ["x"], "sum")) == rows(whole)
    with pytest.raises(ValueError):
        wave_figures(spark, path, ["a"], ["x"], "strict_sum")


def test_rankings_together_equal_single_ones(spark):
    diary = spark.range(4_000).selectExpr(
        "concat('p', id % 40) as seriali", "cast(id % 4 as string) as DayNo",
        "concat('f', id % 29) as FoodNumber", "concat('f', id % 29) as FoodName",
        *[f"concat('{c}', id % 29 % {n}) as {c}" for c, n in zip(DIARY.groups, (5, 5, 11, 11))],
        "case when id % 40 % 3 = 0 then 'Vegan' when id % 40 > 30 then null else 'Neither' end"
        " as Overall_Diet",
        "case when id % 13 > 0 then (id * 31 % 997) / 7.0d end as Proteing", "id % 53 / 3.0d as TotalGrams",
    )
    chosen = {n: r for n, r in REPORTS.items() if r.source == "classified" and r.entity}
    together = rankings_together(diary, chosen)
    for name, report in chosen.items():
        alone = report.table({"classified": diary})
        # Bit by bit in what ranks; the grams beside it are plain sums in the single report.
        columns = [c for c in alone.columns if c in together.columns and c != "TotalGrams"]
        got = together.where(together.report == name)
        assert rows(got.select(*columns)) == rows(alone.select(*columns))
        grams = sorted(r.TotalGrams for r in got.collect())
        assert grams == pytest.approx(sorted(r.TotalGrams for r in alone.collect()))
    with pytest.raises(ValueError):
        rankings_together(diary, {"plain": REPORTS["protein_serving_by_diet"]})
