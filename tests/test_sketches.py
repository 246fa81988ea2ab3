import pytest
from conftest import rows

from larderline.operators.quantiles import QUARTILES
from larderline.operators.sketches import (
    merged_sketches,
    quantile_sketches,
    rank_error,
    rank_gaps,
    sketch_quantiles,
)
from larderline.session import staged


@pytest.fixture(scope="module")
def many(spark):
    # One category has a third of all rows, most of them with one value.
    return spark.range(90_000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('c', id % 7) end as category",
        "cast(id % 2 as int) as class",
        "case when id % 3 = 0 and id % 5 > 0 then 1.0 when id % 100 = 1 then null "
        "else pmod(id * 7919, 9973) end as v",
    )


def test_unions_of_stored_sketches_keep_the_error(spark, many):
    stored = staged(quantile_sketches(many, ["category", "class"], "v"), "sketches")
    for by in (["category"], ["class"], []):
        got = sketch_quantiles(merged_sketches(stored, by), by)
        gaps = rank_gaps(many, by, "v", got).collect()
        counts = rows(many.where("v is not null").groupBy(*by).count())
        assert rows(got.select(*by, "n")) == counts
        assert max(g[q] for g in gaps for q in QUARTILES) <= 2 * rank_error()


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame(
        [("a", float(i)) for i in range(101)] + [("b", None), ("b", float("nan")), ("c", 4.0)],
        "g string, v double",
    )
    got = sketch_quantiles(quantile_sketches(df, ["g"], "v"), ["g"], {"m": 0.5, "top": 1.0})
    assert rows(got) == [("a", 101, 50.0, 100.0), ("c", 1, 4.0, 4.0)]
    assert quantile_sketches(df.where("false"), ["g"], "v").count() == 0
