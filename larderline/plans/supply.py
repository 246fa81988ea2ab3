"""Which food groups supply most of a nutrient, overall and per diet class."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larderline.functions import significant
from larderline.operators.aggregates import summarise_numeric, two_level
from larderline.operators.quantiles import box_stats, quantiles
from larderline.operators.ranking import reorder_top, top_n, top_n_per_class
from larderline.operators.spread import same_keys
from larderline.plans.schema import DIARY

# Boxes interpolate between values. That may move the last two of 16 digits, which must not turn
# one of several equal values into an outlier. Rankings compare all digits.
BOX_DIGITS = 14


def supply_ranking(
    df: DataFrame,
    entity_keys: Sequence[str],
    item_keys: Sequence[str],
    measure: str,
    n: int,
    by_class: str | None = None,
    show_by: str | None = None,
    also: Sequence[str] = (),
    inner: str = "sum",
    outer: str = "mean",
) -> DataFrame:
    """Top n items by a measure, as a mean over entities of what each had in total.

    Sums and means of the measures that rank are exact: equal groups tie in every run, and a
    difference in the last digit of a mean ranks.

    * no ``entity_keys``: one plain mean per item.
    * ``by_class``: top n within every class, all classes in one pass.
    * ``show_by``: number the chosen rows by another measure.
    * ``also``: further measures to report.
    """
    ranked = [measure, *([show_by] if show_by else [])]
    measures = list(dict.fromkeys([*ranked, *also]))
    classes = [by_class] if by_class else []
    items = list(dict.fromkeys([*classes, *item_keys]))
    if entity_keys:
        means = two_level(df, entity_keys, items, measures, inner, outer, ranked)
    else:
        means = summarise_numeric(df, items, outer, measures, ranked)
    if classes:
        top = top_n_per_class(means, classes, measure, n, items)
    else:
        top = top_n(means, measure, n, items)
    return reorder_top(top, show_by, items, classes) if show_by else top


def chart_data(
    top: DataFrame,
    category: str,
    measure: str,
    by_class: str | None = None,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Box-plot data of a top-N report, categories in order of their median.

    The report holds n rows per class, so plain grouped medians will do. The order is taken
    before ``limits`` apply, the box after; a category left without rows keeps its place.
    """
    by = [c for c in (by_class, category) if c]
    top = top.withColumn(measure, significant(measure, BOX_DIGITS))
    medians = quantiles(top, by, measure, {"order_median": 0.5}, "grouped")
    in_order = [significant("order_median", BOX_DIGITS).asc_nulls_last(), F.col(category)]
    place = Window.partitionBy(*by[:-1]).orderBy(*in_order)
    places = medians.withColumn("place", F.row_number().over(place).cast("bigint"))
    boxes = box_stats(top, by, measure, limits, "grouped").withColumnsRenamed(
        {k: k + "_b" for k in by}
    )
    return (
        places.join(boxes, same_keys(by, "_b"), "left")
        .drop(*[k + "_b" for k in by])
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


@dataclass(frozen=True)
class SupplyReport:
    """One published ranking: where it reads, how it groups, what it ranks and shows."""

    source: str
    entity: tuple[str, ...]
    item: tuple[str, ...]
    measure: str
    n: int
    by_class: bool = False
    show_by: str | None = None
    limits: tuple[float, float] | None = None
    category: str = DIARY.sub_desc
    also: tuple[str, ...] = field(default=(DIARY.grams,))

    def table(self, frames: dict[str, DataFrame], diet: str = DIARY.diet) -> DataFrame:
        return supply_ranking(
            frames[self.source],
            self.entity,
            self.item,
            self.measure,
            self.n,
            diet if self.by_class else None,
            self.show_by,
            self.also,
        )

    def chart(self, frames: dict[str, DataFrame], diet: str = DIARY.diet) -> DataFrame:
        shown = self.show_by or self.measure
        by_class = diet if self.by_class else None
        return chart_data(self.table(frames, diet), self.category, shown, by_class, self.limits)


# --- Fixed values: the published rankings ---------------------------------------------------
# Sources: "deduplicated" diary, "reported" = with the person's own answers, "classified" =
# with the diet class, "matched" = with composition averages, "enriched" = with amino acids
# and digestible amounts. A ranking per class covers all four diet classes at once.

_GROUPS = tuple(DIARY.groups)
_PERSON = (DIARY.person, *_GROUPS)
_PERSON_FOOD = (DIARY.person, DIARY.food, *_GROUPS, DIARY.diet)
_PROTEIN, _LYSINE, _DIGESTIBLE_LYSINE = DIARY.protein, "LYSg", "Digest_LYS"

REPORTS: dict[str, SupplyReport] = {
    "protein_population_first_look": SupplyReport("deduplicated", _PERSON, _GROUPS, _PROTEIN, 60),
    "protein_by_reported_diet": SupplyReport(
        "reported",
        (*_PERSON, DIARY.reported),
        (*_GROUPS, DIARY.reported),
        _PROTEIN,
        20,
    ),
    "protein_population": SupplyReport(
        "classified", _PERSON_FOOD, _GROUPS, _PROTEIN, 60, limits=(0, 45)
    ),
    "protein_foods_by_diet": SupplyReport(
        "classified", _PERSON_FOOD, (DIARY.food, *_GROUPS), _PROTEIN, 20, by_class=True
    ),
    "protein_foods_by_diet_named": SupplyReport(
        "classified",
        _PERSON_FOOD,
        (*_GROUPS, DIARY.food),
        _PROTEIN,
        20,
        by_class=True,
        category=DIARY.food,
    ),
    "protein_by_diet": SupplyReport(
        "classified", _PERSON_FOOD, _GROUPS, _PROTEIN, 20, by_class=True, limits=(0, 45)
    ),
    "protein_serving_by_diet": SupplyReport("classified", (), _GROUPS, _PROTEIN, 20, by_class=True),
    "protein_density_by_diet": SupplyReport(
        "enriched",
        _PERSON_FOOD,
        _GROUPS,
        "Protein_g100g",
        20,
        by_class=True,
        limits=(0, 45),
        also=(DIARY.grams, _PROTEIN),
    ),
    "protein_per_day": SupplyReport(
        "classified", (DIARY.person, DIARY.day, *_GROUPS), _GROUPS, _PROTEIN, 60
    ),
    "lysine_foods_of_top_protein_by_diet": SupplyReport(
        "matched",
        (*_PERSON, DIARY.food),
        (*_GROUPS, DIARY.food),
        _PROTEIN,
        60,
        by_class=True,
        show_by="Avg_Lys",
    ),
    "average_lysine_population": SupplyReport(
        "matched", _PERSON_FOOD, _GROUPS, "Avg_Lys", 60, limits=(0, 5.5)
    ),
    "average_lysine_by_diet": SupplyReport(
        "matched", _PERSON_FOOD, _GROUPS, "Avg_Lys", 20, by_class=True, limits=(0, 6.5)
    ),
    "lysine_of_top_protein_by_diet": SupplyReport(
        "matched", _PERSON, _GROUPS, _PROTEIN, 60, by_class=True, show_by="Avg_Lys"
    ),
    "tryptophan_of_top_protein_by_diet": SupplyReport(
        "matched", _PERSON, _GROUPS, _PROTEIN, 60, by_class=True, show_by="Avg_Tryp"
    ),
    "enriched_protein_population": SupplyReport(
        "enriched", _PERSON_FOOD, _GROUPS, _PROTEIN, 60, limits=(0, 45)
    ),
    "lysine_population": SupplyReport(
        "enriched", _PERSON_FOOD, _GROUPS, _LYSINE, 60, limits=(0, 6.5)
    ),
    "digestible_lysine_population": SupplyReport(
        "enriched", _PERSON_FOOD, _GROUPS, _DIGESTIBLE_LYSINE, 60, limits=(0, 6.5)
    ),
    "enriched_protein_by_diet": SupplyReport(
        "enriched", _PERSON_FOOD, _GROUPS, _PROTEIN, 20, by_class=True, limits=(0, 45)
    ),
    "lysine_by_diet": SupplyReport(
        "enriched", _PERSON_FOOD, _GROUPS, _LYSINE, 20, by_class=True, limits=(0, 6.5)
    ),
    "digestible_lysine_by_diet": SupplyReport(
        "enriched", _PERSON_FOOD, _GROUPS, _DIGESTIBLE_LYSINE, 20, by_class=True, limits=(0, 6.5)
    ),
}

# The reported-vegetarian look at single servings ranks distinct rows, not group means.
REPORTED_VEGETARIAN = "2"


def reported_servings(reported: DataFrame, n: int = 20) -> DataFrame:
    """Largest protein servings of people who report being vegetarian, as distinct rows."""
    keys = [DIARY.person, *_GROUPS, DIARY.grams, _PROTEIN]
    rows = reported.where(F.col(DIARY.reported) == REPORTED_VEGETARIAN).select(*keys).distinct()
    return top_n(rows, _PROTEIN, n, keys)
