"""Reading, typing and de-duplicating a diary; diet classes of its people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from larderline.functions import plain_id, to_int
from larderline.operators.aggregates import group_count, strongest_label, summarise_numeric
from larderline.operators.joins import has_missing, left_join, write_back
from larderline.operators.labels import FlagRules, add_flags, add_flags_by_text, add_label
from larderline.operators.projection import cast_numbers, cast_positions
from larderline.plans import fixed_values as fixed
from larderline.plans.schema import DIARY, Diary
from larderline.sources import read_aligned

DIET_RULES: FlagRules = {
    "Consumed_Meat": {DIARY.main_desc: fixed.MEAT_GROUPS, DIARY.food: fixed.MEAT_FOODS},
    "Consumed_Fish": {DIARY.main_desc: fixed.FISH_GROUPS, DIARY.food: fixed.FISH_FOODS},
    "Consumed_DairyEgg": {
        DIARY.main_desc: fixed.DAIRY_EGG_GROUPS,
        DIARY.food: fixed.DAIRY_EGG_FOODS,
    },
}


def read_diary(spark: SparkSession, waves: Sequence[str | Sequence[str]]) -> DataFrame:
    """Tab-delimited Latin-1 diary files, one entry per wave, every column text."""
    return read_aligned(spark, waves)


def type_diary(
    df: DataFrame,
    cols: Diary = DIARY,
    positions: tuple[int, int] | None = fixed.MEASURE_POSITIONS,
    measures: Sequence[str] = (),
) -> DataFrame:
    """Numbers for the weight and nutrient columns, whole numbers for age and sex; the person
    id as plain text, by the rule that :func:`person_attributes` has too."""
    if positions is not None:
        df = cast_positions(df, *positions)
    df = cast_numbers(df, [cols.grams, *[m for m in measures if m != cols.grams]])
    return df.withColumns(
        {
            cols.person: plain_id(cols.person),
            cols.age: to_int(cols.age),
            cols.sex: to_int(cols.sex),
        }
    )


def deduplicate(df: DataFrame, cols: Diary = DIARY, how: str = "mean") -> DataFrame:
    """One row per food, day and person. ``mean`` averages repeat servings, ``sum`` adds them."""
    return summarise_numeric(df, cols.row_keys, how)


def ingest(
    spark: SparkSession,
    waves: Sequence[str | Sequence[str]],
    cols: Diary = DIARY,
    how: str = "mean",
    **typing,
) -> DataFrame:
    """Read, type and de-duplicate in one go."""
    return deduplicate(type_diary(read_diary(spark, waves), cols, **typing), cols, how)


def person_attributes(df: DataFrame, columns: Sequence[str], cols: Diary = DIARY) -> DataFrame:
    """The wanted columns of the person file, the id as plain text like in the diary."""
    return df.select(
        plain_id(cols.person).alias(cols.person), *[c for c in columns if c != cols.person]
    )


def with_person(diary: DataFrame, attributes: DataFrame, cols: Diary = DIARY) -> DataFrame:
    """Diary rows with the attributes of their person.

    Both sides know sex and age; the diary keeps the plain names and the person file's get
    ``_person``, so later steps never have to guess which one they read.
    """
    # Without missing ids on one side a plain join is the same, and leaves the rows by person.
    null_safe = has_missing(attributes, cols.person)
    return left_join(
        diary, attributes, cols.person, null_safe=null_safe, suffixes=("", "_person")
    )


def diet_flags(
    df: DataFrame, rules: FlagRules = DIET_RULES, by_text: bool = True, **match_options
) -> DataFrame:
    """Meat, fish and dairy/egg flags per diary row.

    Food names recur all over a diary, so by default each distinct name is tested once.
    """
    flag = add_flags_by_text if by_text else add_flags
    return flag(df, rules, **match_options)


def row_diet(
    flagged: DataFrame, cases: Sequence[tuple[str, str]] = fixed.DIET_CASES, out: str = "Diet"
) -> DataFrame:
    return add_label(flagged, out, cases, fixed.DIETS[-1])


def person_diets(
    labelled: DataFrame,
    attributes: DataFrame | None = None,
    cols: Diary = DIARY,
    label: str = "Diet",
    order: Sequence[str] = fixed.DIETS,
) -> DataFrame:
    """What each person really eats: the strongest row label.

    ``attributes`` (person, reported diet, ...) are joined to the one row per person, after
    the diary has been aggregated.
    """
    per_person = strongest_label(labelled, [cols.person], label, order, cols.diet)
    if attributes is None:
        return per_person
    return left_join(per_person, attributes, cols.person, null_safe=True)


def with_diet(diary: DataFrame, diets: DataFrame, cols: Diary = DIARY) -> DataFrame:
    """Diary rows with the diet class of their person."""
    return write_back(diary, diets.select(cols.person, cols.diet), cols.person, null_safe=True)


def classify(
    rows: DataFrame,
    diary: DataFrame | None = None,
    cols: Diary = DIARY,
    rules: FlagRules = DIET_RULES,
    by_text: bool = True,
) -> DataFrame:
    """``diary`` with each person's diet class on every row.

    Both steps read ``rows``: hand in a staged de-duplicated diary, or its plan runs twice. The
    class depends on which foods a person has, not on how often, so the diary as read gives the
    same classes; ``diary`` is then the table to write them on.
    """
    diets = person_diets(row_diet(diet_flags(rows, rules, by_text)), cols=cols)
    return with_diet(rows if diary is None else diary, diets, cols)


def reported_and_actual(diets: DataFrame, cols: Diary = DIARY) -> DataFrame:
    """How many people of each reported diet eat which diet."""
    return group_count(diets, [cols.reported, cols.diet])
