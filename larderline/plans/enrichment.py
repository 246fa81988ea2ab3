"""Composition and digestibility attached to a diary by food sub-group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderline.functions import pair_products
from larderline.operators.aggregates import summarise_numeric
from larderline.operators.joins import join_chain, left_join, left_join_complete, restrict_to
from larderline.operators.missing import drop_incomplete
from larderline.operators.projection import cast_numbers, discard, drop_matching, keep, rename
from larderline.plans import fixed_values as fixed
from larderline.plans.schema import DIARY, Diary
from larderline.plans.supply import REPORTS
from larderline.session import staged

CONTENT = [content for _, content, _ in fixed.DIGESTIBLE] + fixed.CONTENT_ONLY
REQUIRED_CONTENT = [c for c in CONTENT if c != fixed.SPARSE_CONTENT]
DENSITY = "Protein_g100g"


def food_matches(raw: DataFrame, cols: Diary = DIARY) -> DataFrame:
    """Complete rows of the matching file: sub-group code and its average contents."""
    typed = cast_numbers(raw, fixed.MATCH_NUMBERS)
    complete = drop_incomplete(keep(typed, fixed.MATCH_COLUMNS))
    return keep(complete, [cols.sub, DENSITY, *fixed.MATCH_NUMBERS])


def composition(
    raw: DataFrame, matches: DataFrame, contents: Sequence[str] = CONTENT, cols: Diary = DIARY
) -> DataFrame:
    """Mean content per sub-group, with its protein density."""
    # A column with a bad cell was read as text: contents are named, never found by type.
    typed = cast_numbers(keep(raw, [cols.sub, *contents]), contents)
    means = summarise_numeric(typed, [cols.sub], "mean", contents)
    return left_join(means, keep(matches, [cols.sub, DENSITY]), cols.sub, null_safe=True)


def digestibility(raw: DataFrame, cols: Diary = DIARY) -> DataFrame:
    """Coefficients per sub-group: matching columns and blank headers dropped, complete rows."""
    useful = drop_matching(discard(raw, fixed.DIGEST_MATCHING))
    coefficients = discard(drop_incomplete(useful), fixed.DIGEST_FOOD_LIST)
    return rename(coefficients, {"Food_item_name": "Digest_food"})


def top_groups(classified: DataFrame) -> DataFrame:
    """The 60 sub-groups supplying most protein per person-day."""
    return REPORTS["protein_per_day"].table({"classified": classified})


def with_matches(diary: DataFrame, matches: DataFrame, cols: Diary = DIARY) -> DataFrame:
    """Diary rows whose sub-group has composition averages, with those."""
    required = [DENSITY, *fixed.MATCH_NUMBERS]
    return left_join_complete(diary, matches, cols.sub, required, null_safe=True)


def enrich(
    diary: DataFrame,
    top: DataFrame,
    contents: DataFrame,
    coefficients: DataFrame,
    cols: Diary = DIARY,
) -> DataFrame:
    """Diary rows of the top sub-groups with contents, coefficients and digestible amounts.

    Contents, coefficients and amounts all hang on the sub-group code, so they are joined to
    each other first, for the codes of ``top`` only, and staged in one write as a table of
    codes with complete contents. The diary then meets a single join, whose other side Spark
    knows the size of; one required column is enough to drop the unmatched rows.
    """
    codes = staged(keep(top, [cols.sub]), "top-groups")
    wide = left_join(codes, contents, cols.sub, null_safe=True)
    wide = drop_incomplete(wide, REQUIRED_CONTENT)
    known = restrict_to(coefficients, codes, [cols.sub])
    amounts = digestible_amounts(wide, discard(known, ["Digest_food"]), cols)
    lookup = join_chain(wide, [(known, cols.sub), (amounts, cols.sub)], null_safe=True)
    rows = left_join_complete(
        diary, staged(lookup, "food-facts"), cols.sub, REQUIRED_CONTENT[:1], null_safe=True
    )
    return rows.withColumn("Digest_total_protein", F.col("Protein_Dig") * F.col(cols.protein))


def digestible_amounts(
    contents: DataFrame, coefficients: DataFrame, cols: Diary = DIARY
) -> DataFrame:
    """Digestible part of each content: content times coefficient, per sub-group row."""
    both = left_join(contents, coefficients, cols.sub, null_safe=True)
    pairs = {"Digest_protein_g100g": (DENSITY, "Protein_Dig")}
    pairs |= {f"Digest_{name}": (content, coef) for name, content, coef in fixed.DIGESTIBLE}
    return both.select(cols.sub, *[c.alias(n) for n, c in pair_products(pairs).items()])
