"""Powders, drinks and bars among the nutrition products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderline.functions import per_hundred
from larderline.operators.aggregates import class_means
from larderline.operators.labels import FlagRules, add_flags, add_label
from larderline.plans import fixed_values as fixed
from larderline.plans.schema import DIARY, Diary

PRODUCT_RULES: FlagRules = {
    "nutrition_powders": {DIARY.food: fixed.POWDER_WORDS},
    "nutrition_drinks": {DIARY.food: fixed.DRINK_WORDS},
    "nutrition_bars": {DIARY.food: fixed.BAR_WORDS},
}


def nutrition_products(
    diary: DataFrame,
    code: str = fixed.NUTRITION_PRODUCTS,
    rules: FlagRules = PRODUCT_RULES,
    nutrients: Sequence[str] = tuple(fixed.PRODUCT_NUTRIENTS),
    cols: Diary = DIARY,
) -> DataFrame:
    """Servings of one sub-group with protein per 100 g and their product form."""
    columns = [
        cols.person,
        cols.day,
        cols.diet,
        cols.food,
        cols.food_no,
        cols.sub,
        cols.sub_desc,
        cols.grams,
        *nutrients,
    ]
    servings = diary.where(F.col(cols.sub) == code).select(*columns)
    dense = servings.withColumn("Proteing100g", per_hundred(cols.protein, cols.grams))
    flagged = add_flags(dense, rules)
    return add_label(flagged, "form", fixed.PRODUCT_CASES, fixed.PRODUCT_DEFAULT)


def product_labels(products: DataFrame, cols: Diary = DIARY) -> DataFrame:
    """Form of each serving, by person, day and food."""
    return products.select(cols.person, cols.day, cols.food, cols.food_no, "form")


def product_means(
    products: DataFrame, measures: Sequence[str] = (DIARY.protein,), cols: Diary = DIARY
) -> DataFrame:
    """Mean per diet class of the given measures."""
    return class_means(products, [cols.diet], measures)
