"""Sub-group code filled down a food list, for looking foods up in other databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from larderline.operators.missing import carry_forward, keep_present
from larderline.plans import fixed_values as fixed
from larderline.plans.schema import DIARY, Diary


def filled_codes(
    food_list: DataFrame,
    order_by: Sequence[str],
    ids: Sequence[str] = tuple(fixed.LOOKUP_IDS),
    cols: Diary = DIARY,
) -> DataFrame:
    """Rows with an id, each with the last code given at or above it.

    Rows without an id are removed first, so a code that stands on such a row is not carried.
    """
    listed = keep_present(food_list.select(*order_by, cols.sub, *ids), ids[0])
    filled = carry_forward(listed, cols.sub, order_by, leading="drop")
    return filled.select(cols.sub, *ids)
