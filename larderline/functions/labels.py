"""First-true-wins labels and the rank form used to aggregate them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_label(cases: Sequence[tuple[Column, object]], default: object) -> Column:
    """Value of the first case whose condition holds (NULL does not hold), else ``default``."""
    if not cases:
        return F.lit(default)
    (condition, value), *rest = cases
    out = F.when(condition, F.lit(value))
    for condition, value in rest:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def rank_of_label(c: str | Column, order: Sequence[str]) -> Column:
    """Position of a label in ``order`` (0 = strongest); unknown labels rank last."""
    c = F.col(c) if isinstance(c, str) else c
    return first_label([(c == label, i) for i, label in enumerate(order)], len(order))


def label_of_rank(c: str | Column, order: Sequence[str]) -> Column:
    """Inverse of :func:`rank_of_label`; a rank outside ``order`` gives the last label."""
    c = F.col(c) if isinstance(c, str) else c
    return first_label([(c == i, label) for i, label in enumerate(order[:-1])], order[-1])
