"""Cohorts given as rule rows: sex, age band and day-total window, each end open or closed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderline.operators.aggregates import class_means


@dataclass(frozen=True)
class Band:
    """An interval; a missing end is unbounded, and each end may be closed or open."""

    low: float | None = None
    high: float | None = None
    low_closed: bool = True
    high_closed: bool = True

    def holds(self, c: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (c >= self.low if self.low_closed else c > self.low)
        if self.high is not None:
            out = out & (c <= self.high if self.high_closed else c < self.high)
        return out


@dataclass(frozen=True)
class CohortRule:
    """One cohort. ``sex`` is any group code (None = everyone)."""

    name: str
    sex: object = None
    age: Band = Band()
    energy: Band = Band()

    def holds(self, sex: str, age: str, energy: str | None) -> Column:
        out = self.age.holds(F.col(age))
        if self.sex is not None:
            out = out & (F.col(sex) == F.lit(self.sex))
        if energy is not None:
            out = out & self.energy.holds(F.col(energy))
        return out


def rules_from(rows: Iterable) -> list[CohortRule]:
    """Rules from rows of a rule table (cohort, sex, age_lo, age_lo_incl, age_hi, ...)."""
    return [
        CohortRule(
            r["cohort"],
            r["sex"],
            Band(r["age_lo"], r["age_hi"], bool(r["age_lo_incl"]), bool(r["age_hi_incl"])),
            Band(r["e_lo"], r["e_hi"], bool(r["e_lo_incl"]), bool(r["e_hi_incl"])),
        )
        for r in rows
    ]


def assign_cohorts(
    df: DataFrame,
    rules: Sequence[CohortRule],
    sex: str,
    age: str,
    energy: str | None = None,
    out: str = "cohort",
) -> DataFrame:
    """One row per row and cohort it belongs to; rows in no cohort are dropped.

    The rules become one array expression that is exploded, so there is no join, and
    overlapping cohorts each get their copy.
    """
    members = F.array(*[F.when(r.holds(sex, age, energy), F.lit(r.name)) for r in rules])
    return df.withColumn(out, F.explode(F.array_compact(members)))


def cohort_means(
    df: DataFrame,
    rules: Sequence[CohortRule],
    sex: str,
    age: str,
    energy: str | None,
    measures: Sequence[str],
    classes: Sequence[str] = (),
) -> DataFrame:
    """Mean of every measure per cohort and class, all cohorts in one aggregate."""
    members = assign_cohorts(df, rules, sex, age, energy)
    return class_means(members, ["cohort", *classes], measures)


def keep_window(df: DataFrame, column: str, window: Band) -> DataFrame:
    """Plausibility window on a total: a floor only, or both ends."""
    return df.where(window.holds(F.col(column)))
