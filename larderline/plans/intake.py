"""Day totals per person and what cohorts take in on average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderline.operators.aggregates import class_means, mean_and_sd, named_sums
from larderline.operators.cohorts import CohortRule, assign_cohorts, cohort_means
from larderline.operators.joins import left_join
from larderline.operators.lattice import level_means
from larderline.operators.missing import blank_sentinels
from larderline.plans import fixed_values as fixed
from larderline.plans.schema import DIARY, Diary

# New name -> column summed: energy, protein, digestible protein, then both forms of each
# amino acid that has a digestibility coefficient.
DAY_TOTALS = {
    "sum_energy": DIARY.energy,
    "sum_Proteing": DIARY.protein,
    "sum_dig_protein": "Digest_total_protein",
}
for _name, _content, _ in fixed.DIGESTIBLE:
    DAY_TOTALS[f"sum_{_name}g"] = _content
    DAY_TOTALS[f"sum_dig_{_name}"] = f"Digest_{_name}"


# Columns that say how much 100 g of a food hold.
PER_100_GRAMS = [c for n, content, _ in fixed.DIGESTIBLE for c in (content, f"Digest_{n}")]


def day_totals(
    enriched: DataFrame,
    cols: Diary = DIARY,
    totals: dict[str, str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Totals per person and day, with the class; built once, used by every cohort.

    Contents per 100 g are added up as they are, food by food, as the published figures are.
    With ``weight`` (the grams column) they are scaled to the amount eaten first.
    """
    if weight is not None:
        scale = F.col(weight) / 100
        enriched = enriched.withColumns({c: F.col(c) * scale for c in PER_100_GRAMS})
    return named_sums(enriched, [*cols.person_day, cols.diet], totals or DAY_TOTALS)


def raw_day_totals(diary: DataFrame, cols: Diary = DIARY) -> DataFrame:
    """Protein and energy per person and day over all foods; one missing value voids a day."""
    sums = {"sum_Proteing": cols.protein, "sum_Energykcal": cols.energy}
    return named_sums(diary, cols.person_day, sums, strict=True)


def intake_report(
    totals: DataFrame,
    rules: Sequence[CohortRule] = tuple(fixed.INTAKE_COHORTS),
    measures: Sequence[str] = tuple(m for m in DAY_TOTALS if m != "sum_energy"),
    classes: Sequence[str] | None = None,
    energy: str = "sum_energy",
    cols: Diary = DIARY,
) -> DataFrame:
    """Mean of every total per cohort and diet class, in one aggregate."""
    classes = [cols.diet] if classes is None else classes
    return cohort_means(totals, rules, cols.sex, cols.age, energy, measures, classes)


def intake_levels(
    totals: DataFrame,
    rules: Sequence[CohortRule] = tuple(fixed.INTAKE_COHORTS),
    measures: Sequence[str] = tuple(m for m in DAY_TOTALS if m != "sum_energy"),
    energy: str = "sum_energy",
    cols: Diary = DIARY,
) -> DataFrame:
    """Means per cohort and diet class (``level`` "class") and per cohort ("cohort") together.

    The day totals are read once; a cohort's mean is over its person-days, not over its classes.
    """
    members = assign_cohorts(totals, rules, cols.sex, cols.age, energy)
    levels = {"class": ["cohort", cols.diet], "cohort": ["cohort"]}
    return level_means(members, levels, measures)


def energy_spread(
    totals: DataFrame,
    rules: Sequence[CohortRule] = tuple(fixed.PROTEIN_CHECKS),
    energy: str = "sum_energy",
    cols: Diary = DIARY,
) -> DataFrame:
    """Mean and standard deviation of daily energy per cohort."""
    return mean_and_sd(assign_cohorts(totals, rules, cols.sex, cols.age, energy), energy, ["cohort"])


def class_report(
    totals: DataFrame, sex: object, measures: Sequence[str], cols: Diary = DIARY
) -> DataFrame:
    """Means per diet class over all person-days of one sex."""
    return class_means(totals.where(totals[cols.sex] == sex), [cols.diet], measures)


def demographics(diets: DataFrame, attributes: DataFrame, cols: Diary = DIARY) -> DataFrame:
    """One row per classified person with age, sex, weight, region and income."""
    return left_join(diets, attributes, cols.person, null_safe=True)


def weight_report(
    people: DataFrame,
    rules: Sequence[CohortRule] = tuple(fixed.WEIGHT_BANDS),
    not_measured: Sequence[float] = (),
    cols: Diary = DIARY,
) -> DataFrame:
    """Mean body weight per age and sex band; codes in ``not_measured`` count as missing."""
    if not_measured:
        people = blank_sentinels(people, cols.weight, not_measured)
    return cohort_means(people, rules, cols.sex, cols.age, None, [cols.weight])
