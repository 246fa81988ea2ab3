"""Many supply rankings of one source out of the same sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderline.operators.exact import exact_states, merged_states, totals_of_states
from larderline.operators.lattice import level_means
from larderline.operators.ranking import reorder_top, top_n, top_n_per_class
from larderline.plans.schema import DIARY
from larderline.plans.supply import SupplyReport
from larderline.session import staged


def _items(report: SupplyReport, diet: str) -> list[str]:
    return list(dict.fromkeys([*([diet] if report.by_class else []), *report.item]))


def _measures(report: SupplyReport) -> list[str]:
    return list(dict.fromkeys(m for m in (report.measure, report.show_by, *report.also) if m))


def _people(report: SupplyReport, diet: str) -> tuple[str, ...]:
    """The keys of the first level: people with what each had of an item in total."""
    return tuple(sorted({*report.entity, *_items(report, diet)}))


def rankings_together(
    df: DataFrame, reports: Mapping[str, SupplyReport], diet: str = DIARY.diet
) -> DataFrame:
    """All rankings of one source: ``report``, the item keys of any of them, and their measures.

    The rows are summed once by the finest keys of people and foods and written as exact states.
    Reports whose first level has the same keys share it, a coarser first level is added up from
    the states, and all item groupings over one first level are one aggregate with grouping
    sets. Keys and measures that a report does not have are missing in its rows. Figures that
    rank are those of the report alone, bit by bit; the others, which a single report adds up
    plainly, are exact here too.

    Only the reports that average over people are taken; one that ranks plain means of rows
    (no ``entity``) is refused. ``df`` is read once for each first level that no other contains.
    """
    if any(not r.entity for r in reports.values()):
        raise ValueError("a ranking of plain row means has no first level to share")
    measures = list(dict.fromkeys(m for r in reports.values() for m in _measures(r)))
    keys = list(dict.fromkeys(k for r in reports.values() for k in _items(r, diet)))
    first = dict.fromkeys(_people(r, diet) for r in reports.values())
    finest = [k for k in first if not any(set(k) < set(other) for other in first)]
    stored: dict[tuple[str, ...], DataFrame] = {
        k: staged(exact_states(df, list(k), measures), "states") for k in finest
    }

    tops = []
    for level in first:
        over = next(k for k in finest if set(level) <= set(k))
        states = stored[over]
        if level != over:
            states = merged_states(states, list(level), measures)
        sums = [F.coalesce(F.col(f"`_sum_{m}`"), F.lit(0.0)).alias(m) for m in measures]
        people = totals_of_states(states, measures).select(*level, *sums)
        mine = {n: r for n, r in reports.items() if _people(r, diet) == level}
        # Reports with the same item keys share a level.
        levels: dict[str, Sequence[str]] = {}
        level_of = {}
        for name, report in mine.items():
            items = _items(report, diet)
            same = next((n for n, k in levels.items() if set(k) == set(items)), None)
            level_of[name] = same or name
            if same is None:
                levels[name] = items
        # One row an item: as many as there are foods and groups, however many people.
        means = staged(level_means(people, levels, measures, ""), "item-means")
        for name, report in mine.items():
            here = means.where(F.col("level") == level_of[name])
            tops.append(_top(here, name, report, diet, keys, measures))
    return reduce(DataFrame.unionByName, tops)


def _top(
    means: DataFrame,
    name: str,
    report: SupplyReport,
    diet: str,
    keys: Sequence[str],
    measures: Sequence[str],
) -> DataFrame:
    items, own = _items(report, diet), _measures(report)
    classes = [diet] if report.by_class else []
    means = means.select(*items, *own)
    if classes:
        top = top_n_per_class(means, classes, report.measure, report.n, items)
    else:
        top = top_n(means, report.measure, report.n, items)
    if report.show_by:
        top = reorder_top(top, report.show_by, items, classes)
    missing = F.lit(None)
    return top.select(
        F.lit(name).alias("report"),
        *[F.col(k) if k in items else missing.cast("string").alias(k) for k in keys],
        *[F.col(m) if m in own else missing.cast("double").alias(m) for m in measures],
    )
