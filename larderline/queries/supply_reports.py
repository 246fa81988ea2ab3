"""Every published supply ranking, and its chart data, over the stand-in diary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larderline.plans.supply import REPORTS, SupplyReport, reported_servings
from larderline.plans.together import rankings_together
from larderline.queries import standin
from larderline.queries.registry import exact_mean_sql, exact_sum_sql, query, rounded, significant_sql

DIET = "Overall_Diet"
BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


def _measures(report: SupplyReport) -> list[str]:
    shown = [report.show_by] if report.show_by else []
    return list(dict.fromkeys([report.measure, *shown, *report.also]))


def _columns(report: SupplyReport) -> list[str]:
    return [*report.entity, *report.item, *_measures(report)]


def _ranked_sql(report: SupplyReport) -> str:
    """``with ... top as (...)``: the ranking of one report."""
    _, base, source = standin.SOURCES[report.source]
    items = list(dict.fromkeys([*([DIET] if report.by_class else []), *report.item]))
    keys = list(dict.fromkeys([*report.entity, *items]))
    measures = _measures(report)
    ranked = {report.measure, report.show_by}
    sums = ", ".join(
        f"coalesce({exact_sum_sql(m) if m in ranked else f'sum({m})'}, 0) as {m}" for m in measures
    )
    means = ", ".join(
        f"{exact_mean_sql(m) if m in ranked else f'avg({m})'} as {m}" for m in measures
    )
    inner = (
        f"(select {', '.join(keys)}, {sums} from {source} group by all)"
        if report.entity
        else source
    )
    part = f"partition by {DIET}" if report.by_class else ""
    order = ", ".join(items)
    shown = (
        f""", row_number() over ({part} order by {report.show_by} desc nulls last,
                                 {order}) as shown_at"""
        if report.show_by
        else ""
    )
    return f"""with {base},
        means as (select {order}, {means} from {inner} group by {order}),
        numbered as (
          select *, row_number() over ({part} order by {report.measure} desc nulls last,
                                       {order}) as position from means),
        top as (select *{shown} from numbered where position <= {report.n})"""


def _table_sql(report: SupplyReport) -> str:
    names = list(dict.fromkeys([*([DIET] if report.by_class else []), *report.item]))
    columns = [*names, *[f"round({m} + 1e-7, 4) as {m}" for m in _measures(report)]]
    columns += ["position"] if report.by_class else []
    columns += ["shown_at"] if report.show_by else []
    return f"{_ranked_sql(report)} select {', '.join(columns)} from top"


def _chart_sql(report: SupplyReport) -> str:
    measure, category = report.show_by or report.measure, report.category
    by = [*([DIET] if report.by_class else []), category]
    keys = ", ".join(by)
    part = f"partition by {DIET}" if report.by_class else ""
    low, high = report.limits or ("'-infinity'::double", "'infinity'::double")
    same = " and ".join(f"a.{k} is not distinct from b.{k}" for k in by)
    return f"""{_ranked_sql(report)},
        places as (
          select *, row_number() over ({part} order by {significant_sql("order_median")}, {category}) as place
          from (select {keys}, quantile_cont({significant_sql(measure)}, 0.5) as order_median
                from top group by {keys})),
        limited as (select {keys}, {significant_sql(measure)} as v from top
                    where {significant_sql(measure)} between {low} and {high}),
        quarts as (select {keys}, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
                          quantile_cont(v, 0.75) as q3 from limited group by {keys}),
        fenced as (select a.*, q1, median, q3, v between q1 - 1.5 * (q3 - q1)
                                                     and q3 + 1.5 * (q3 - q1) as near
                   from limited a join quarts b on {same}),
        boxes as (select {keys}, count(*) as n, any_value(q1) as q1, any_value(median) as median,
                         any_value(q3) as q3, min(v) filter (where near) as whisker_low,
                         max(v) filter (where near) as whisker_high,
                         count(*) filter (where not near) as n_outliers
                  from fenced group by {keys})
        select {", ".join(f"a.{k}" for k in by)}, round(order_median + 1e-7, 4) as order_median, place,
               coalesce(n, 0) as n, {", ".join(f"round({c} + 1e-7, 4) as {c}" for c in BOX)}, n_outliers
        from places a left join boxes b on {same}"""


def _register(name: str, report: SupplyReport) -> None:
    frame, _, _ = standin.SOURCES[report.source]

    @query(f"supply_{name}", _table_sql(report))
    def ranking(spark: SparkSession, sf: str) -> DataFrame:
        top = report.table({report.source: frame(spark, sf, _columns(report))})
        return rounded(top, _measures(report))

    @query(f"chart_{name}", _chart_sql(report))
    def chart(spark: SparkSession, sf: str) -> DataFrame:
        boxes = report.chart({report.source: frame(spark, sf, _columns(report))})
        return rounded(boxes, ["order_median", *BOX])


for _name, _report in REPORTS.items():
    _register(_name, _report)


@query(
    "supply_reported_vegetarian_servings",
    f"""with {standin.REPORTED_SQL}
        select * from (
          select distinct seriali, {", ".join(standin.GROUPS)}, TotalGrams, Proteing
          from reported where Veg = '2')
        order by Proteing desc, seriali, {", ".join(standin.GROUPS)}, TotalGrams limit 20""",
)
def reported_vegetarian_servings(spark: SparkSession, sf: str) -> DataFrame:
    return reported_servings(standin.reported(spark, sf))


def _of_source(source: str) -> dict[str, SupplyReport]:
    return {n: r for n, r in REPORTS.items() if r.source == source and r.entity}


def _together_sql(reports: dict[str, SupplyReport]) -> str:
    """The single rankings one below the other."""
    measures = list(dict.fromkeys(m for r in reports.values() for m in _measures(r)))
    items = {n: [*([DIET] if r.by_class else []), *r.item] for n, r in reports.items()}
    keys = list(dict.fromkeys(k for of in items.values() for k in of))

    def one(name: str, report: SupplyReport) -> str:
        columns = [k if k in items[name] else f"null::varchar as {k}" for k in keys]
        columns += [
            f"round({m} + 1e-7, 4) as {m}" if m in _measures(report) else f"null::double as {m}"
            for m in measures
        ]
        return f"({_ranked_sql(report)} select '{name}' as report, {', '.join(columns)} from top)"

    return " union all ".join(one(n, r) for n, r in reports.items())


def _register_together(source: str) -> None:
    reports = _of_source(source)
    frame, _, _ = standin.SOURCES[source]
    measures = list(dict.fromkeys(m for r in reports.values() for m in _measures(r)))

    @query(f"supply_together_{source}", _together_sql(reports))
    def together(spark: SparkSession, sf: str) -> DataFrame:
        rows = frame(spark, sf, [c for r in reports.values() for c in _columns(r)])
        return rounded(rankings_together(rows, reports), measures)


for _source in ("classified", "matched", "enriched"):
    _register_together(_source)
