"""Every operator and job as a query over the benchmark tables, with its SQL twin."""

from larderline.queries import basics, files, jobs, joining, ranking, summaries, supply_reports
from larderline.queries.registry import REGISTRY, Query

__all__ = [
    "REGISTRY",
    "Query",
    "basics",
    "files",
    "jobs",
    "joining",
    "ranking",
    "summaries",
    "supply_reports",
]
