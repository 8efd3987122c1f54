"""All registered queries."""

from __future__ import annotations

from millrace.plans import analysis, charts, files, preparation, series
from millrace.plans.tables import Query

QUERIES: dict[str, Query] = {
    **preparation.QUERIES,
    **analysis.QUERIES,
    **charts.QUERIES,
    **series.QUERIES,
    **files.QUERIES,
}
