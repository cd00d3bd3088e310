"""The automatic dashboard and the choice of chart data for a question.

Nothing is cached: each part reads one or two columns of the same filtered scan, which costs less
than keeping full-width rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.aggregate import compare
from ..operators.distribution import histogram, scatter
from ..operators.filters import apply_filters, cross_filter
from ..operators.profile import kpi_cards
from ..operators.roles import chart_roles, pick_category, pick_metric
from ..operators.trend import trend, year_trend
from ..functions.columns import is_temporal, type_of
from pyspark.sql import types as T

# The chart data tried for each question kind, in order.
ORDER_BY_KIND = {
    "trend": ("trend", "category", "scatter", "histogram"),
    "compare": ("named_scatter", "category", "trend", "scatter", "histogram"),
    "rank": ("category", "trend", "scatter", "histogram"),
    "distribution": ("histogram", "trend", "category", "scatter"),
}


def trend_part(df: DataFrame, metric: str | None, agg: str | None = None, grain: str | None = None):
    """Trend over the first date column, else over wide year columns, else nothing."""
    roles = chart_roles(df)
    usable = [c for c in roles.dates if is_temporal(type_of(df, c)) or isinstance(type_of(df, c), T.StringType)]
    if usable and metric and metric != usable[0]:
        return trend(df, usable[0], metric, agg, grain)
    if not usable and roles.years:
        return year_trend(df, roles.years, agg)
    return None


def build_part(part: str, df: DataFrame, key, metric=None, agg=None, grain=None, numeric=(), categorical=()):
    """One kind of chart data, or None when the columns for it are missing."""
    measure = pick_metric(df, metric, numeric)
    category = pick_category(df, categorical)
    if part == "trend":
        return trend_part(df, measure, agg, grain)
    if part == "category":
        return compare(df, category, measure, agg or "mean") if category and measure else None
    if part == "histogram":
        return histogram(df, measure) if measure else None
    named = [c for c in numeric if c in df.columns]
    axes = named if len(named) >= 2 else [] if part == "named_scatter" else chart_roles(df).numeric
    return scatter(df, axes[0], axes[1], key) if len(axes) >= 2 else None


def chart_data(df: DataFrame, kind: str, key, metric=None, agg=None, grain=None, numeric=(), categorical=()):
    """The first kind of chart data that fits the question and has rows: ``(part, DataFrame)``."""
    for part in ORDER_BY_KIND.get(kind, ORDER_BY_KIND["trend"]):
        data = build_part(part, df, key, metric, agg, grain, numeric, categorical)
        if data is not None and not data.isEmpty():
            return part, data
    return None, None


def dashboard(df: DataFrame, filters: dict, key, selected=(), metric: str | None = None) -> dict[str, DataFrame]:
    """KPIs, category comparison, trend, histogram, scatter and drill-down of one filtered table.

    Clicked categories restrict every part but the category comparison itself.
    """
    filtered = apply_filters(df, filters)
    category = pick_category(filtered)
    crossed = cross_filter(filtered, category, selected) if category and selected else filtered
    preferred = [metric] if metric else []
    parts = {"kpis": kpi_cards(crossed)}
    sources = (("category", filtered), ("trend", crossed), ("histogram", crossed), ("scatter", crossed))
    for part, source in sources:
        data = build_part(part, source, key, numeric=preferred)
        if data is not None:
            parts[part] = data
    deeper = [c for c in chart_roles(df).categories if c != category]
    if len(selected) == 1 and deeper:
        sub = build_part("category", crossed, key, numeric=preferred, categorical=deeper[:1])
        if sub is not None:
            parts["drill_down"] = sub
    return parts
