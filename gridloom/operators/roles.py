"""Column roles and default choices: rules over names, types and a few counts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import is_numeric, is_temporal
from ..functions.text import METRIC_SYNONYMS

# Metric names tried before falling back to the first numeric column.
PREFERRED_METRICS = ("sales", "revenue", "temperature", "value", "amount", "profit", "qty", "count", "y")
# Columns checked first for group fairness.
SENSITIVE_COLUMNS = ("gender", "sex", "age", "race", "ethnicity", "income", "region")


@dataclass
class ChartRoles:
    dates: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    years: list[str] = field(default_factory=list)


def chart_roles(df: DataFrame) -> ChartRoles:
    """Roles for charts; a column may have several."""
    roles = ChartRoles()
    for f in df.schema.fields:
        lowered = f.name.lower()
        if is_temporal(f.dataType) or "date" in lowered or "time" in lowered:
            roles.dates.append(f.name)
        if is_numeric(f.dataType):
            roles.numeric.append(f.name)
        if isinstance(f.dataType, (T.StringType, T.BooleanType)):
            roles.categories.append(f.name)
        if re.fullmatch(r"F?\d{4}", f.name):
            roles.years.append(f.name)
    return roles


@dataclass
class ModelRoles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)


def model_roles(df: DataFrame) -> ModelRoles:
    """Roles for statistics and models; each column has one."""
    roles = ModelRoles()
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            roles.numeric.append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            roles.boolean.append(f.name)
        elif is_temporal(f.dataType):
            roles.datetime.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            roles.categorical.append(f.name)
    return roles


def pick_metric(df: DataFrame, metric: str | None = None, preferred=()) -> str | None:
    """A named column, else a synonym of the asked metric, else a usual name, else the first number."""
    numeric = chart_roles(df).numeric
    named = [c for c in preferred if c in numeric]
    if named or not numeric:
        return named[0] if named else None
    words = [metric, *METRIC_SYNONYMS.get(metric, ())] if metric else []
    for wanted in (words, PREFERRED_METRICS):
        hits = [c for c in numeric if any(w in c.lower() for w in wanted)]
        if hits:
            return hits[0]
    return numeric[0]


def pick_category(df: DataFrame, preferred=()) -> str | None:
    named = [c for c in preferred if c in df.columns]
    return next(iter(named or chart_roles(df).categories), None)


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def present_columns(df: DataFrame, wanted) -> tuple[list[str], list[str]]:
    """Split a column list into those the frame has and those it lost."""
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def fairness_column(df: DataFrame) -> str | None:
    """The first non-numeric column with a sensitive name, else the first non-numeric one."""
    groups = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    return next((c for c in groups if c.lower() in SENSITIVE_COLUMNS), next(iter(groups), None))
