"""What a question about a table needs to know, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import numeric_columns, string_columns
from ..operators.filters import preview
from ..operators.profile import describe_categorical, describe_numeric, kpi_cards, top_values


def question_profile(df: DataFrame, key, rows: int = 5) -> dict[str, DataFrame]:
    """Size, typed columns, statistics, most frequent values and first rows."""
    types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    parts = {
        "size": kpi_cards(df, totals=[]),
        "columns": df.sparkSession.createDataFrame(types, "column string, type string"),
        "first_rows": preview(df, rows, key),
    }
    if numeric_columns(df):
        parts["numbers"] = describe_numeric(df)
    if string_columns(df):
        parts["texts"] = describe_categorical(df)
        parts["top_values"] = top_values(df)
    return parts
