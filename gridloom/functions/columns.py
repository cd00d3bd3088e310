"""Scalar expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How text counts as a number, and the date layouts tried, in order.
NUMBER_PATTERN = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
DAY_FIRST_FORMATS = (
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy",
    "yyyy-M-d H:m:s", "d/M/yyyy H:m:s", "yyyy-M-d'T'H:m:s",
)
# Layouts a CSV reader promotes to dates and timestamps.
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"

FRACTIONAL = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters the name holds."""
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def same(left: DataFrame, right: DataFrame, names) -> Column:
    """Null-safe equality of the named columns of two frames."""
    return all_of(left[quoted(n)].eqNullSafe(right[quoted(n)]) for n in names)


def finite_or_null(value: Column, dtype: T.DataType | None = None) -> Column:
    """NaN and both infinities become null (only fractional types can hold them)."""
    if dtype is not None and not isinstance(dtype, FRACTIONAL):
        return value
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def nan_as_null(value: Column, dtype: T.DataType) -> Column:
    return F.when(~F.isnan(value), value) if isinstance(dtype, FRACTIONAL) else value


def as_double(df: DataFrame, name: str) -> Column:
    """The column as a double with NaN turned into null, ready for statistics."""
    return nan_as_null(col(name).cast("double"), T.DoubleType())


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a fractional column."""
    value = col(name)
    if isinstance(type_of(df, name), FRACTIONAL):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def to_moment(text: Column, formats=DAY_FIRST_FORMATS) -> Column:
    """Text to timestamp, day first, null where no format fits."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def to_flag(text: Column) -> Column:
    """true/false/1/0 in any case to boolean, everything else null."""
    lowered = F.lower(text.cast("string"))
    return F.when(lowered.isin("true", "1"), True).when(lowered.isin("false", "0"), False)


def zero_if_null(total: Column) -> Column:
    return F.coalesce(total, F.lit(0).cast("double"))
