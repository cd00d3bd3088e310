"""CSV and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ISO_DATE_PATTERN, ISO_TIMESTAMP_PATTERN, col
from .records import records

# Quotes inside quoted text are doubled; blanks and the empty text stay as they are.
TEXT_RULES = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": '""',
}
# Tried in order; the first type that every value fits is taken.
CSV_TYPES = (
    ("integer", r"^[+-]?\d{1,18}$", T.LongType()),
    ("number", r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|nan))$", T.DoubleType()),
    ("boolean", r"^(?i:true|false)$", T.BooleanType()),
    ("date", ISO_DATE_PATTERN, T.DateType()),
    ("moment", ISO_TIMESTAMP_PATTERN, T.TimestampNTZType()),
)


# An unquoted empty field is missing, a quoted one is the empty text: so missing needs a mark of its own.
READ_RULES = {**TEXT_RULES, "emptyValue": "", "nullValue": "\0"}


def _raw(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """All columns as text."""
    plain = spark.read.options(**READ_RULES, multiLine=multiline).csv(path)
    return _parsed(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in plain.columns])) if multiline else plain


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of files read in byte ranges, parsed by Spark's own CSV parser."""
    # Columns get other names on the way, as names may repeat or hold any character.
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in READ_RULES.items() if k != "header"}
    options |= {"mode": "FAILFAST", "nanValue": "NaN", "maxCharsPerColumn": "-1", "multiLine": "true"}
    row = F.from_csv("__text", inner.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    parsed = records(spark, path).select(row.alias("__row"))
    return parsed.select(*[F.col(f"__row.c{i}").alias(f.name) for i, f in enumerate(schema.fields)])


def csv_schema(spark: SparkSession, path: str, sample_rows: int | None = None, multiline: bool = True) -> T.StructType:
    """Types that every value fits, from one pass; ``sample_rows`` reads the first rows alone."""
    raw = _raw(spark, path, multiline)
    head = raw if sample_rows is None else raw.limit(sample_rows)
    checks = []
    for i, name in enumerate(raw.columns):
        checks.append(F.count(col(name)).alias(f"n{i}"))
        for label, pattern, _ in CSV_TYPES:
            checks.append(F.count_if(col(name).rlike(pattern)).alias(f"{label}{i}"))
    seen = head.agg(*checks).first()
    fields = []
    for i, name in enumerate(raw.columns):
        fits = [t for label, _, t in CSV_TYPES if seen[f"n{i}"] and seen[f"{label}{i}"] == seen[f"n{i}"]]
        fields.append(T.StructField(name, fits[0] if fits else T.StringType()))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """CSV with a header; a value that breaks its column's type raises instead of vanishing.

    Quoted text may hold line ends; large files are read in byte ranges all the same. Without such text,
    ``multiline=False`` spares the pass that looks for it.
    """
    schema = schema or csv_schema(spark, path, multiline=multiline)
    if multiline:
        return _parsed(spark, path, schema)
    return spark.read.options(**READ_RULES).option("mode", "FAILFAST").option("nanValue", "NaN").schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader by the file extension."""
    lowered = path.rstrip("/").lower()
    if lowered.endswith(".parquet"):
        return read_parquet(spark, path)
    if lowered.endswith(".csv"):
        return read_csv(spark, path)
    raise ValueError("expected a .csv or .parquet path")


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """One part file per partition; nothing is gathered on the driver."""
    df.write.mode(mode).options(**TEXT_RULES).csv(path)


def convert(spark: SparkSession, source: str, target: str, mode: str = "error") -> None:
    """Rewrite a CSV or Parquet table as Parquet."""
    df = read_csv(spark, source) if source.rstrip("/").lower().endswith(".csv") else read_parquet(spark, source)
    write_parquet(df, target, mode)
