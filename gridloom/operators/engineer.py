"""New columns from existing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import INTEGRAL, as_double, col, to_moment, type_of
from .attach import BROADCAST_BYTES, attach
from .order import quantile_map

MAX_ONE_HOT = 20
INF, NAN = float("inf"), float("nan")


def _wide(df: DataFrame, c: str) -> Column:
    """Integers as long, so that squares and products of small types do not overflow."""
    return col(c).cast("long") if isinstance(type_of(df, c), INTEGRAL) else col(c)


def add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def log1p(df: DataFrame, c: str) -> DataFrame:
    """``log_<c>``: ln(1 + x); -inf at -1 and NaN below."""
    x = col(c).cast("double")
    return add(df, **{f"log_{c}": F.when(x > -1, F.log1p(x)).when(x == -1, -INF).when(x < -1, NAN)})


def square_root(df: DataFrame, c: str) -> DataFrame:
    return add(df, **{f"sqrt_{c}": F.sqrt(col(c).cast("double"))})


def square(df: DataFrame, c: str) -> DataFrame:
    return add(df, **{f"{c}_sq": _wide(df, c) * _wide(df, c)})


def _divide(a: Column, b: Column) -> Column:
    """Floating-point division: x/0 is infinite with the sign of x, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, INF).when(a < 0, -INF).when(a.isNotNull(), NAN)
    return F.when(b != 0, a / b).when(b == 0, by_zero)


def z_score(df: DataFrame, c: str) -> DataFrame:
    """``<c>_z``: distance from the mean in sample deviations; the two statistics come from one pass."""
    found = df.agg(F.avg(col(c)).alias("m"), F.stddev_samp(col(c)).alias("s")).first()
    centre, spread = F.lit(found["m"]).cast("double"), F.lit(found["s"]).cast("double")
    return add(df, **{f"{c}_z": _divide(col(c) - centre, spread)})


def min_max(df: DataFrame, c: str) -> DataFrame:
    """``<c>_01``: position between the smallest and largest value."""
    found = df.agg(F.min(col(c)).cast("double").alias("lo"), F.max(col(c)).cast("double").alias("hi")).first()
    lo, hi = F.lit(found["lo"]).cast("double"), F.lit(found["hi"]).cast("double")
    return add(df, **{f"{c}_01": _divide(col(c) - lo, hi - lo)})


def ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    return add(df, **{f"{a}_per_{b}": _divide(col(a), col(b))})


def product(df: DataFrame, a: str, b: str) -> DataFrame:
    return add(df, **{f"{a}_x_{b}": _wide(df, a) * _wide(df, b)})


def difference(df: DataFrame, a: str, b: str) -> DataFrame:
    return add(df, **{f"{a}_minus_{b}": _wide(df, a) - _wide(df, b)})


def quantile_bins(df: DataFrame, c: str, bins: int = 4) -> DataFrame:
    """``<c>_bin`` (interval label) and ``<c>_bin_index``: right-closed bins at exact quantiles."""
    cuts = quantile_map(df, [c], [i / bins for i in range(1, bins)])[c] or []
    value = as_double(df, c)
    edges = ["-inf", *[f"{e:.10g}" for e in cuts], "inf"]
    labels = [f"({lo}, {hi}]" for lo, hi in zip(edges, edges[1:])]
    index = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        index = F.when(value <= cuts[i], F.lit(i)).otherwise(index)
    index = F.when(value.isNotNull(), index)
    return add(df, **{f"{c}_bin_index": index, f"{c}_bin": F.get(F.array(*[F.lit(x) for x in labels]), index)})


def one_hot(df: DataFrame, c: str, max_levels: int = MAX_ONE_HOT) -> DataFrame:
    """``<c>_<level>`` as 0/1 per level, null included; refused when there are too many levels."""
    found = df.select(col(c)).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{c} has more than {max_levels} levels; too many for indicator columns")
    levels = sorted((r[0] for r in found), key=lambda v: (v is None, v))
    return add(df, **{
        f"{c}_{'null' if v is None else v}": col(c).eqNullSafe(F.lit(v)).cast("int") for v in levels
    })


def frequency(df: DataFrame, c: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``<c>_count``: rows that share the value; no window, so a hot value does not fill one task."""
    counts = df.groupBy(col(c)).agg(F.count(F.lit(1)).alias(f"{c}_count"))
    return attach(df, counts, [c], rows=f"{c}_count", limit=limit)


def date_parts(df: DataFrame, c: str) -> DataFrame:
    """``<c>_year``, ``<c>_month`` and ``<c>_weekday`` (Monday is 1); text is parsed first."""
    d = to_moment(col(c), ("yyyy-M-d", "yyyy/M/d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s")) \
        if isinstance(type_of(df, c), T.StringType) else col(c)
    return add(df, **{f"{c}_year": F.year(d), f"{c}_month": F.month(d), f"{c}_weekday": F.weekday(d) + 1})

