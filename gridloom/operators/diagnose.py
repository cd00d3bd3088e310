"""Data-quality reports: missing values, duplicates, outliers, correlation, association."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, is_missing, numeric_columns
from .order import quantile_map
from .profile import cardinality_map, per_column

PATTERN_ROWS = 200
SUMS_AT_ONCE = 60
CORRELATION_THRESHOLD = 0.8
ASSOCIATION_THRESHOLD = 0.3


def missing_report(df: DataFrame, columns=None) -> DataFrame:
    """Missing count and percent per column, worst first."""
    columns = df.columns if columns is None else list(columns)
    counts = per_column(df, columns, {
        "missing_count": lambda c: F.count_if(is_missing(df, c)),
        "n": lambda c: F.count(F.lit(1)),
    })
    return counts.select(
        "column", "missing_count", F.try_divide(F.col("missing_count") * 100.0, F.col("n")).alias("missing_pct")
    ).orderBy(F.desc("missing_pct"), "column")


def missing_pattern(df: DataFrame, key, rows: int = PATTERN_ROWS) -> DataFrame:
    """0/1 per cell of the first rows in key order."""
    head = df.orderBy(*[col(k) for k in key]).limit(rows)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), is_missing(df, c).cast("int").alias("missing")) for c in df.columns
    ])
    return head.select(*[col(k).alias(f"key_{k}") for k in key], F.inline(entries))


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows beyond the first of their kind: count and share."""
    sizes = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.try_divide(F.sum(F.col("__n") - 1), F.sum("__n")), F.lit(0.0)).alias("duplicate_ratio"),
    )


def iqr_bounds(df: DataFrame, columns, reach: float = 1.5) -> dict[str, tuple[float, float]]:
    """Fences per column on the driver; columns without values are left out."""
    found = quantile_map(df, list(columns), [0.25, 0.75])
    return {
        c: (q[0] - reach * (q[1] - q[0]), q[1] + reach * (q[1] - q[0]))
        for c, q in ((c, found.get(c)) for c in columns) if q is not None
    }


def outlier_report(df: DataFrame, columns=None, reach: float = 1.5) -> DataFrame:
    """Fences and the count and percent of values beyond them, per numeric column."""
    bounds = iqr_bounds(df, numeric_columns(df) if columns is None else columns, reach)
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "column string, lower double, upper double, outlier_count long, outlier_pct double"
        )
    counts = per_column(df, list(bounds), {
        "lower": lambda c: F.max(F.lit(bounds[c][0])),
        "upper": lambda c: F.max(F.lit(bounds[c][1])),
        "outlier_count": lambda c: F.count_if(~as_double(df, c).between(*bounds[c])),
        "n": lambda c: F.count(as_double(df, c)),
    })
    return counts.withColumn("outlier_pct", F.col("outlier_count") * 100.0 / F.col("n")).drop("n")


def _pair_correlation(df: DataFrame, pairs) -> DataFrame:
    """Absolute correlation of column pairs over rows where both are present.

    A first pass gives count, mean and deviation of every column. Two columns without missing values then need
    one sum per pair; others need their own moments over the rows they share, about the same means. Wide
    aggregations hold at most ``SUMS_AT_ONCE`` sums, so that their code is compiled.
    """
    names = sorted({c for pair in pairs for c in pair})
    at = {c: f"__v{i}" for i, c in enumerate(names)}
    values = df.select(*[as_double(df, c).alias(at[c]) for c in names])
    rows = F.count(F.lit(1)).alias("rows")
    seen = values.agg(rows, *[
        F.struct(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(v) for v in at.values()]).first()
    full = {c for c in names if seen[at[c]]["n"] == seen["rows"] > 0}
    centred = values.select(*[(F.col(v) - F.lit(seen[v]["m"] or 0.0)).alias(v) for v in at.values()])

    def sums_of(i: int) -> list[Column]:
        a, b = pairs[i]
        x, y = F.col(at[a]), F.col(at[b])
        if a in full and b in full:
            return [F.avg(x * y)]
        here, there = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return [F.avg(x * y), F.avg(here), F.avg(there), F.avg(here * here), F.avg(there * there)]

    value: dict = {}
    waiting, wide = [], []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            value[i] = 1.0 if seen[at[a]]["s"] else None
            continue
        wanted = sums_of(i)
        if waiting and len(waiting) + len(wanted) > SUMS_AT_ONCE:
            wide.append(waiting)
            waiting = []
        waiting = waiting + [(i, s) for s in wanted]
    wide += [waiting] if waiting else []
    for part in wide:
        row = centred.agg(*[s.alias(f"s{j}") for j, (_, s) in enumerate(part)]).first()
        found: dict = {}
        for j, (i, _) in enumerate(part):
            found.setdefault(i, []).append(row[f"s{j}"])
        for i, sums in found.items():
            value[i] = _correlation(sums, *(seen[at[c]]["s"] for c in pairs[i]))
    return df.sparkSession.createDataFrame(
        [(a, b, value[i]) for i, (a, b) in enumerate(pairs)], "column_a string, column_b string, value double")


def _correlation(sums: list, *deviations) -> float | None:
    """Absolute correlation from the mean product of two centred columns, and their own moments if rows are missing."""
    product = sums[0]
    if len(sums) > 1 and product is not None:
        product -= sums[1] * sums[2]
        deviations = [max(0.0, sums[j + 3] - sums[j + 1] ** 2) ** 0.5 for j in range(2)]
        floor = [1e-7 * sums[j + 3] ** 0.5 for j in range(2)]  # what rounding leaves of no variance
        deviations = [d if d > f else 0.0 for d, f in zip(deviations, floor)]
    if product is None or not deviations[0] or not deviations[1]:
        return None
    return min(1.0, abs(product / (deviations[0] * deviations[1])))


def _empty_pairs(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column_a string, column_b string, value double")


def _mirrored(upper: DataFrame, diagonal: DataFrame) -> DataFrame:
    return upper.unionByName(upper.select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "value"
    )).unionByName(diagonal)


def correlation_matrix(df: DataFrame, columns=None) -> DataFrame:
    """All ordered pairs as (column_a, column_b, value); null where a column does not vary."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return _empty_pairs(df)
    pairs = [*combinations(columns, 2), *[(c, c) for c in columns]]
    found = _pair_correlation(df, pairs)
    return found.unionByName(found.where(F.col("column_a") != F.col("column_b")).select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "value"
    ))


def correlation_pairs(df: DataFrame, columns=None, threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """Column pairs at or above the threshold, strongest first."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if len(columns) < 2:
        return _empty_pairs(df)
    found = _pair_correlation(df, list(combinations(columns, 2)))
    return found.where(F.col("value") >= threshold).orderBy(F.desc("value"), "column_a", "column_b")


def low_cardinality(df: DataFrame, columns, limit: int | None = None) -> list[str]:
    """All columns, or those of at most ``limit`` levels when the caller sets one."""
    if limit is None:
        return list(columns)
    levels = cardinality_map(df, columns) if columns else {}
    return [c for c in columns if levels[c] <= limit]


def _associations(df: DataFrame, columns) -> DataFrame:
    """Bias-corrected Cramer's V per column pair.

    Pairs of levels are counted in one shuffle with map-side sums. For columns of few levels the
    counts are few, so the margins are windows over a small table.
    """
    pairs = list(combinations(columns, 2))
    entries = F.array(*[
        F.struct(F.lit(i).alias("pair"), col(a).cast("string").alias("a"), col(b).cast("string").alias("b"))
        for i, (a, b) in enumerate(pairs)
    ])
    cells = (
        df.select(F.inline(entries)).where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pair", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("o"))
    )
    margins = cells.select(
        "pair", "a", "b", "o",
        F.sum("o").over(Window.partitionBy("pair", "a")).alias("row"),
        F.sum("o").over(Window.partitionBy("pair", "b")).alias("column"),
    )
    sizes = margins.groupBy("pair").agg(
        F.sum("o").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"),
        (F.sum(F.col("o") * F.col("o") / (F.col("row") * F.col("column"))) - 1).alias("phi2"),
    )
    below = F.greatest(F.col("n") - 1, F.lit(1.0))
    r, k = F.col("r"), F.col("k")
    phi = F.greatest(F.lit(0.0), F.col("phi2") - (k - 1) * (r - 1) / below)
    room = F.least(r - (r - 1) * (r - 1) / below - 1, k - (k - 1) * (k - 1) / below - 1)
    v = F.when(room > 0, F.sqrt(phi / room)).otherwise(F.lit(0.0))
    names = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column_a string, column_b string"
    )
    return names.join(sizes, "pair", "left").select("column_a", "column_b", F.coalesce(v, F.lit(0.0)).alias("value"))


def association_matrix(df: DataFrame, columns, limit: int | None = None) -> DataFrame:
    columns = low_cardinality(df, list(columns), limit)
    if len(columns) < 2:
        return _empty_pairs(df)
    diagonal = df.sparkSession.createDataFrame(
        [(c, c, 1.0) for c in columns], "column_a string, column_b string, value double"
    )
    return _mirrored(_associations(df, columns), diagonal)


def association_pairs(df: DataFrame, columns, threshold: float = ASSOCIATION_THRESHOLD, limit: int | None = None) -> DataFrame:
    """Category pairs at or above the threshold, strongest first."""
    columns = low_cardinality(df, list(columns), limit)
    if len(columns) < 2:
        return _empty_pairs(df)
    found = _associations(df, columns)
    return found.where(F.col("value") >= threshold).orderBy(F.desc("value"), "column_a", "column_b")
