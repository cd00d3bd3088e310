"""Mutual information from counts: H(a) + H(b) - H(a, b), so no margins are joined back."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, is_numeric, type_of
from .order import quantile_map
from .profile import cardinality_map

MAX_BINS = 32
MISSING_LEVEL = "__MISSING__"


def with_bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Replace double columns by the number of cut points below the value: right-closed bins."""
    cut = {c: e for c, e in edges.items() if e}
    if not cut:
        return df
    # The bucketizer closes its ranges on the left; on negated values that is the right.
    flipped = df.withColumns({f"__neg_{c}": -F.col(c) for c in cut})
    binned = Bucketizer(
        splitsArray=[[float("-inf"), *[-x for x in reversed(e)], float("inf")] for e in cut.values()],
        inputCols=[f"__neg_{c}" for c in cut], outputCols=[f"__bin_{c}" for c in cut],
    ).transform(flipped)
    return binned.select(*[
        (len(cut[c]) - F.col(f"__bin_{c}")).cast("int").alias(c) if c in cut else F.col(c) for c in df.columns
    ])


def leveled(df: DataFrame, columns, bins: int = MAX_BINS) -> tuple[DataFrame, dict[str, str]]:
    """Each column as text levels, and its new name: numbers with many values are cut into quantile bins.

    A missing number takes the median's bin, missing text is a level of its own.
    """
    columns = list(columns)
    numeric = [c for c in columns if is_numeric(type_of(df, c))]
    counts = cardinality_map(df, numeric) if numeric else {}
    cuts = quantile_map(df, numeric, [0.5, *[i / bins for i in range(1, bins)]])
    names, picked, edges = {c: f"__c{i}" for i, c in enumerate(columns)}, [], {}
    for c in columns:
        value = col(c)
        if c in numeric:
            median, *inner = cuts.get(c) or [None]
            value = F.coalesce(as_double(df, c), F.lit(median).cast("double"))
            if counts[c] > bins:
                edges[names[c]] = sorted(set(inner))
        picked.append(value.alias(names[c]))
    binned = with_bins(df.select(*picked), edges)
    return binned.select(*[
        F.coalesce(F.col(n).cast("string"), F.lit(MISSING_LEVEL)).alias(n) for n in names.values()
    ]), names


def _entropy_sum(counts: DataFrame, by) -> DataFrame:
    """Sum of n ln n per group of the given counts."""
    return counts.groupBy(*by).agg(F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s"))


def mutual_information(df: DataFrame, features, target: str, bins: int = MAX_BINS) -> DataFrame:
    """(feature, score) in nats for each feature against the target; rows without a target are left out."""
    features = [f for f in features if f != target]
    levels, name = leveled(df, [*features, target], bins)
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(name[f]).alias("a")) for f in features])
    cells = levels.select(F.col(name[target]).alias("b"), F.inline(entries)).groupBy("feature", "a", "b").agg(
        F.count(F.lit(1)).alias("n")
    )
    joint = cells.groupBy("feature").agg(
        F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("joint"), F.sum("n").cast("double").alias("total")
    )
    left = _entropy_sum(cells.groupBy("feature", "a").agg(F.sum("n").alias("n")), ["feature"])
    right = _entropy_sum(cells.groupBy("feature", "b").agg(F.sum("n").alias("n")), ["feature"])
    score = (F.col("joint") - F.col("left") - F.col("right")) / F.col("total") + F.log("total")
    return (
        joint.join(left.withColumnRenamed("s", "left"), "feature")
        .join(right.withColumnRenamed("s", "right"), "feature")
        .select("feature", F.greatest(score, F.lit(0.0)).alias("score"))
    )
