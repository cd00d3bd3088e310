"""Turning a table into features and a coded target."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from ..functions.columns import as_double, col, is_numeric, is_temporal, type_of
from ..session import checkpointed
from .attach import attach
from .order import quantile_map
from .profile import value_counts
from .split import time_value

# Parts of a name that mark an identifier.
IDENTIFIER_WORDS = ("id", "identifier", "uuid", "guid", "serial", "name", "employee")
UNIQUE_SHARE = 0.9
MAX_CLASSES = 10_000
MAX_LEVELS = 20
ONE_TASK_LEVELS = 100_000


def identifier_columns(df: DataFrame, unique_share: float = UNIQUE_SHARE) -> list[str]:
    """Columns named like identifiers, and text that hardly repeats; never all columns."""
    named = [c for c in df.columns if any(w in c.strip().lower() for w in IDENTIFIER_WORDS)]
    others = [f.name for f in df.schema.fields if f.name not in named and not is_numeric(f.dataType)]
    unique = []
    if others:
        found = df.agg(
            F.count(F.lit(1)).alias("n"), *[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(others)]
        ).first()
        unique = [c for i, c in enumerate(others) if found["n"] and found[f"d{i}"] >= unique_share * found["n"]]
    dropped = [c for c in df.columns if c in named or c in unique]
    return [] if len(dropped) == len(df.columns) else dropped


def drop_identifiers(df: DataFrame, keep=()) -> DataFrame:
    dropped = set(identifier_columns(df.select(*[col(c) for c in df.columns if c not in keep])))
    return df.select(*[col(c) for c in df.columns if c not in dropped])


def epochize(df: DataFrame) -> DataFrame:
    """Dates and timestamps become seconds since 1970; null stays null."""
    return df.select(*[
        F.when(col(f.name).isNotNull(), time_value(df, f.name) / 1e6).alias(f.name) if is_temporal(f.dataType) else col(f.name)
        for f in df.schema.fields
    ])


def prepare_features(df: DataFrame, target: str, keep=()) -> DataFrame:
    """Identifiers dropped and dates as numbers, beside the target; raw types stay for the encoder."""
    return epochize(drop_identifiers(df, keep=[target, *keep]))


def level_codes(levels: DataFrame, value: str) -> DataFrame:
    """Add ``code``: the position of each distinct text in sorted order.

    Few levels are numbered in one task. Many are range partitioned and materialized once, so that
    the partition offsets belong to the very rows they were counted on.
    """
    if levels.limit(ONE_TASK_LEVELS + 1).count() <= ONE_TASK_LEVELS:
        return levels.withColumn("code", F.row_number().over(Window.orderBy(value)) - 1)
    ranged = checkpointed(levels.repartitionByRange(value).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(value)) - 1
    numbered = ranged.withColumn("__local", local).join(F.broadcast(starts), "__part")  # one row per partition
    return numbered.select(*levels.columns, (F.col("__local") + F.col("__start")).cast("int").alias("code"))


def class_codes(df: DataFrame, target: str) -> DataFrame:
    """(label, code) for every label of a class target, in the order of the labels; any number of them."""
    labels = df.select(col(target).cast("string").alias("label")).where("label is not null").distinct()
    return level_codes(labels, "label").select("label", F.col("code").cast("int").alias("code"))


def target_classes(df: DataFrame, target: str) -> list[str]:
    """The sorted labels of a class target; position is the code."""
    found = df.select(col(target).cast("string").alias("v")).where("v is not null").distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return sorted(r["v"] for r in found)


def encode_target(df: DataFrame, target: str, classes=None) -> DataFrame:
    """Add ``<target>_code``: position of the label among the sorted labels, or among given ones.

    A missing label, or one that is not among given ones, has no code. The labels may be any number.
    """
    name = f"{target}_code"
    rows = df.withColumn("__label", col(target).cast("string"))
    if classes is not None:
        given = df.sparkSession.createDataFrame([(str(c), i) for i, c in enumerate(classes)], "__given string, __code int")
        found = rows.join(F.broadcast(given), F.col("__label") == F.col("__given"), "left")  # as large as the caller's list
        return found.select(*[col(c) for c in df.columns if c != name], F.col("__code").alias(name))
    counts = rows.groupBy("__label").agg(F.count(F.lit(1)).alias("__rows"))
    codes = level_codes(counts.where("__label is not null"), "__label").select("__label", "__rows", F.col("code").cast("int"))
    missing = counts.where("__label is null").withColumn("code", F.lit(None).cast("int"))
    coded = attach(rows, codes.unionByName(missing), ["__label"], rows="__rows")
    return coded.select(*[col(c) for c in df.columns if c != name], F.col("code").alias(name))


def ordinal_encode(df: DataFrame, columns=None, medians: bool = True) -> DataFrame:
    """Text as the position among its sorted values (missing counts as the text 'nan'), numbers with
    missing values filled by the median (0 without any value)."""
    columns = df.columns if columns is None else list(columns)
    numeric = [c for c in columns if is_numeric(type_of(df, c))]
    fills = quantile_map(df, numeric, [0.5]) if numeric and medians else {}
    text = [c for c in columns if c not in numeric]
    if text:  # the levels of all columns from one pass over the source
        levels = checkpointed(df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("__at"), F.coalesce(col(c).cast("string"), F.lit("nan")).alias("__level"))
            for i, c in enumerate(text)
        ]))).groupBy("__at", "__level").agg(F.count(F.lit(1)).alias("__rows")))
    out = df
    for c in columns:
        if c in numeric:
            fill = fills[c][0] if fills.get(c) else 0.0
            out = out.withColumn(c, F.coalesce(as_double(df, c), F.lit(fill)))
            continue
        out = out.withColumn(c, F.coalesce(col(c).cast("string"), F.lit("nan")))
        counts = levels.where(F.col("__at") == text.index(c)).drop("__at")
        codes = level_codes(counts, "__level").withColumnRenamed("__level", c)
        coded = attach(out, codes, [c], rows="__rows")
        out = coded.select(*[F.col("code").cast("double").alias(c) if x == c else col(x) for x in out.columns])
    return out


class _EncoderParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric feature columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "text feature columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column to write", TypeConverters.toString)
    maxLevels = Param(Params._dummy(), "maxLevels", "output levels per text column", TypeConverters.toInt)

    def numeric(self) -> list[str]:
        return self.getOrDefault(self.numericCols)

    def categorical(self) -> list[str]:
        return self.getOrDefault(self.categoricalCols)


class FeatureEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Median fill for numbers; most frequent value, then one-hot for text.

    A text column with more than ``maxLevels`` levels keeps its most frequent ones and folds the rest,
    and levels never seen, into one last place. Without such a place an unseen level is all zeros.
    """

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, outputCol="features", maxLevels=MAX_LEVELS):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], outputCol="features", maxLevels=MAX_LEVELS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "FeatureEncoderModel":
        medians = quantile_map(df, self.numeric(), [0.5])
        fills = [medians[c][0] if medians.get(c) else 0.0 for c in self.numeric()]
        limit = self.getOrDefault(self.maxLevels)
        plans = {c: {"mode": "", "levels": [], "rare": False} for c in self.categorical()}
        if plans:
            counts = value_counts(df, self.categorical()).where(F.col("value").isNotNull())
            missing = df.agg(*[
                F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(self.categorical())
            ]).first()
            lost = {c: missing[f"m{i}"] for i, c in enumerate(self.categorical())}
            # Ties keep the later level, as the least frequent are taken from the front.
            order = Window.partitionBy("column").orderBy(F.desc("n"), F.desc("value"))
            best = counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit + 1)
            modes = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
            mode_of = {r["column"]: r["mode"] for r in modes.collect()}
            seen: dict[str, list] = {c: [] for c in plans}
            for r in best.collect():
                extra = lost[r["column"]] if r["value"] == mode_of[r["column"]] else 0
                seen[r["column"]].append((r["n"] + extra, r["value"]))
            for c, found in seen.items():
                if found and mode_of[c] not in [v for _, v in found]:
                    found.append((max(found)[0] + lost[c], mode_of[c]))
                found.sort(reverse=True)
                rare = len(found) > limit
                kept = [v for _, v in (found[:limit - 1] if rare else found)]
                plans[c] = {"mode": mode_of.get(c, ""), "levels": sorted(kept), "rare": rare}
        model = FeatureEncoderModel(
            numericCols=self.numeric(), categoricalCols=self.categorical(),
            outputCol=self.getOrDefault(self.outputCol), plan=json.dumps({"fills": fills, "levels": plans}),
        )
        return model._resetUid(self.uid)


class FeatureEncoderModel(Model, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted encoder: only column expressions, so it also runs on a stream."""

    plan = Param(Params._dummy(), "plan", "fill values and levels as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, outputCol="features", plan="{}"):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], outputCol="features", plan="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def feature_names(self) -> list[str]:
        levels = json.loads(self.getOrDefault(self.plan))["levels"]
        text = [
            f"{c}_{v}" for c in self.categorical()
            for v in levels[c]["levels"] + (["rare"] if levels[c]["rare"] else [])
        ]
        return self.numeric() + text

    def level_rows(self) -> list[tuple[str, str]]:
        levels = json.loads(self.getOrDefault(self.plan))["levels"]
        return [(c, v) for c in self.categorical() for v in levels[c]["levels"] + (["<rare>"] if levels[c]["rare"] else [])]

    def feature_array(self, df: DataFrame):
        """The features as an array expression."""
        plan = json.loads(self.getOrDefault(self.plan))
        parts = [F.coalesce(as_double(df, c), F.lit(float(v))) for c, v in zip(self.numeric(), plan["fills"])]
        for c in self.categorical():
            spec = plan["levels"][c]
            value = F.coalesce(col(c).cast("string"), F.lit(spec["mode"]))
            parts += [(value == v).cast("double") for v in spec["levels"]]
            if spec["rare"]:
                parts.append((~value.isin(spec["levels"])).cast("double"))
        return F.array(*parts)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(self.feature_array(df)))


def feature_encoder(df: DataFrame, features, out: str = "features") -> FeatureEncoder:
    """An encoder for the given columns by their types."""
    numeric = [c for c in features if is_numeric(type_of(df, c))]
    return FeatureEncoder(
        numericCols=numeric, categoricalCols=[c for c in features if c not in numeric], outputCol=out
    )
