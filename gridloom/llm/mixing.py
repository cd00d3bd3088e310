"""Mixing sources to target weights by weighted fair queueing.

Every document (and its repeats, epoch by epoch) waits in its source's queue in hashed order. Its virtual
finish time is the number of words of its source up to and with it, divided by the source's weight. All
entries sorted by finish time, cut where the words so far reach the budget, are the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.order import running_totals
from .common import WORD_PATTERN, as_rows, stored, text_or_empty

WEIGHTS = (5, 2, 1)
ROWS_PER_BIN = 4_000
KEYS = ["doc_id", "source", "size", "nth"]


def sized(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size in words, and nth among rows alike in these."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long")
    rows = docs.select(col("doc_id"), col("source"), size.alias("size"))
    alike = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("__n"))
    return alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("nth"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """Per source: weight, words, documents and target.

    The sources are the mix's configuration (each has a weight), so one task orders them. With the
    sources by cap / weight, the first whose cap is not below its share of what the earlier ones leave
    fixes the words per weight of all sources that do not reach their cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = sources.withColumn("weight", cycle[(F.row_number().over(by_name) - 1) % len(weights)])
    cap = F.col("source_size") * float(max_epochs)
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = (left / F.sum("weight").over(onward)).alias("level")
    leveled = sources.select("*", level)
    fitting = F.when(cap >= F.col("level") * F.col("weight"), F.col("level"))
    per_weight = F.min_by(fitting, F.when(fitting.isNotNull(), cap / F.col("weight"))).over(everything)
    goal = F.least(cap, F.coalesce(per_weight * F.col("weight"), cap))
    return leveled.select("source", "source_size", "docs", "weight", goal.alias("target"))


def schedule(rows: DataFrame, goals: DataFrame, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """Every entry (row of ``rows`` and epoch) with its virtual finish time.

    A queue is cut into bins of its hash range, so the running sum of a large source is shared by many
    tasks: totals per bin are summed up over the bins, then rows inside each bin.
    """
    info = F.broadcast(goals.select(F.col("source").alias("__source"), "docs", "weight"))  # one row per source
    entries = rows.join(info, rows["source"].eqNullSafe(F.col("__source"))).drop("__source")
    entries = entries.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    spot = F.pmod(F.xxhash64(F.lit(seed), "epoch", "doc_id", "nth"), F.lit(2**52))
    bins = F.ceil(F.col("docs") / ROWS_PER_BIN)
    entries = entries.withColumn("spot", spot).withColumn(
        "bin", F.floor(F.col("spot") * bins / F.lit(float(2**52))).cast("long"))
    totals = entries.groupBy("source", "epoch", "bin").agg(F.sum("size").alias("__total"))
    earlier = Window.partitionBy("source").orderBy("epoch", "bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("__source"), F.col("epoch").alias("__epoch"), F.col("bin").alias("__bin"),
        F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy("source", "epoch", "bin").orderBy("spot", *KEYS).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = entries.withColumn("__here", F.sum("size").over(inside))
    same = local["source"].eqNullSafe(offsets["__source"]) & (local["epoch"] == offsets["__epoch"]) & (
        local["bin"] == offsets["__bin"])
    served = F.col("__before") + F.col("__here")
    return local.join(offsets, same).select(*KEYS, "epoch", (served / F.col("weight")).alias("finish"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix as rows (doc_id, source, size, nth, epoch, finish), range-sorted by finish time.

    Input: doc_id, source, text; other columns are ignored. Sources in code point order, null last, take
    the weights in turn. The budget is ``share`` of all words; a source offers each document at most
    ``max_epochs`` times. A null or blank text has size 0. Equal finish times are cut together, so the
    mix never passes the budget. An empty table, or one without words, gives an empty or word-less mix.
    """
    rows = stored(sized(docs), "mix-sizes")
    return _cut(rows, stored(targets(rows, weights, share, max_epochs), "mix-targets"), share, max_epochs, seed)


def _cut(rows, goals, share, max_epochs, seed):
    entries = stored(schedule(rows, goals, max_epochs, seed), "mix-entries")
    budget = (goals.agg(F.sum("source_size")).first()[0] or 0) * share
    ties = entries.groupBy("finish").agg(F.sum("size").alias("words"))
    reached = running_totals(ties, "finish", ["words"]).where(F.col("below_words") + F.col("words") <= budget)
    last = reached.agg(F.max("finish")).first()[0]
    taken = entries.where(F.col("finish") <= F.lit(last)) if last is not None else entries.limit(0)
    return taken.repartitionByRange("finish", *KEYS).sortWithinPartitions("finish", *KEYS)


def shares(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, words taken (repeats counted)."""
    rows = stored(sized(docs), "mix-sizes")
    goals = stored(targets(rows, weights, share, max_epochs), "mix-targets")
    epochs = _cut(rows, goals, share, max_epochs, seed).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__epochs"))
    held = rows.select(*[F.col(k).alias(f"__{k}") for k in KEYS])
    same = held["__nth"] == epochs["nth"]
    for k in KEYS[:-1]:
        same = same & held[f"__{k}"].eqNullSafe(epochs[k])
    found = held.join(epochs, same, "left")
    info = F.broadcast(goals.select(F.col("source").alias("__s"), "source_size", "target"))
    return found.join(info, F.col("__source").eqNullSafe(F.col("__s"))).select(
        F.col("__doc_id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target",
        (F.col("__size") * F.coalesce(F.col("__epochs"), F.lit(0))).alias("taken"),
        F.coalesce(F.col("__epochs"), F.lit(0)).alias("epochs"), F.col("__source").alias("source"),
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The documents of the mix with all their columns, a document as many times as the mix holds it."""
    held = shares(docs, weights, share, max_epochs, seed).groupBy("doc_id", "source", "size").agg(
        F.sort_array(F.collect_list("epochs"), asc=False).alias("takes"))
    held = held.withColumnsRenamed({"doc_id": "held_id", "source": "held_source", "size": "held_size"})
    words = F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long")
    rows = as_rows(docs, id=col("doc_id"), source=col("source"), size=words)
    same = F.col("id").eqNullSafe(F.col("held_id")) & F.col("source").eqNullSafe(F.col("held_source")) & (
        F.col("size") == F.col("held_size"))
    # Rows alike in all three are told apart by their other columns.
    nth = F.row_number().over(Window.partitionBy("held_id", "held_source", "held_size").orderBy(F.to_json("row")))
    repeats = F.when(F.col("take") > 0, F.sequence(F.lit(1), F.col("take").cast("int")))
    return rows.join(held, same).withColumn("take", F.element_at("takes", nth)).withColumn(
        "repeat", F.explode(repeats)).select("row.*")


def query(spark, directory):
    found = shares(spark.read.parquet(f"{directory}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
