"""Exact quantiles of many columns of a whole table, in three passes.

A mergeable sketch of every column brackets each wanted rank between two values; the sketch's error is known,
so the bracket holds about 4 of 10,000 values. Counting what lies below and inside tells where the rank stands in the
bracket, and only the values inside are shuffled. Where a bracket still holds too many values, those equal to its
ends are counted, and what lies between the ends is sketched and counted again, so three passes more serve about 2,500 times
the rows, and values that many rows share are never met twice. Every bracket is checked by its counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # of a sketch: its ranks are right within rows / ACCURACY
SLACK = 2 / ACCURACY
FEW_ROWS = 2 * ACCURACY  # below it, a bracket by ranks is no narrower than the column
COLUMNS_AT_ONCE = 20
BRACKETS_AT_ONCE = 20  # counts per aggregation; its code stays small enough to be compiled


@dataclass
class Bracket:
    """``low`` <= the values at ranks ``first`` and ``last`` <= ``high``; ``below`` values are smaller than ``low``.

    ``inner``: ranks on an end are found, ``below`` and ``inside`` tell of what lies between the ends.
    """

    column: str
    first: int
    last: int
    low: float
    high: float
    below: int
    inside: int
    found: dict = field(default_factory=dict)  # rank: value
    inner: bool = False

    @property
    def wanted(self) -> list[int]:
        return [r for r in sorted({self.first, self.last}) if r not in self.found]

    @property
    def settled(self) -> bool:
        return self.low == self.high or not self.wanted

    def between(self):
        if self.inner:
            return (F.col(self.column) > F.lit(self.low)) & (F.col(self.column) < F.lit(self.high))
        return F.col(self.column).between(F.lit(self.low), F.lit(self.high))


def _chunks(items: list, most: int) -> list[list]:
    return [items[i:i + most] for i in range(0, len(items), most)]


def _first_brackets(values: DataFrame, names, probabilities) -> dict[str, tuple[int, list[Bracket]]]:
    """Per column its number of values and a bracket per probability, not yet counted."""
    ends = [min(1.0, max(0.0, p + side)) for p in probabilities for side in (-SLACK, SLACK)]
    found = {}
    for some in _chunks(list(names), COLUMNS_AT_ONCE):
        row = values.agg(*[
            F.struct(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"),
                     F.percentile_approx(c, ends, ACCURACY).alias("q")).alias(c) for c in some]).first()
        for c in some:
            n, least, most, q = row[c]
            brackets = []
            for i, p in enumerate(probabilities if n else ()):
                spot = (n - 1) * p
                low, high = (least, most) if n <= FEW_ROWS else (q[2 * i], q[2 * i + 1])
                brackets.append(Bracket(c, math.floor(spot), math.ceil(spot), low, high, 0, n))
            found[c] = n, brackets
    return found


def _take_ends(values: DataFrame, brackets: list[Bracket]) -> None:
    """Find the ranks on an end of their bracket; the bracket then holds what lies between its ends.

    Between two values that many rows share a bracket would not shrink otherwise.
    """
    for some in _chunks(brackets, BRACKETS_AT_ONCE):
        counts = [F.struct(*[F.count_if(F.col(b.column) == F.lit(end)) for end in (b.low, b.high)]).alias(f"c{i}") for i, b in enumerate(some)]
        for b, (least, most) in zip(some, values.agg(*counts).first()):
            for rank in b.wanted:
                if rank < b.below + least:
                    b.found[rank] = b.low
                elif rank >= b.below + b.inside - most:
                    b.found[rank] = b.high
            b.below, b.inside, b.inner = b.below + least, b.inside - least - most, True


def _narrowed(values: DataFrame, brackets: list[Bracket]) -> None:
    """Sketch what lies inside each bracket and move its ends towards the ranks."""
    for some in _chunks(brackets, COLUMNS_AT_ONCE):
        sketches = []
        for i, b in enumerate(some):
            ends = [min(1.0, max(0.0, (rank - b.below + 1) / b.inside + side)) for rank, side in ((b.wanted[0], -SLACK), (b.wanted[-1], SLACK))]
            sketches.append(F.percentile_approx(F.when(b.between(), F.col(b.column)), ends, ACCURACY).alias(f"q{i}"))
        for b, (low, high) in zip(some, values.agg(*sketches).first()):
            b.low, b.high, b.inner = low, high, False


def _count(values: DataFrame, brackets: list[Bracket]) -> bool:
    """Whether all ranks lie in their brackets."""
    for some in _chunks(brackets, BRACKETS_AT_ONCE):
        counts = [F.struct(F.count_if(F.col(b.column) < F.lit(b.low)), F.count_if(b.between())).alias(f"c{i}") for i, b in enumerate(some)]
        for b, (below, inside) in zip(some, values.agg(*counts).first()):
            b.below, b.inside = below, inside
    return all(b.below <= rank < b.below + b.inside for b in brackets for rank in b.wanted)


def _pick(values: DataFrame, brackets: list[Bracket]) -> None:
    """Take the wanted ranks out of the counted values inside each bracket."""
    for some in _chunks(brackets, BRACKETS_AT_ONCE):
        entries = F.array(*[F.when(b.between(), F.struct(F.lit(i).alias("at"), F.col(b.column).alias("v"))) for i, b in enumerate(some)])
        inside = values.select(F.inline(F.array_compact(entries))).groupBy("at", "v").agg(F.count(F.lit(1)).alias("f"))
        # A bracket holds few values by now, so its window is small.
        until = F.sum("f").over(Window.partitionBy("at").orderBy("v"))
        placed = inside.withColumn("until", until).withColumn("before", F.col("until") - F.col("f"))
        wanted = F.array(*[F.array(*[F.lit(rank - b.below) for rank in b.wanted]).cast("array<long>") for b in some])
        hits = F.filter(F.get(wanted, F.col("at")), lambda r: (F.col("before") <= r) & (r < F.col("until")))
        for at, v, rank in placed.select("at", "v", F.explode(hits)).collect():
            some[at].found[rank + some[at].below] = v


def whole_quantiles(values: DataFrame, names, probabilities, limit: int) -> dict[str, tuple[int, list[float] | None]] | None:
    """Per column of doubles: the number of values, and the linearly interpolated quantiles (None without values).

    Gives None if a sketch was further off than its error allows, as the counts would show.

    ``limit`` bounds the rows that a bracket may hold when its values are shuffled.
    """
    found = _first_brackets(values, names, probabilities)
    brackets = [b for _, own in found.values() for b in own]
    waiting = [b for b in brackets if b.inside > FEW_ROWS]
    limit = max(limit, FEW_ROWS)
    while waiting:
        if not _count(values, waiting):
            return None
        waiting = [b for b in waiting if b.inside > limit and not b.settled]
        _take_ends(values, waiting)
        waiting = [b for b in waiting if b.inside > limit and not b.settled]
        _narrowed(values, waiting)
    for b in brackets:
        if b.low == b.high:
            b.found |= dict.fromkeys(b.wanted, b.low)
    _pick(values, [b for b in brackets if not b.settled])
    answers = {}
    for c, (n, own) in found.items():
        q = []
        for b, p in zip(own, probabilities):
            low, high, spot = b.found[b.first], b.found[b.last], (n - 1) * p
            q.append(low + (high - low) * (spot - math.floor(spot)) if low != high else low)
        answers[c] = n, (q if n else None)
    return answers
