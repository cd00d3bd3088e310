"""Tagging question text: keyword tags, exact mentions, typo-tolerant names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question keywords, matched as substrings in this order.
KIND_WORDS = {
    "trend": ("trend", "over time", "by month", "by date", "evolution"),
    "compare": ("compare", "vs", "versus", "difference between"),
    "rank": ("top", "bottom", "highest", "lowest", "rank"),
    "distribution": ("distribution", "histogram", "spread"),
}
GRAIN_WORDS = {
    "daily": "1d", "day": "1d", "weekly": "1w", "week": "1w", "monthly": "1mo", "month": "1mo",
    "yearly": "1y", "annual": "1y", "annually": "1y",
}
AGG_WORDS = {
    "min": ("lowest", "minimum", "min", "smallest"),
    "max": ("highest", "maximum", "max", "largest"),
    "mean": ("average", "avg", "mean"),
    "sum": ("total", "sum"),
}
METRIC_SYNONYMS = {
    "sales": ("sales", "revenue", "turnover"),
    "profit": ("profit", "margin"),
    "temperature": ("temperature", "temp"),
    "co2": ("co2", "emissions", "carbon"),
}
DEFAULT_KIND = "trend"
CLOSE_ENOUGH = 0.8


def _first_tag(text: Column, words: dict) -> Column:
    """The first tag that has a keyword inside the text."""
    lowered = F.lower(text)
    tests = [
        F.when(F.greatest(*[lowered.contains(k) for k in keys], F.lit(False)), F.lit(tag))
        for tag, keys in words.items()
    ]
    return F.coalesce(*tests)


def question_kind(text: Column) -> Column:
    return F.coalesce(_first_tag(text, KIND_WORDS), F.lit(DEFAULT_KIND))


def question_grain(text: Column) -> Column:
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(word), F.lit(grain)) for word, grain in GRAIN_WORDS.items()])


def question_agg(text: Column) -> Column:
    return _first_tag(text, AGG_WORDS)


def question_metric(text: Column) -> Column:
    return _first_tag(text, METRIC_SYNONYMS)


def normalize(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 become one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def mentioned(text: Column, names) -> Column:
    """The names, in list order, that occur in the text whole or with all their words apart."""
    plain_names = [(n, re.sub("[^a-z0-9]+", " ", n.lower()).strip()) for n in names]

    def hits(plain: Column) -> Column:
        padded = F.concat(F.lit(" "), plain, F.lit(" "))
        found = []
        for name, wanted in plain_names:
            words = [padded.contains(f" {w} ") for w in wanted.split()]
            if words:
                found.append(F.when(plain.contains(wanted) | reduce(lambda a, b: a & b, words), F.lit(name)))
        return F.array_compact(F.array(*found))

    # Going through a one-element array normalizes each text once instead of once per name.
    return F.transform(F.array(normalize(text)), hits)[0]


def spellings(name: str) -> list[tuple[str, int]]:
    """The lower-case name at cost 0, and with two neighbouring letters swapped at cost 1."""
    plain = name.lower()
    swapped = (plain[:i] + plain[i + 1] + plain[i] + plain[i + 2:] for i in range(len(plain) - 1))
    return [(plain, 0), *((s, 1) for s in dict.fromkeys(swapped) if s != plain)]


def closest_names(text: Column, names, cutoff: float = CLOSE_ENOUGH) -> Column:
    """The names closest to the words of the text, in order of first use, without repeats.

    Closeness is 1 - edits / length of the longer: inserted, dropped, changed letters and one swap of
    neighbours are an edit each. A word takes its closest name, the first listed on a tie, if that reaches the cutoff.
    """
    listed = [(i, n, spellings(n)) for i, n in enumerate(names)]

    def score(word: Column, name: str, ways) -> Column:
        edits = [F.levenshtein(word, F.lit(spelled)) + cost for spelled, cost in ways]
        longest = F.greatest(F.length(word), F.lit(len(name)))
        return 1 - (F.least(*edits) if len(edits) > 1 else edits[0]) / longest

    def best(word: Column) -> Column:
        ranked = F.array(*[
            F.struct(score(word, n, ways).alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, n, ways in listed])
        top = F.array_max(ranked)
        return F.when(top["score"] >= cutoff, top["name"])

    if not listed:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.transform(tokens(text), best)))
