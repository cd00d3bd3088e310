"""Names of a vocabulary table in a table of texts: close spellings, and mentions.

Both sides are tables, so neither the plan nor the driver grows with the vocabulary. Close names meet words
through an index: short ones share a string that both become by deleting as many letters as slips are
allowed, long ones share one of the pieces the name is cut into. Mentions are looked up inside
tasks, by an automaton over one bounded share of the vocabulary at a time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, type_of
from ..functions.text import CLOSE_ENOUGH, normalize, tokens
from ..session import checkpointed
from .attach import attach

SHORT = 14  # letters of a name up to which deletions index it
SHARE_BYTES = 8 << 20  # of names in one task's automaton


def _allowed(length: Column, cutoff: float) -> Column:
    """Slips between texts of which the longer has this length."""
    return F.floor((1 - cutoff) * length + 1e-9).cast("int")


def _most(length: Column, cutoff: float) -> Column:
    """Slips between a text of this length and any other: the other may be longer by as many letters."""
    return F.floor(length * ((1 - cutoff) / cutoff) + 1e-9).cast("int")


def _deletions(text: Column, most: Column, rounds: int) -> Column:
    """The text without 0 to ``most`` of its letters, at most ``rounds``."""
    found = last = F.array(text)
    for i in range(rounds):
        shorter = F.flatten(F.transform(last, lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
            lambda at: F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s))))))
        last = F.when(most > i, F.array_distinct(shorter)).otherwise(F.array().cast("array<string>"))
        found = F.array_union(found, last)
    return found


def _keys(text: Column, cutoff: float, longest: int) -> Column:
    """What a text of at most ``longest`` letters may share with a close one: itself without its allowed slips.

    Slips are a (letters only here), b (letters only there) and c (changed or swapped); the texts meet without a + c letters here,
    b + c there. If the other is longer by d letters, b is d at least and it allows at most d slips more, so a + c stays
    within what this length allows; if it is not longer, all slips are.
    """
    return _deletions(text, _allowed(F.length(text), cutoff), int((1 - cutoff) * longest + 1e-9))


def _short_lengths(lengths, cutoff: float) -> list[int]:
    """Lengths up to ``SHORT`` that a text may have to be close to one of the given lengths."""
    return [n for n in range(1, SHORT + 1) if any(abs(n - m) <= int((1 - cutoff) * max(n, m) + 1e-9) for m in lengths)]


def _pieces(name: Column, cutoff: float) -> Column:
    """The pieces of a long name: one more than slips can touch, as one swap of neighbours touches two."""
    length = F.length(name)
    count = _most(length, cutoff) + 2
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        length.alias("n"), i.alias("i"), F.substring(
            name, F.floor(i * length / count).cast("int") + 1,
            F.floor((i + 1) * length / count).cast("int") - F.floor(i * length / count).cast("int")).alias("piece")))


def _probes(word: Column, cutoff: float) -> Column:
    """Everything that a piece of a long name close to the word may be, by the name's length and the piece's number."""
    size = F.length(word)
    low = F.greatest(F.lit(SHORT + 1), size - _allowed(size, cutoff))
    lengths = F.when(low <= size + _most(size, cutoff), F.sequence(low, size + _most(size, cutoff))).otherwise(F.array().cast("array<int>"))

    def of_length(n: Column) -> Column:
        slips = _most(n, cutoff)
        return F.flatten(F.transform(F.sequence(F.lit(0), slips + 1), lambda i: F.transform(
            F.sequence(-slips, slips), lambda shift: F.struct(n.alias("n"), i.alias("i"), F.when(
                F.floor(i * n / (slips + 2)) + shift >= 0, F.substring(
                    word, (F.floor(i * n / (slips + 2)) + shift + 1).cast("int"),
                    (F.floor((i + 1) * n / (slips + 2)) - F.floor(i * n / (slips + 2))).cast("int"))).alias("piece")))))

    return F.flatten(F.transform(lengths, of_length))


def _edits(word: Column, name: Column) -> Column:
    """Inserted, dropped and changed letters; one swap of neighbours counts as one."""
    swapped = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.levenshtein(word, F.concat(
        F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.lit(1)), F.substring(name, i, F.lit(1)),
        F.substring(name, i + 2, F.length(name)))) + 1)
    return F.least(F.levenshtein(word, name), F.array_min(swapped))


def close_pairs(words: DataFrame, names: DataFrame, cutoff: float = CLOSE_ENOUGH) -> DataFrame:
    """(word, name, plain, score) for all pairs of rows (word) and (name, plain) at or above the cutoff."""
    name, word = F.col("plain"), F.col("word")
    limit = int(SHORT / cutoff + 1e-9)  # longer words are close to no short name
    sought = words.where(F.length(word) <= limit)
    lengths = [r[0] for r in sought.select(F.length(word)).distinct().collect()]  # at most ``limit`` numbers
    short = names.where(F.length(name).isin(_short_lengths(lengths, cutoff))).select(
        "name", "plain", F.explode(_keys(name, cutoff, SHORT)).alias("__key"))
    seeking = sought.select("word", F.explode(_keys(word, cutoff, limit)).alias("__key"))
    met = seeking.join(short, "__key").select("word", "name", "plain")
    long_ = names.where(F.length(name) > SHORT).select("name", "plain", F.explode(_pieces(name, cutoff)).alias("__key"))
    asked = words.select("word", F.explode(F.array_distinct(_probes(word, cutoff))).alias("__key")).where("__key.piece is not null")
    met = met.unionByName(asked.join(long_, "__key").select("word", "name", "plain")).distinct()
    score = 1 - _edits(word, name) / F.greatest(F.length(word), F.length(name))
    return met.withColumn("score", score).where(F.col("score") >= cutoff)


def closest_names(df: DataFrame, key: str, text: str, vocabulary: DataFrame, name: str, place: str,
                  cutoff: float = CLOSE_ENOUGH) -> DataFrame:
    """(key, name, position): the names closest to the words of each text, once each, by the word that used them first.

    A word takes its closest name, the one of the smallest ``place`` on a tie, if it reaches the cutoff.
    Every word is compared once, however often it is used.
    """
    used = df.select(col(key).alias("__key"), F.posexplode(tokens(col(text))).alias("__at", "word"))
    used = checkpointed(used.groupBy("__key", "word").agg(F.min("__at").alias("__at")))
    words = checkpointed(used.groupBy("word").agg(F.count(F.lit(1)).alias("__uses")))
    names = vocabulary.select(col(name).alias("name"), F.lower(col(name)).alias("plain"), col(place).alias("__place"))
    names = checkpointed(names.where("plain <> ''").groupBy("name", "plain").agg(F.min("__place").alias("__place")))
    pairs = close_pairs(words.select("word"), names.select("name", "plain"), cutoff).join(names.select("name", "__place"), "name")
    best = pairs.groupBy("word").agg(F.max_by("name", F.struct("score", -F.col("__place"))).alias("name"))
    known = attach(used, best.join(words, "word"), ["word"], "__uses")  # frequent words are hot keys
    return known.groupBy("__key", "name").agg(F.min("__at").alias("position")).withColumnRenamed("__key", key)


def _lookup(names: list[tuple[str, str]]):
    """Arrow batches of (key, plain text) to (key, name) for one share of the vocabulary."""
    def run(batches):
        import ahocorasick

        automaton, by_word = ahocorasick.Automaton(), {}
        for number, (_, plain) in enumerate(names):
            automaton.add_word(plain, automaton.get(plain, ()) + (number,))
            words = set(plain.split())
            if len(words) > 1:
                by_word.setdefault(max(words, key=len), []).append((number, words))
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for row, plain in enumerate(batch.column("plain").to_pylist()):
                hits = {number for _, numbers in automaton.iter(plain) for number in numbers}
                words = set(plain.split())
                for word in words & by_word.keys():
                    hits.update(number for number, wanted in by_word[word] if wanted <= words)
                at += [row] * len(hits)
                found += [names[number][0] for number in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["key", "name"])

    return run


def mentions(df: DataFrame, key: str, text: str, vocabulary: DataFrame, name: str, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(key, name) for the names that occur in a text whole, or with all their words apart.

    Names without letters or digits are never mentioned. A vocabulary of more than ``share_bytes`` is looked up in
    shares, each by a pass over the texts.
    """
    plain = normalize(col(name))
    names = vocabulary.select(col(name).cast("string").alias("name"), plain.alias("plain")).where("plain <> ''").distinct()
    names = checkpointed(names)
    size = names.agg(F.sum(F.octet_length("name") + F.octet_length("plain") + 64)).first()[0] or 0
    shares = max(1, -(-size // share_bytes))
    rows = df.select(col(key).alias("key"), F.coalesce(normalize(col(text)), F.lit("")).alias("plain"))
    found = None
    for share in range(shares):
        mine = [tuple(r) for r in names.where(F.pmod(F.xxhash64("name"), F.lit(shares)) == share).orderBy("name").collect()]
        part = rows.mapInArrow(_lookup(mine), f"key {type_of(df, key).simpleString()}, name string")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("key", key)
