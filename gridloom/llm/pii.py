"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base matches are the seeds. The words around them are lexical patterns (left word, two left words, right
word, both sides). Other strings of an identifier's shape (an address with "(at)", a number without its
plus, ...) are candidates. Patterns and instances (distinct values) form a bipartite graph, on which
Spark scores both sides in turn: a pattern by the mean score of the instances it surrounds, an
instance by the patterns around it. A string of a base shape that fails its check keeps score 0 and tells
against the patterns around it. Candidates inside patterns of high confidence are reported too.
"""

from __future__ import annotations

import re
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.attach import attach
from .common import stored, text_or_empty

# Kinds in the order of the result, and the shapes of their base matches.
KINDS = ("email", "ip", "card", "phone")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser shapes of candidates.
LOOSE = (
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]+)*"),
    re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])"),
    re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])"),
    re.compile(r"(?<![0-9])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
HINTS = (re.compile(r"@|\(at\)|\[at\]"), re.compile(":"), re.compile("[0-9]"), re.compile("[0-9]"))
WINDOW = 64  # characters in which context words are looked for

ROUNDS = 3
LEAST_SCORE = 0.8
LEAST_SEEDS = 5  # different seed values a pattern must surround
PATTERN_SHARE = 20_000  # strong patterns looked up in one pass over the texts
PRIOR = 1.0  # instances of score 0 that every pattern is taken to surround besides its own

ITEM = pa.struct([
    ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("failed", pa.bool_()), ("value", pa.string()),
    ("left", pa.string()), ("before", pa.string()), ("right", pa.string())])
ITEM_SQL = "struct<kind:int,start:int,end:int,base:boolean,failed:boolean,value:string,left:string,before:string,right:string>"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        if place % 2:
            digit = digit * 2 - 9 * (digit > 4)
        total += digit
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches without overlap: around every @, the run of local characters before it, the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base matches that hold, and of those that fail their check."""
    found = [(0, *span) for span in emails(text)] if "@" in text else []
    failed = []

    def judge(kind, m, holds):
        (found if holds else failed).append((kind, *m.span()))

    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        judge(1, m, all(len(p) <= 3 and int(p) <= 255 for p in parts))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            judge(2, m, 13 <= len(digits) <= 19 and luhn(digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            judge(3, m, 9 <= sum(c.isdigit() for c in m.group()) <= 15)
    return found, failed


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates, outside the base matches and one another; an earlier kind wins. Linear in the matches, after one sort."""
    found: list[tuple[int, int, int]] = []
    busy = sorted((s, e) for _, s, e in taken)
    for kind, (hint, shape) in enumerate(zip(HINTS, LOOSE)):
        if not hint.search(text):
            continue
        free, at, reach = [], 0, 0  # matches rise, and reach is the furthest end of a span that begins before one's end
        for m in shape.finditer(text):
            start, end = m.span()
            while at < len(busy) and busy[at][0] < end:
                reach = max(reach, busy[at][1])
                at += 1
            if reach <= start:
                free.append((start, end))
        found += [(kind, *span) for span in free]
        busy = list(merge(busy, free))
    return found


def _holds(kind: int, value: str) -> bool:
    return kind != 2 or luhn("".join(c for c in value if c.isdigit()))


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    before = text[max(0, start - WINDOW):start].lower().split()[-2:]
    after = text[end:end + WINDOW].lower().split()[:1]
    return (before[-1] if before else ""), (" ".join(before) if len(before) > 1 else ""), (after[0] if after else "")


def _items(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base, failed = base_spans(text)
            loose = loose_spans(text, base + failed)
            wrong = [x for x in loose if not _holds(x[0], text[x[1]:x[2]])]
            failed += wrong
            wrong = set(wrong)
            rows.append([
                {"kind": k, "start": s, "end": e, "base": spans is base, "failed": spans is failed,
                 "value": text[s:e].lower(), **dict(zip(("left", "before", "right"), _context(text, s, e)))}
                for spans in (base, failed, [x for x in loose if x not in wrong]) for k, s, e in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(rows, pa.list_(ITEM))], ["doc_id", "text_key", "items"])


def _patterns():
    """The lexical patterns of an occurrence, each with its kind in front; empty sides make none."""
    made = [
        F.when(F.col("left") != "", F.concat_ws("\u0001", "kind", F.lit("L"), "left")),
        F.when(F.col("before") != "", F.concat_ws("\u0001", "kind", F.lit("LL"), "before")),
        F.when(F.col("right") != "", F.concat_ws("\u0001", "kind", F.lit("R"), "right")),
        F.when((F.col("left") != "") & (F.col("right") != ""), F.concat_ws("\u0001", "kind", F.lit("LR"), "left", "right")),
    ]
    return F.filter(F.array(*made), lambda p: p.isNotNull())


def pattern_scores(items: DataFrame) -> DataFrame:
    """Rows (pattern, score, seeds) after the last round over the graph of patterns and instances."""
    edges = items.select("kind", "value", "base", "failed", F.explode(_patterns()).alias("pattern"))
    # One edge per pattern and distinct instance; an instance that is a seed anywhere is one everywhere.
    edges = stored(edges.groupBy("kind", "value", "pattern").agg(
        F.max("base").alias("seed"), F.max("failed").alias("failed")), "pattern-edges")
    degree = F.count(F.lit(1)).alias("degree")
    instances = edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("worth"), degree)
    for last in range(ROUNDS):
        # A value with very many patterns, or a pattern around very many values, is a hot key: attach spreads both.
        scores = attach(edges, instances, ["kind", "value"], "degree").groupBy("pattern").agg(
            (F.sum("worth") / (F.count(F.lit(1)) + PRIOR)).alias("score"),
            F.sum(F.col("seed").cast("long")).alias("seeds"), F.count(F.lit(1)).alias("instances"))
        scores = stored(scores, "patterns")
        if last < ROUNDS - 1:
            # Noisy or over the supported patterns around an instance; seeds keep 1.
            heard = F.when(F.col("seeds") >= LEAST_SEEDS, F.col("score")).otherwise(0.0)
            around = attach(edges, scores, ["pattern"], "instances")
            joint = 1 - F.exp(F.sum(F.log(1 - F.least(heard, F.lit(0.999)))))
            instances = around.groupBy("kind", "value").agg(
                F.when(F.max("seed"), 1.0).when(F.max("failed"), 0.0).otherwise(joint).alias("worth"), degree)
    return scores


def _slots(patterns: list[str]):
    """Arrow batches of texts to (pattern, slots): how often the context of each pattern occurs, whatever it surrounds."""
    def run(batches):
        wanted: dict = {}
        for pattern in patterns:
            _, side, *words = pattern.split("\u0001")
            wanted.setdefault((side, *words), []).append(pattern)
        left = {k[1] for k in wanted if k[0] in ("L", "LR")} | {k[1].rsplit(" ", 1)[-1] for k in wanted if k[0] == "LL"}
        right = {k[1] for k in wanted if k[0] == "R"}
        counts: dict = dict.fromkeys(wanted, 0)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                if len(words) < 2 or (left.isdisjoint(words) and right.isdisjoint(words)):
                    continue
                last = len(words) - 1
                for i, word in enumerate(words):
                    if word in left and i < last:
                        keys = [("L", word), ("LL", f"{words[i - 1]} {word}")] if i else [("L", word)]
                        keys += [("LR", word, words[i + 2])] if i + 1 < last else []
                        for key in keys:
                            if key in counts:
                                counts[key] += 1
                    if i and word in right:
                        counts["R", word] += 1
        rows = [(pattern, n) for key, n in counts.items() for pattern in wanted[key] if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["pattern", "slots"])

    return run


def specific_patterns(texts: DataFrame, items: DataFrame, strong: DataFrame) -> DataFrame:
    """The strong patterns whose context seldom occurs without an identifier: a common word surrounds anything.

    Of all places of a pattern in the whole texts, those held by candidates aside, at least ``LEAST_SCORE`` must hold a
    base match. Patterns are looked up in shares of bounded size, each by a pass over the texts.
    """
    strong = stored(strong, "strong")
    shares = max(1, -(-strong.count() // PATTERN_SHARE))
    counted = None
    for share in range(shares):
        mine = [r[0] for r in strong.where(F.pmod(F.xxhash64("pattern"), F.lit(shares)) == share).select("pattern").collect()]
        part = texts.select("text").mapInArrow(_slots(mine), "pattern string, slots long")
        counted = part if counted is None else counted.unionByName(part)
    slots = counted.groupBy(F.col("pattern").alias("__s")).agg(F.sum("slots").alias("slots"))
    held = items.withColumn("pattern", F.explode(_patterns())).groupBy(F.col("pattern").alias("__h")).agg(
        F.count_if(F.col("base")).alias("hits"), F.count_if(~F.col("base") & ~F.col("failed")).alias("open"), F.count(F.lit(1)).alias("all"))
    rated = strong.join(held, F.col("pattern") == F.col("__h")).join(slots, F.col("pattern") == F.col("__s"), "left")
    # An identifier of several words is no one-word slot, so there are at least as many places as matches.
    places = F.greatest(F.coalesce("slots", F.lit(0)), F.col("all"))
    return rated.where(F.col("hits") >= LEAST_SCORE * (places - F.col("open") + PRIOR)).select("pattern", "instances")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    Input: doc_id, text; other columns are ignored. A null text counts as empty and has no spans. Counts
    and base_sha256 are of the base matches; ``spans`` lists them and the discovered ones (n_found of them)
    as kind:start:end in code points, by kind and start. Repeated rows get the same result each. An empty
    table gives no rows.
    """
    text = text_or_empty()
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_key"), text.alias("text"))
    found = stored(rows.mapInArrow(_items, f"doc_id long, text_key string, items array<{ITEM_SQL}>"), "identifiers")
    items = found.select("doc_id", "text_key", F.explode("items").alias("__item")).select("doc_id", "text_key", "__item.*")
    strong = pattern_scores(items).where((F.col("score") >= LEAST_SCORE) & (F.col("seeds") >= LEAST_SEEDS))
    strong = specific_patterns(rows, items, strong)
    loose = items.where("not base and not failed").withColumn("pattern", F.explode(_patterns()))
    new = attach(loose, strong, ["pattern"], "instances").select("doc_id", "text_key", "kind", "start", "end").distinct().groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("__new"))  # bounded by one document
    new = new.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    known = F.transform(F.filter("items", lambda i: i["base"]), lambda i: F.struct(i["kind"], i["start"], i["end"]))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    joined = found.join(new, same, "left").select(
        "doc_id", known.alias("__base"), F.coalesce(F.col("__new"), none).alias("__new"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans):
        return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return joined.select(
        "doc_id", *counts, F.sha2(written(F.col("__base")), 256).alias("base_sha256"),
        written(F.concat("__base", "__new")).alias("spans"), F.size("__new").cast("long").alias("n_found"))


def query(spark, directory):
    return find_pii(spark.read.parquet(f"{directory}/documents.parquet"))
