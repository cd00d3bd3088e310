"""Near duplicates by an exact Jaccard join with token-combination prefixes.

A document is its set of word shingles (tokens). All tokens are ordered by class (seen once, rare,
frequent) and hash. A document that links with another misses at most ``slack`` of its tokens there, so a
prefix of its tokens, rarest first, must hold a common signature: every rare token is one alone; a frequent
token is one only together with a second one of its subclass, for which the prefix is extended until the
signatures it holds outnumber the slack. Tokens seen once use up slack and need no signature.

Documents with a common signature are verified on their full sets. Small signature groups give
pairs; documents of crowded groups are gathered into clusters, whose members are compared in blocks of
similar size inside the tasks, which return no more links than members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.attach import attach, broadcastable
from .common import as_rows, byte_view, lean, stored, text_bytes
from .graph import components, local_roots
from .shingles import Shingler, mixed
from .token_classes import token_classes
from .tokens import release

FREQUENT = 64  # documents from which a token is frequent
PLAIN = 20  # sets up to this size use single tokens only
CROWDED = 64  # documents from which a signature group is not paired off
BLOCK_ROWS = 256


class Threshold:
    """Jaccard similarity of at least ``percent`` / 100, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def least_common(self, n):
        """Tokens that any partner shares at least with a set of n."""
        return -(-self.percent * n // 100)

    def slack(self, n):
        return n - self.least_common(n)

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def linked(self, common, n, m):
        return 100 * common >= self.percent * (n + m - common)


def _summaries(words: int):
    def run(batches):
        release()
        shingler = Shingler(words)
        for batch in batches:
            data, at = byte_view(batch.column("bytes"))
            sums = [[len(s), *(int(mixed(s, salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (1, 2))]
                    for s in shingler.sets(data, at)]
            columns = np.array(sums, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in columns)], ["doc_id", "n_shingles", "f1", "f2"])

    return run


def _level(slack: int) -> int:
    return max(0, math.ceil(math.log2(slack + 1)))


def signatures(tokens: np.ndarray, several: np.ndarray, many: np.ndarray, threshold: Threshold) -> np.ndarray:
    """The signatures of one set; two linked sets have one in common."""
    n = len(tokens)
    need = int(threshold.slack(n)) + 1
    order = np.lexsort((tokens, many, several))
    tokens, several, many = tokens[order], several[order], many[order]
    once = int(np.searchsorted(several, 1))
    if once >= need:
        return np.zeros(0, np.uint64)
    out = []
    if n <= threshold.largest_partner(PLAIN):
        out.append(mixed(tokens[once:need], 11))
    if n > PLAIN:
        common = int(np.searchsorted(many, 1))
        out.append(mixed(tokens[once:min(common, need)], 12))
        short = need - common
        if short > 0:
            often = tokens[common:]
            levels = {_level(int(threshold.slack(m))) for m in (n, threshold.largest_partner(n))}
            for level in range(min(levels), max(levels) + 1):
                classes = max(1, (1 << level) // 4)
                sub = mixed(often, 13) % np.uint64(classes)
                _, first = np.unique(sub, return_index=True)
                gain = np.ones(len(often), np.int64)
                gain[first] = 0
                reach = int(np.searchsorted(np.cumsum(gain), short)) + 1
                held, group = often[:reach], sub[:reach]
                by = np.lexsort((held, group))
                held, group = held[by], group[by]
                for gap in range(1, len(held)):
                    pairs = group[gap:] == group[:-gap]
                    if not pairs.any():
                        break
                    out.append(mixed(mixed(held[:-gap][pairs], 14 + level) + held[gap:][pairs], 15))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _signature_rows(words: int, maps, bits: int, threshold: Threshold):
    def run(batches):
        shingler, (several, many) = Shingler(words), maps.value

        def look_up(bitmap, spots):
            return bitmap[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8) & 1

        for batch in batches:
            ids, sizes, rows = [], [], []
            docs = batch.column("doc_id").to_pylist()
            for doc_id, tokens in zip(docs, shingler.sets(*byte_view(batch.column("bytes")))):
                if not len(tokens):
                    continue
                spots = (tokens >> np.uint64(64 - bits)).astype(np.int64)
                found = signatures(tokens, look_up(several, spots), look_up(many, spots), threshold)
                rows.append(found)
                ids.append(np.full(len(found), doc_id, np.int64))
                sizes.append(np.full(len(found), len(tokens), np.int32))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rows).astype(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes))],
                    ["sig", "doc_id", "n"])

    return run


def _pairs_of_groups(threshold: Threshold):
    """Rows (sig, doc_id, n) sorted by sig become distinct pairs of documents of compatible sizes."""
    def pairs(sig, doc, n):
        begins = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.append(begins, len(sig)))
        a, b = [], []
        for size in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(size, 1)
            some = begins[sizes == size, None]
            a.append((some + i).ravel())
            b.append((some + j).ravel())
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        fits = (100 * low >= threshold.percent * high) & (doc[a] != doc[b])
        found = np.unique(np.stack([np.minimum(doc[a], doc[b])[fits], np.maximum(doc[a], doc[b])[fits]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    def run(batches):
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            rest = [np.concatenate([r, batch.column(c).to_numpy().astype(np.int64)]) for r, c in zip(rest, ("sig", "doc_id", "n"))]
            if not len(rest[0]):
                continue
            cut = int(np.searchsorted(rest[0], rest[0][-1]))
            found = pairs(*(r[:cut] for r in rest)) if cut else None
            rest = [r[cut:] for r in rest]
            if found is not None:
                yield found
        found = pairs(*rest) if len(rest[0]) else None
        if found is not None:
            yield found

    return run


def _set_rows(words: int):
    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            sets = [s.tobytes() for s in shingler.sets(*byte_view(batch.column("bytes")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "tokens"])

    return run


def stored_tokens(column) -> list[np.ndarray]:
    """The sets of a column of stored tokens, copied, as the batch they lie in may go."""
    data, at = byte_view(column)
    return [np.frombuffer(data[a:b].tobytes(), np.uint64) for a, b in zip(at[:-1], at[1:])]


def _verify(threshold: Threshold, decode):
    """Rows (a, b, tokens) sorted by a: those without b hold the sets of a, the others those of partners."""
    def run(batches):
        hub, sets = None, []
        for batch in batches:
            left, right = [], []
            decoded = decode(batch.column("tokens"))
            for a, b, tokens in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), decoded):
                if a != hub:
                    hub, sets = a, []
                if b is None:
                    sets.append(tokens)
                    continue
                for own in sets:
                    if not threshold.linked(min(len(own), len(tokens)), len(own), len(tokens)):
                        continue
                    spot = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                    if threshold.linked(int((own[spot] == tokens).sum()), len(own), len(tokens)):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _common(sets: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens, every set against every other, by products of incidence matrices."""
    both = sets + other
    values, spots = np.unique(np.concatenate(both), return_inverse=True)
    rows = np.repeat(np.arange(len(both)), [len(s) for s in both])
    several = np.flatnonzero(np.bincount(spots, minlength=len(values)) > 1)
    renamed = np.full(len(values), -1, np.int64)
    renamed[several] = np.arange(len(several))
    spots = renamed[spots]
    order = np.argsort(spots, kind="stable")
    spots, rows = spots[order], rows[order]
    counts = np.zeros((len(sets), len(other)), np.float32)
    for first in range(0, len(several), 4096):
        a, b = np.searchsorted(spots, [first, first + 4096])
        here = np.zeros((len(both), min(4096, len(several) - first)), np.float32)
        here[rows[a:b], spots[a:b] - first] = 1
        counts += here[:len(sets)] @ here[len(sets):].T
    return counts.astype(np.int64)


BLOCK_KEY = ["cluster", "size_class", "step", "p", "q"]


def _verify_blocks(threshold: Threshold, decode):
    """Rows sorted by block pair: (key, side, doc_id, tokens); returns a forest of the links."""
    def links(rows):
        left = [r for r in rows if r[0] < 1]
        right = [r for r in rows if r[0] == 1] if rows[0][0] >= 0 else left
        if not left or not right:
            return None
        ids, others = np.array([r[1] for r in left]), np.array([r[1] for r in right])
        sets, partners = [r[2] for r in left], [r[2] for r in right]
        n, m = (np.array([len(s) for s in x]) for x in (sets, partners))
        i, j = np.nonzero(threshold.linked(_common(sets, partners), n[:, None], m[None, :]))
        node, root = local_roots(ids[i], others[j]) if len(i) else (ids[:0], ids[:0])
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in BLOCK_KEY))
            decoded = decode(batch.column("tokens"))
            for k, side, doc, tokens in zip(keys, *(batch.column(c).to_pylist() for c in ("side", "doc_id")), decoded):
                if k != key and rows:
                    found = links(rows)
                    rows = []
                    if found is not None:
                        yield found
                key = k
                rows.append((side, doc, tokens))
        found = links(rows) if rows else None
        if found is not None:
            yield found

    return run


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, bytes) of the documents whose id is in ``ids``; broadcast after measuring, else shuffled."""
    ids = stored(ids.select(F.col("doc_id").alias("__id")).distinct(), "chosen")
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"))
    side = F.broadcast(ids) if broadcastable(ids) else ids
    return rows.join(side, F.col("doc_id") == F.col("__id"), "left_semi")


def _blocks(members: DataFrame, threshold: Threshold) -> DataFrame:
    """Rows (cluster, doc_id, n) with every block pair they take part in.

    Blocks hold at most about BLOCK_ROWS members of one size class; linked sets are in the same class or in
    neighbouring ones, as a class spans the largest possible ratio of their sizes.
    """
    ratio = math.log(100 / threshold.percent) if threshold.percent < 100 else 1.0
    members = members.withColumn("size_class", F.floor(F.log(F.col("n")) / ratio + 1e-9).cast("int"))
    counts = stored(members.groupBy("cluster", "size_class").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "size-classes")
    for name, shift in (("own", 0), ("next", 1), ("last", -1)):
        side = counts.select(
            F.col("cluster").alias("__c"), (F.col("size_class") - shift).alias("__j"), F.col("blocks").alias(name))
        side = F.broadcast(side) if broadcastable(side) else side
        members = members.join(side, (F.col("cluster") == F.col("__c")) & (F.col("size_class") == F.col("__j")), "left").drop("__c", "__j")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("own")).cast("int")
    def to(count):
        return F.when(count.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), count - 1))

    def place(step, klass, p, q, side):
        return F.struct(
            klass.alias("size_class"), F.lit(step).alias("step"), p.cast("int").alias("p"), q.cast("int").alias("q"),
            side.cast("int").alias("side"))

    here = F.transform(to(F.col("own")), lambda j: place(
        0, F.col("size_class"), F.least(j, mine), F.greatest(j, mine),
        F.when(j == mine, -1).when(mine < j, 0).otherwise(1)))
    up = F.transform(to(F.col("next")), lambda j: place(1, F.col("size_class"), mine, j, F.lit(0)))
    down = F.transform(to(F.col("last")), lambda j: place(1, F.col("size_class") - 1, j, mine, F.lit(1)))
    return members.select("cluster", "doc_id", F.explode(F.concat(here, up, down)).alias("__part")).select(
        "cluster", "doc_id", "__part.*")


def connecting_links(sigs: DataFrame, sets_of, threshold: Threshold, decode=stored_tokens) -> DataFrame:
    """Links (a, b) that connect all similar sets among the candidates.

    ``sigs`` holds rows (sig, doc_id, n): two sets of sizes n are candidates if they share a sig. ``sets_of`` gives
    for a frame of doc_id the rows (doc_id, tokens); ``decode`` turns a column of such bytes into sorted sets.
    """
    groups = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("hub")).where("docs > 1")
    placed = stored(attach(sigs, groups, ["sig"], "docs"), "signature-groups")
    few = placed.where(F.col("docs") <= CROWDED).repartition("sig").sortWithinPartitions("sig")
    pairs = stored(few.select("sig", "doc_id", "n").mapInArrow(lean(_pairs_of_groups(threshold)), "a long, b long").distinct(), "pairs")
    crowd = stored(placed.where(F.col("docs") > CROWDED).select("doc_id", "n", "hub").distinct(), "crowd")
    clusters = components(crowd.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    members = crowd.select("doc_id", "n").distinct().join(clusters, F.col("doc_id") == F.col("node")).select(
        F.col("component").alias("cluster"), "doc_id", "n")
    members = stored(members, "clusters")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(
        members.select("doc_id"))
    held = stored(sets_of(wanted), "token-sets").select(F.col("doc_id").alias("__id"), "tokens")
    hubs = pairs.select("a").distinct().join(held, F.col("a") == F.col("__id")).select(
        "a", F.lit(None).cast("long").alias("b"), "tokens")
    partners = pairs.join(held, F.col("b") == F.col("__id")).select("a", "b", "tokens")
    verified = hubs.unionByName(partners).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first()).mapInArrow(
        lean(_verify(threshold, decode)), "a long, b long")
    blocks = _blocks(members, threshold).join(held, F.col("doc_id") == F.col("__id")).drop("__id")
    crowded = blocks.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).select(
        *BLOCK_KEY, "side", "doc_id", "tokens").mapInArrow(lean(_verify_blocks(threshold, decode)), "a long, b long")
    return stored(verified.unionByName(crowded), "links")


def near_links(docs: DataFrame, ids: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) among the documents of ``ids`` (doc_id, n_shingles) that connect all that are similar."""
    threshold = Threshold(percent)
    texts = _chosen(docs, ids)
    tokens = ids.agg(F.sum("n_shingles")).first()[0] or 0
    maps, bits = token_classes(texts, Shingler(words), tokens, FREQUENT)
    sigs = stored(
        texts.mapInArrow(lean(_signature_rows(words, maps, bits, threshold)), "sig long, doc_id long, n int"), "signatures")
    maps.unpersist()

    def sets(wanted: DataFrame) -> DataFrame:
        return _chosen(docs, wanted).mapInArrow(lean(_set_rows(words)), "doc_id long, tokens binary")

    return connecting_links(sigs, sets, threshold)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Input: doc_id, text; other columns are ignored. Words are runs of bytes other than space and
    \\t to \\r, with A-Z in lower case. Two sets link if their Jaccard similarity is at least ``percent`` / 100. A null
    text or one without words has an empty set, which links with nothing, not even another empty one.
    Equal sets are collapsed first. Sets are compared as sets of 64-bit hashes. doc_id names a document: rows
    that share it are in one component; a null doc_id has a null component. An empty table gives no rows.
    """
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"))
    sums = stored(rows.mapInArrow(lean(_summaries(words)), "doc_id long, n_shingles long, f1 long, f2 long"), "set-sums")
    alike = sums.where("n_shingles > 0 and doc_id is not null")
    keys = ["n_shingles", "f1", "f2"]
    classes = stored(alike.groupBy(*keys).agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("rows")), "equal-sets")
    ids = classes.select(F.col("hub").alias("doc_id"), "n_shingles")
    links = near_links(docs, ids, words, percent)
    named = attach(alike, classes, keys, "rows").select("doc_id", "hub").distinct()
    joined = components(links.unionByName(named.select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))))
    found = sums.join(joined, F.col("doc_id") == F.col("node"), "left")
    return found.select(
        "doc_id", "n_shingles", F.coalesce(F.col("component"), F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of every component, with all its columns.

    Documents without words or without doc_id stay. Of rows that share a doc_id all stay or go.
    """
    leave = near_duplicates(docs, words, percent).where("doc_id <> component_id").select(
        F.col("doc_id").alias("__id")).distinct()
    rows = as_rows(docs, id=col("doc_id"))
    return rows.join(leave, F.col("id") == F.col("__id"), "left_anti").select("row.*")


def query(spark, directory):
    return near_duplicates(spark.read.parquet(f"{directory}/documents.parquet"), words=4, percent=85)


SQL = """
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
    select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d
), n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
pairs as materialized (
    select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)
), reach(doc_id, other) as (
    select a, b from pairs union select r.doc_id, p.b from reach r join pairs p on r.other = p.a
), low as (select doc_id, min(other) as low from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id
from documents left join n using (doc_id) left join low using (doc_id)"""
