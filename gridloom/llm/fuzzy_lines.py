"""Near-equal lines by MinHash.

Every non-blank line of every text, stripped of outer white space, is a set of character shingles. A
signature of minima under many permutations is cut into bands; lines that agree in a band are candidates.
Bands seen in one line alone are ruled out by a counting pass. Candidates are verified by their exact
Jaccard similarity, linked lines are joined by distributed union-find, and of every component the first
line (smallest doc_id, then place) stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.attach import broadcastable
from .common import byte_view, spans_of, stored, text_or_empty
from .graph import components
from .ngram_join import Threshold, connecting_links
from .shingles import mixed
from .token_classes import token_classes

SHINGLE = 8  # characters
FILLER = "\uffff"  # no character: fills a line shorter than a shingle, which so is one shingle
BANDS = 16
ROWS = 4  # of a band: a pair at similarity 0.8 is missed with probability (1 - 0.8 ** 4) ** 16 < 0.0003
STEP_CHARACTERS = 1 << 18
HASH_CHARACTERS, SIGN_SHINGLES = 1 << 16, 1 << 17  # hashed, and signed, at a time: temporary arrays stay in the cache
_RNG = np.random.default_rng(41)
_FLIPS = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32, endpoint=False)
_ODD = _RNG.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, stripped line) of the non-blank lines."""
    return [(i, s) for i, s in enumerate(line.strip() for line in text.split("\n")) if s]


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all lines, repeats included, and where each line's begin."""
    codes = np.frombuffer("".join([line.ljust(SHINGLE, FILLER) for line in lines]).encode("utf-32-le"), "<u4")
    sizes = np.maximum([len(line) for line in lines], SHINGLE)
    at = np.concatenate([[0], np.cumsum(sizes)])
    hashes = [_hashes(codes[at[a]:at[b]], sizes[a:b]) for a, b in spans_of(at, HASH_CHARACTERS)]
    counts = sizes - SHINGLE + 1
    return np.concatenate(hashes), np.cumsum(counts) - counts


def _hashes(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = codes * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    span = 1
    while span < SHINGLE:  # hashes of 1, 2, 4, 8 characters
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15) + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
    ends = np.cumsum(sizes)
    inside = np.ones(len(codes), bool)  # shingles that do not run over the end of their line
    inside[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    return mixed(h[inside[:len(h)]])


def band_keys(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(lines, BANDS) 64-bit keys of the bands of every line's signature."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    at = np.append(begins, len(x))
    minima = np.empty((BANDS * ROWS, len(begins)), np.uint32)
    for first, last in spans_of(at, SIGN_SHINGLES):
        some, spots = x[at[first]:at[last]], begins[first:last] - begins[first]
        held = np.empty_like(some)
        for k in range(BANDS * ROWS):
            np.bitwise_xor(some, _FLIPS[k], out=held)
            np.multiply(held, _ODD[k], out=held)
            np.minimum.reduceat(held, spots, out=minima[k, first:last])
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(begins), axis=1)
    for row in range(ROWS):
        key = mixed(key) + minima[row::ROWS]
    return np.ascontiguousarray(mixed(key).T)


LINE = "doc_id long, row_key long, line_no int, digest binary, bytes binary"


def _signed_lines(batches):
    def flush(held):
        hashes, begins = shingle_hashes([h[3] for h in held])
        keys = band_keys(hashes, begins)
        columns = [
            pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
            pa.array([h[2] for h in held], pa.int32()),
            pa.array([hashlib.blake2b(h[3].encode(), digest_size=16).digest() for h in held], pa.binary()),
            pa.array([k.tobytes() for k in keys], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "line_no", "digest", "bytes"])

    for batch in batches:
        held, size = [], 0
        for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
            for number, line in lines_of(text):
                held.append((doc, row, number, line))
                size += len(line)
                if size >= STEP_CHARACTERS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)


class BandSource:
    """The band keys of stored lines, for the counting pass."""

    def sets(self, data, at):
        yield data[at[0]:at[-1]].view(np.uint64)  # of all lines at once: a line has 16 keys, one of each band


def _shared_bands(maps, bits):
    def run(batches):
        several = maps.value[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = byte_view(batch.column("bytes"))
            keys = data[at[0]:at[-1]].view(np.uint64).reshape(-1, BANDS)
            spots = (keys >> np.uint64(64 - bits)).astype(np.int64)
            line, band = np.nonzero(several[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[line, band].astype(np.int64)), pa.array(batch.column("line_id").to_numpy()[line])],
                ["sig", "doc_id"])

    return run


def line_sets(column) -> list[np.ndarray]:
    """The sorted shingle hashes of lines, whose text is far smaller on its way than they."""
    lines = [line.decode() for line in column.to_pylist()]
    if not lines:
        return []
    hashes, begins = shingle_hashes(lines)
    at = [*begins.tolist(), len(hashes)]
    for a, b in zip(at, at[1:]):
        hashes[a:b].sort()
    new = np.empty(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    new[begins] = True
    hashes = hashes[new]
    at = np.cumsum(np.add.reduceat(new, begins, dtype=np.int64)).tolist()
    return [hashes[a:b] for a, b in zip([0, *at], at)]


def _wanted_lines(batches):
    for batch in batches:
        ids, found = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            lines = dict(lines_of(text))
            ids += [w["line_id"] for w in wanted]
            found += [lines[w["line_no"]].encode() for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "tokens"])


def _kept_text(batches):
    for batch in batches:
        out = []
        for text, kept in zip(batch.column("text").to_pylist(), batch.column("kept").to_pylist()):
            lines, kept = text.split("\n"), set(kept or ())
            stay = [line for i, line in enumerate(lines) if i in kept or not line.strip()]
            out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
        columns = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))],
            ["doc_id", "n_lines", "n_removed", "kept_text"])


def _named(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_text.

    Input: doc_id, text; other columns are ignored. Lines end at \\n. Blank lines stay. Of lines connected by
    a Jaccard similarity of ``percent`` / 100 or more between their sets of 8-character shingles (a shorter line is
    one shingle) the one with the smallest doc_id and number stays, equal lines in one document included.
    A null text is one empty line. A null doc_id counts as the largest. Repeated rows get the same result
    each. An empty table gives no rows.
    """
    threshold = Threshold(percent)
    signed = _named(docs).mapInArrow(_signed_lines, LINE)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key", "line_no")
    distinct = signed.groupBy("digest").agg(
        F.min(place).alias("first"), F.first("bytes").alias("bytes"))
    # Ids are given once, when the rows are written.
    lines = stored(distinct.select(F.monotonically_increasing_id().alias("line_id"), "first", "bytes"), "lines")
    count = lines.count()
    maps, bits = token_classes(lines.select("bytes"), BandSource(), count * BANDS, 1 << 30)
    sigs = stored(lines.select("line_id", "bytes").mapInArrow(_shared_bands(maps, bits), "sig long, doc_id long"), "bands")
    sigs = sigs.withColumn("n", F.lit(1))  # lines are not told apart by size before they are compared

    def sets(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.col("doc_id").alias("__id")).distinct()
        spots = lines.select("line_id", "first").join(wanted, F.col("line_id") == F.col("__id"), "left_semi")
        by_doc = spots.groupBy(F.col("first.doc_id").alias("__doc"), F.col("first.row_key").alias("__row")).agg(
            F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "line_id")).alias("wanted"))
        by_doc = stored(by_doc, "wanted-lines")
        side = F.broadcast(by_doc) if broadcastable(by_doc.select("__doc", "__row", F.size("wanted").alias("n"))) else by_doc
        same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row_key") == F.col("__row"))
        found = _named(docs).join(side, same).select("text", "wanted").mapInArrow(_wanted_lines, "doc_id long, tokens binary")
        return found.dropDuplicates(["doc_id"])

    links = connecting_links(sigs, sets, threshold, line_sets)
    joined = components(links)
    grouped = lines.select("line_id", "first").join(joined, F.col("line_id") == F.col("node"), "left").select(
        "first", "component")
    # Lines without a link stay; of a component the first place does.
    alone = grouped.where("component is null").select("first")
    leading = grouped.where("component is not null").groupBy("component").agg(F.min("first").alias("first")).select("first")
    kept = alone.unionByName(leading).select("first.*").groupBy(
        F.col("doc_id").alias("__doc"), F.col("row_key").alias("__row")).agg(F.collect_list("line_no").alias("kept"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row_key") == F.col("__row"))
    return _named(docs).join(kept, same, "left").select("doc_id", "text", "kept").mapInArrow(
        _kept_text, "doc_id long, n_lines long, n_removed long, kept_text string")


def query(spark, directory):
    found = dedup_lines(spark.read.parquet(f"{directory}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
