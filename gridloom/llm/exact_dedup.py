"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks. A chunk's hash is its polynomial value for four bases modulo a prime; the
hash of the whole is the sum of the chunk hashes, each multiplied by base^(bytes after the chunk). So the
chunks of one huge document are hashed apart and put together by one small sum. Texts with equal length
and fingerprint are then compared chunk by chunk; a class that holds different texts is split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.attach import attach, broadcastable
from .common import as_rows, byte_view, lean, spans_of, stored, text_bytes

PRIME = 2**31 - 1
BASES = (1_103_515_245, 1_664_525_019, 742_938_285, 950_706_376)  # any four values below the prime
WIDTH = 256  # bytes per row of the hash matrix: 255 * 2^31 * 256 stays exact in a double
STEP_BYTES = 1 << 21
HASHES = ["h1", "h2", "h3", "h4"]


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    value = 1
    for i in range(count):
        out[i] = value
        value = value * base % PRIME
    return out


def polynomial_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Four polynomial hashes of every text ``data[at[i]:at[i + 1]]``.

    Texts are padded with zeros in front, which does not change the value of the polynomial.
    """
    count = len(at) - 1
    result = np.zeros((count, len(BASES)), np.uint64)
    inside = np.stack([_powers(b, WIDTH)[::-1] for b in BASES], axis=1).astype(np.float64)
    longest = int(np.max(np.diff(at))) if count else 0
    steps = [_powers(pow(b, WIDTH, PRIME), longest // WIDTH + 2) for b in BASES]
    for first, last in spans_of(at, STEP_BYTES):
        sizes = np.diff(at[first:last + 1])
        rows = np.maximum(1, -(-sizes // WIDTH))
        ends = np.cumsum(rows)
        padded = np.zeros(int(ends[-1]) * WIDTH, np.uint8)
        for i in range(last - first):
            if sizes[i]:
                stop = int(ends[i]) * WIDTH
                padded[stop - int(sizes[i]):stop] = data[at[first + i]:at[first + i + 1]]
        values = (padded.reshape(-1, WIDTH).astype(np.float64) @ inside).astype(np.uint64) % PRIME
        after = np.repeat(ends, rows) - 1 - np.arange(int(ends[-1]))
        for k in range(len(BASES)):
            terms = values[:, k] * steps[k][after] % PRIME
            result[first:last, k] = np.add.reduceat(terms, ends - rows) % PRIME
    return result


def _hash_chunks(batches):
    for batch in batches:
        data, at = byte_view(batch.column("chunk"))
        hashes = polynomial_hashes(data, at)
        after = batch.column("after").to_numpy()
        for i in np.flatnonzero(after):
            for k, base in enumerate(BASES):
                hashes[i, k] = int(hashes[i, k]) * pow(base, int(after[i]), PRIME) % PRIME
        columns = [batch.column(c) for c in ("doc_id", "text_sha256", "n_bytes", "chunk_no")]
        columns += [pa.array(hashes[:, k].astype(np.int64)) for k in range(len(BASES))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "n_bytes", "chunk_no", *HASHES])


def _chunks(docs: DataFrame, chunk_bytes: int, *extra) -> DataFrame:
    size = F.octet_length("__bytes").cast("long")
    whole = docs.select(col("doc_id"), text_bytes().alias("__bytes"))
    numbered = whole.select(
        "doc_id", *extra, size.alias("n_bytes"), "__bytes",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / chunk_bytes)).cast("int"))).alias("chunk_no"),
    )
    return numbered.select(
        *[c for c in numbered.columns if c != "__bytes"],
        F.greatest(F.lit(0), F.col("n_bytes") - (F.col("chunk_no") + 1) * chunk_bytes).cast("long").alias("after"),
        F.expr(f"substring(__bytes, chunk_no * {chunk_bytes} + 1, {chunk_bytes})").alias("chunk"),
    )


def fingerprints(docs: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """One row per (doc_id, text): length, four hashes, SHA-256 and the number of input rows alike in both."""
    hashed = _chunks(docs, chunk_bytes, F.sha2("__bytes", 256).alias("text_sha256")).mapInArrow(
        lean(_hash_chunks),
        "doc_id long, text_sha256 string, n_bytes long, chunk_no int, " + ", ".join(f"{h} long" for h in HASHES),
    )
    copies = F.sum((F.col("chunk_no") == 0).cast("long"))
    # Rows alike in doc_id and text add equal hashes, so the sum divided by their number is one row's sum.
    return hashed.groupBy("doc_id", "text_sha256", "n_bytes").agg(
        copies.alias("copies"),
        *[(F.expr(f"sum({h}) div sum(cast(chunk_no = 0 as long))") % PRIME).alias(h) for h in HASHES],
    )


def _differing(docs: DataFrame, members: DataFrame, chunk_bytes: int) -> DataFrame:
    """Classes in which some chunk is not the same in all members. Copies shrink to one per task on the way."""
    wanted = members.select(
        F.col("doc_id").alias("__id"), F.col("n_bytes").alias("__n"), F.col("class_id").alias("__class")
    ).distinct()
    if broadcastable(wanted):
        wanted = F.broadcast(wanted)
    chunks = _chunks(docs, chunk_bytes)
    same = (chunks["n_bytes"] == wanted["__n"]) & chunks["doc_id"].eqNullSafe(wanted["__id"])
    compared = chunks.join(wanted, same).groupBy("__class", "chunk_no").agg(
        (F.min("chunk") == F.max("chunk")).alias("same")
    )
    return compared.where(~F.col("same")).select(F.col("__class").alias("class_id")).distinct()


def exact_groups(docs: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Group documents with the same text; the row with the largest doc_id of a group stays.

    Input: doc_id, text; other columns are ignored. Output, one row per input row: doc_id, keep_id,
    group_size, kept, text_sha256, n_bytes. A null text counts as empty; empty texts form one group. Rows
    alike in doc_id and text are counted each and all carry the same flags. A null doc_id loses against
    any other and stays null; its row is kept if its group holds no other. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, chunk_bytes), "fingerprints")
    rows = rows.withColumn("class_id", F.concat_ws("-", "n_bytes", *HASHES))
    sizes = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("__texts"), F.sum("copies").alias("__rows"))
    several = sizes.where("__texts > 1").drop("__texts")
    members = stored(
        attach(rows.select("doc_id", "n_bytes", "class_id"), several, ["class_id"], "__rows").drop("__rows"),
        "equal-fingerprints",
    )
    differing = stored(_differing(docs, members, chunk_bytes), "differing")
    if not differing.isEmpty():  # unequal texts met in one fingerprint: their digests tell them apart
        odd = rows.join(differing, "class_id", "left_semi").withColumn(
            "class_id", F.concat_ws("-", "class_id", "text_sha256"))
        rows = rows.join(differing, "class_id", "left_anti").unionByName(odd)
    groups = rows.groupBy("class_id").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    found = attach(rows, groups, ["class_id"], "group_size")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", "n_bytes",
    )


def drop_exact_duplicates(docs: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The rows that stay, with all their columns; of rows alike in doc_id and text one stays."""
    kept = exact_groups(docs, chunk_bytes).where("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest")).distinct()
    rows = as_rows(docs, id=col("doc_id"), digest=F.sha2(text_bytes(), 256))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")


SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256, strlen(coalesce(text, '')) as n_bytes
from documents"""


def query(spark, directory):
    return exact_groups(spark.read.parquet(f"{directory}/documents.parquet"))
