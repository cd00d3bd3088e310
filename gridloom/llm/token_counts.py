"""Token counts through a cache of content digests.

Digests of the content as it is, not normalised, and of the tokenizer's file are joined to stored counts. Only contents that
the cache does not hold are encoded, once each, and their counts are appended to the cache.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import scratch_path
from .common import text_or_empty
from .tokens import encoder, file_digest

LIMIT = 2048
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


def _count(path: str):
    def run(batches):
        words = encoder(path, spaced=False, count_only=True)
        for batch in batches:
            counts = pa.array(words.encode_column(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], ["digest", "n_tokens"])

    return run


def read_cache(spark, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; no folder yet means none. Counts stored twice show once."""
    try:
        held = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        held = spark.createDataFrame([], CACHE_SCHEMA)
    return held.where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens").dropDuplicates(["digest"])


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Input: doc_id, text; other columns are ignored. Null counts as empty: 0 bytes, 0 tokens. Repeated
    rows come back repeated, their content is encoded once. Without ``cache_path`` the cache starts empty
    in the shared folder. Encoding drops white space and lowers case as the tokenizer's file says.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    cache_path = cache_path or scratch_path(spark, "token-counts")
    text = text_or_empty()
    rows = docs.select(col("doc_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    held = read_cache(spark, cache_path, version)
    misses = rows.select("digest", "text").join(held, "digest", "left_anti").dropDuplicates(["digest"])
    counted = misses.mapInArrow(_count(tokenizer_path), "digest string, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    keyed = docs.select(
        col("doc_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return keyed.join(read_cache(spark, cache_path, version), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, directory):
    import public_tokenizers

    docs = spark.read.parquet(f"{directory}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
