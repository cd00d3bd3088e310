"""The corpus pipeline: classify, drop copies, drop near copies, mix sources, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
``documents``. Between stages the rows are written and read again.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridloom.llm import exact_dedup, mixing, ngram_join, packing, quality  # noqa: E402
from gridloom.llm.common import stored  # noqa: E402

ORACLE_SQL = None  # the classifier is no SQL; tests compare every stage with a plain version


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents connected by 5-word shingle similarity of 0.8 or more the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix by source weights holds them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of all documents, placed in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark, sf_dir):
    """All stages over the documents of a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
