"""Which tokens occur in several, and in many, documents: one counting pass, two bounded bitmaps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_view, lean

BUCKET_TOKENS = 1 << 21
MAX_BITS = 27  # at most 16 MB per bitmap
FLUSH_TOKENS = 1 << 20


def _token_blocks(source, bucket_bits: int):
    """Tokens cut to bucket_bits + 32 bits, as blocks of sorted 32-bit rests per bucket."""
    def blocks(tokens):
        tokens = np.sort(np.concatenate(tokens) >> np.uint64(32 - bucket_bits))
        buckets = (tokens >> np.uint64(32)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        rests = (tokens & np.uint64(0xFFFFFFFF)).astype("<u4")
        parts = [rests[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(rests)])]
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets[begins].astype(np.int32)), pa.array(parts, pa.binary())], ["bucket", "block"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for s in source.sets(*byte_view(batch.column("bytes"))):
                held.append(s)
                size += len(s)
                if size >= FLUSH_TOKENS:
                    yield blocks(held)
                    held, size = [], 0
        if size:
            yield blocks(held)

    return run


def _class_bits(bucket_bits: int, bits: int, frequent: int):
    """Per bucket: its slices of the bitmaps of tokens in several, and in many, documents."""
    def slices(bucket, blocks):
        rests = np.sort(np.concatenate([np.frombuffer(b, "<u4") for b in blocks]))
        begins = np.flatnonzero(np.concatenate([[True], rests[1:] != rests[:-1]]))
        counts = np.diff(np.append(begins, len(rests)))
        spots = (rests[begins] >> np.uint32(32 - (bits - bucket_bits))).astype(np.int64) if bits > bucket_bits else (
            np.zeros(len(begins), np.int64))
        out = []
        for least in (2, frequent):
            flags = np.zeros(1 << max(3, bits - bucket_bits), bool)
            flags[spots[counts >= least]] = True
            out.append(np.packbits(flags).tobytes())
        return pa.RecordBatch.from_pylist([{"bucket": bucket, "several": out[0], "many": out[1]}], schema=pa.schema(
            [("bucket", pa.int32()), ("several", pa.binary()), ("many", pa.binary())]))

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            for b, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                if bucket is not None and b != bucket:
                    yield slices(bucket, held)
                    held = []
                bucket = b
                held.append(block)
        if held:
            yield slices(bucket, held)

    return run


def token_classes(texts: DataFrame, source, tokens: int, frequent: int):
    """Bitmaps over the leading bits of a token: seen in several documents, seen in many.

    ``texts`` holds the column ``bytes``; ``source.sets`` gives the distinct 64-bit tokens of texts. Every token of
    every text is counted. Two tokens with equal leading bits share a class: the bitmaps may say more than
    is so, never less, and their size is bounded whatever the size of the input.
    """
    spark = texts.sparkSession
    bucket_bits = max(6, min(20, math.ceil(math.log2(max(2, tokens / BUCKET_TOKENS)))))
    bits = max(bucket_bits + 3, min(MAX_BITS, math.ceil(math.log2(max(2, tokens * 8)))))
    blocks = texts.mapInArrow(lean(_token_blocks(source, bucket_bits)), "bucket int, block binary")
    sliced = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lean(_class_bits(bucket_bits, bits, frequent)), "bucket int, several binary, many binary")
    size = (1 << bits) // 8
    maps = np.zeros((2, size), np.uint8)
    step = size >> bucket_bits
    for row in sliced.toLocalIterator():  # the two bitmaps, slice by slice: bounded by MAX_BITS
        for k, name in enumerate(("several", "many")):
            maps[k, row["bucket"] * step:(row["bucket"] + 1) * step] = np.frombuffer(row[name], np.uint8)[:step]
    return spark.sparkContext.broadcast(maps), bits
