"""CSV records of files whose quoted text may hold line ends, read in byte ranges.

Whether a line begins inside quoted text depends on all lines before it, but a line only maps "begins
outside" and "begins inside" to an end, and such maps compose. So a first pass composes the lines of
every byte range (Spark's own split of the text), the ranges of a file are put in sequence (a row per
range), and a second pass cuts every range into records. A record that crosses a range's end comes as
fragments, which are put together by the range it began in.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attach import broadcastable
from ..session import checkpointed

STEP_BYTES = 1 << 22
RANGE = ["__file", "__range"]


def ends_inside(line: str, inside: bool) -> bool:
    """Does a line that begins inside (or outside) quoted text end inside? A quote opens at a field's start alone."""
    at, size = 0, len(line)
    while True:
        if not inside:
            if at < size and line[at] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
        while True:  # quoted: doubled quotes are text
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
            else:
                break
        inside, at = False, at + 1
        at = line.find(",", at) + 1
        if not at:
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__range"),
        F.coalesce("value", F.lit("")).alias("__line"))


def _runs(batch):
    """Rows of one byte range after the other: (file, range, first row, end)."""
    file, begin = batch.column("__file").to_numpy(zero_copy_only=False), batch.column("__range").to_numpy()
    change = np.flatnonzero((file[1:] != file[:-1]) | (begin[1:] != begin[:-1])) + 1
    edges = [0, *change.tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        yield (file[lo], int(begin[lo])), lo, hi


def _maps(batches):
    """Per byte range and way to begin it: does it end inside, and did the record open at its end begin in it?"""
    key, state = None, None

    def row():
        return pa.RecordBatch.from_pydict(
            {"__file": [key[0]], "__range": [key[1]], "end": [[s[0] for s in state]], "own": [[s[1] for s in state]]})

    for batch in batches:
        if not batch.num_rows:
            continue
        quoted = pc.match_substring(batch.column("__line"), '"').to_numpy(zero_copy_only=False)
        for found, lo, hi in _runs(batch):
            if found != key:
                if key is not None:
                    yield row()
                key, state = found, [(False, False), (True, False)]
            for i in np.flatnonzero(quoted[lo:hi]):
                line = batch.column("__line")[lo + int(i)].as_py()
                ends = (ends_inside(line, False), ends_inside(line, True))
                # A record opens anew if the line began outside.
                state = [(ends[inside], ends[inside] and (own or not inside)) for inside, own in state]
    if key is not None:
        yield row()


def _sequence(ranges: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file in order: does each begin inside quoted text, and in which range did that record begin?"""
    ranges = ranges.sort_values("__range")
    inside, origin, begins, origins = False, -1, [], []
    for start, end, own in zip(ranges["__range"], ranges["end"], ranges["own"]):
        begins.append(inside)
        origins.append(origin)
        way = int(inside)
        if end[way] and own[way]:
            origin = start
        inside = bool(end[way])
    return pd.DataFrame({"__file": ranges["__file"], "__range": ranges["__range"], "__inside": begins, "__origin": origins})


_PIECES = pa.schema([("__file", pa.string()), ("__origin", pa.int64()), ("__range", pa.int64()), ("__whole", pa.bool_()),
                     ("__text", pa.string())])
PIECES = "__file string, __origin long, __range long, __whole boolean, __text string"


def _cut(batches):
    """Lines as records. The first record of a file, its header, is left out."""
    key = None
    inside = header = False
    origin, held, out, size = -1, [], [], 0

    def batch_of(rows):
        columns = zip(*rows) if rows else [[] for _ in _PIECES]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    def close(whole: bool):
        """The lines held are a record, or a fragment of the record that began at ``origin``."""
        nonlocal header, held
        if not header:
            out.append((key[0], origin, key[1], whole, "\n".join(held)))
        header, held = False, []

    for batch in batches:
        if not batch.num_rows:
            continue
        lines, insides, origins = batch.column("__line"), batch.column("__inside"), batch.column("__origin")
        quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
        for found, lo, hi in _runs(batch):
            if found != key:
                if held:
                    close(False)
                key, inside, origin = found, bool(insides[lo].as_py()), origins[lo].as_py()
                header = found[1] == 0
            part = lines.slice(lo, hi - lo)
            if not inside and not header and not quoted[lo:hi].any():
                if out:
                    yield batch_of(out)
                    out, size = [], 0
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * n), pa.array(np.full(n, key[1])), pa.array(np.full(n, key[1])),
                     pa.array(np.ones(n, bool)), part], schema=_PIECES)
                continue
            for line, marks in zip(part.to_pylist(), quoted[lo:hi].tolist()):
                continues = inside
                if marks:
                    inside = ends_inside(line, inside)
                if not continues:
                    origin = key[1]
                held.append(line)
                if not inside:
                    # A record begun in an earlier range is a fragment here.
                    close(origin == key[1])
                size += len(line)
                if size > STEP_BYTES and out:
                    yield batch_of(out)
                    out, size = [], 0
    if held:
        close(False)
    yield batch_of(out)


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row ``__text`` per CSV record but the headers; blank records are left out."""
    lines = lines_of(spark, path)
    maps = lines.mapInArrow(_maps, "__file string, __range long, end array<boolean>, own array<boolean>")
    begins = checkpointed(maps.groupBy("__file").applyInPandas(
        _sequence, "__file string, __range long, __inside boolean, __origin long"))
    known = begins.select(F.col("__file").alias("__f"), F.col("__range").alias("__r"), "__inside", "__origin")
    same = (F.col("__file") == F.col("__f")) & (F.col("__range") == F.col("__r"))
    columns = [*RANGE, "__line", "__inside", "__origin"]
    if broadcastable(known):  # a row per byte range
        numbered = lines.join(F.broadcast(known), same).select(*columns)
    else:
        ordered = lines.withColumn("__at", F.monotonically_increasing_id()).join(known, same)
        numbered = ordered.repartition(*RANGE).sortWithinPartitions(*RANGE, "__at").select(*columns)
    pieces = numbered.mapInArrow(_cut, PIECES)
    crossing = pieces.where(~F.col("__whole")).groupBy("__file", "__origin").agg(
        F.array_sort(F.collect_list(F.struct("__range", "__text"))).alias("parts"))  # of one record
    joined = crossing.select(F.array_join(F.transform("parts", lambda p: p["__text"]), "\n").alias("__text"))
    text = pieces.where("__whole").select("__text").unionByName(joined)
    return text.select(F.regexp_replace("__text", "\r$", "").alias("__text")).where(F.trim("__text") != "")
