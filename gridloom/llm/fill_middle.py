"""Fill-in-the-middle texts by secondary sort.

A text is cut into prefix, middle and suffix at places drawn from its doc_id, and these are put in another
order behind marks. Nothing is assembled in memory: a text leaves as pieces of at most ``PIECE`` code
points, keyed by row and place in the output. Pieces of a row meet in one partition, sorted by place
(``repartition`` and ``sortWithinPartitions``), and stream into an incremental digest. The same stream is
read for its marks alone, which give every stretch its place in the original; sorted again by that, within
the partition, it streams into the digest of the restored text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .common import text_or_empty

PIECE = 1 << 16  # code points of a piece: what a task holds of one text
MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20  # percentages of the contract
OUTPUT = {"plain": "", "psm": "PSM", "spm": "SPM"}  # order of the parts behind their marks
RESTORED = {"P": 0, "M": 1, "S": 2, "": 0}  # order of the parts in the original
DRAIN = 1 << 22  # bytes of pieces sent on together


def layout(text: str, doc_id) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text; a null doc_id draws as an empty one."""
    seed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(seed[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not n or h3 % 100 >= PLAIN_FROM or any(m in text for m in MARKS):
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), a, b


def output_pieces(text: str, form: str, a: int, b: int, size: int = PIECE):
    """The output cut into pieces: (code points before the piece, piece)."""
    n, at = len(text), 0
    parts = {"": (0, n), "P": (0, a), "M": (a, b), "S": (b, n)}
    for part in OUTPUT[form] or [""]:
        first, last = parts[part]
        lead = f"<{part}>" if part else ""
        while True:
            stop = min(last, first + size)
            piece = lead + text[first:stop]
            yield at, piece
            at += len(piece)
            first, lead = stop, ""
            if first >= last:
                break


PIECES = "key long, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, piece binary"
_PIECES = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()),
                     ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                     ("piece", pa.binary())])
RESTORE = "key long, part int, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, " \
    "output_sha256 string, piece binary"
_RESTORE = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()),
                      ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                      ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("piece", pa.binary())])
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


class _Rows:
    """Rows collected into bounded Arrow batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int = 64):
        self.rows.append(row)
        self.held += size

    def full(self) -> bool:
        return self.held >= DRAIN

    def drain(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.schema]
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.held = [], 0
        return batch


def _cut(size: int):
    def run(batches):
        out = _Rows(_PIECES)
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(c) for c in ("key", "doc_id", "text"))):
                key, doc_id, text = key.as_py(), doc_id.as_py(), text.as_py()
                form, a, b = layout(text, doc_id)
                cut = (None, None) if form == "plain" else (a, b - a)
                for place, piece in output_pieces(text, form, a, b, size):
                    head = (None, None, None, None, None) if place else (doc_id, len(text), form, *cut)
                    data = piece.encode()
                    out.add((key, place, *head, data), 64 + len(data))
                    if out.full():
                        yield out.drain()
        yield out.drain()

    return run


class Parts:
    """Reads an output as a stream and tells the stretches between its marks: (part, place in it, bytes).

    No part holds a mark, and no mark begins with the end of another, so the first mark of the awaited kind
    ends a part. The last two characters are held back, as a mark may go on in the next piece.
    """

    def __init__(self, form: str):
        self.awaited, self.part, self.place, self.rest = list(OUTPUT[form]), "", 0, b""

    def feed(self, data: bytes, last: bool = False):
        data = self.rest + data
        while self.awaited:
            mark = f"<{self.awaited[0]}>".encode()
            spot = data.find(mark)
            if spot < 0:
                break
            yield from self._stretch(data[:spot])
            self.part, self.place = self.awaited.pop(0), 0
            data = data[spot + len(mark):]
        keep = 2 if self.awaited and not last else 0
        cut = len(data) - keep if len(data) > keep else (0 if keep else len(data))
        yield from self._stretch(data[:cut])
        self.rest = data[cut:]

    def _stretch(self, data: bytes):
        if data:
            yield RESTORED[self.part], self.place, data
            self.place += len(data)


def _assemble(batches):
    """Sorted output pieces into the output's digest and, through its marks, into pieces of the original."""
    out = _Rows(_RESTORE)
    key = head = parts = digest = None

    def finish():
        for part, place, data in parts.feed(b"", True):
            out.add((key, part, place, None, None, None, None, None, None, data), 64 + len(data))
        out.add((key, len(RESTORED), 0, *head, digest.hexdigest(), None))

    for batch in batches:
        names = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
        keys = batch.column("key").to_pylist()
        heads = [batch.column(c) for c in names]
        pieces = batch.column("piece")
        for i, found in enumerate(keys):
            if found != key:
                if key is not None:
                    finish()
                key, head, digest = found, tuple(c[i].as_py() for c in heads), hashlib.sha256()
                parts = Parts(head[2])
            piece = pieces[i].as_py()
            digest.update(piece)
            for part, place, data in parts.feed(piece):
                out.add((key, part, place, None, None, None, None, None, None, data), 64 + len(data))
            if out.full():
                yield out.drain()
    if key is not None:
        finish()
    yield out.drain()


def _restore(batches):
    """Pieces in the original's order into its digest; a row's last record carries what else is returned."""
    out = _Rows(_RESULT)
    digest = hashlib.sha256()
    for batch in batches:
        last = batch.column("piece").is_null().to_numpy(zero_copy_only=False)
        pieces = batch.column("piece")
        heads = [batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")]
        for i in range(batch.num_rows):
            if last[i]:
                out.add((*(c[i].as_py() for c in heads), digest.hexdigest()))
                digest = hashlib.sha256()
            else:
                digest.update(pieces[i].as_py())
        if out.full():
            yield out.drain()
    yield out.drain()


def output_table(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """The outputs as pieces, in order within partitions: key, place, piece, and on a key's first one doc_id, n,
    form, prefix_chars and middle_chars. Concatenated by key they are the training texts."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), col("doc_id").cast("long").alias("doc_id"),
                       text_or_empty().alias("text"))
    return rows.mapInArrow(_cut(piece), PIECES).repartition("key").sortWithinPartitions("key", "place")


def fill_in_middle(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    Input: doc_id, text; other columns are ignored. A null or empty text has n = 0 and the form plain, whose
    output is the text; prefix_chars and middle_chars are null for it. Texts that hold a mark are plain. A
    null doc_id draws its places from an empty one and stays null. Repeated rows are returned each. Very
    long texts pass in pieces; the digest of one text is made by one task, which holds a piece at a time. An
    empty table gives no rows. Cuts lie between code points.
    """
    restored = output_table(docs, piece).mapInArrow(_assemble, RESTORE)
    # Rows of a key are already together, so the second sort moves nothing between tasks.
    return restored.sortWithinPartitions("key", "part", "place").mapInArrow(_restore, RESULT)


def query(spark, directory):
    return fill_in_middle(spark.read.parquet(f"{directory}/documents.parquet"))


SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as s from documents),
h as (select doc_id, t, length(t) as n, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2,
             ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
f as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
                  when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
o as (select doc_id, n, form, a, b, t, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars,
       case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from o"""
