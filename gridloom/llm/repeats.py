"""Long repeated substrings by run-length compressed indexes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.
Every 50-byte string is assigned to its anchor, the leftmost smallest hash among the short strings in it,
so equal strings have equal anchors at equal places. A counting pass over all anchors leaves those seen in
several documents. The stretches of text around them go to the task of their anchor. There the distinct
stretches are sorted into a Burrows-Wheeler transform, kept as runs; the ends of the runs of
equal 50-byte strings are sampled with the smallest doc_id inside. Every indexed stretch walks the runs from its
end over its own rows, and the sample at each says whether the string starts in a smaller document;
anchors and local sorting stand in for matching statistics. The stretches of an anchor with very many rows never meet in one task:
their strings are grouped by themselves. Marks go back to the documents and merge into spans.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.attach import attach, broadcastable
from .common import byte_view, spans_of, stored, text_bytes
from .shingles import mixed
from .token_classes import token_classes

LENGTH = 50
ANCHOR = 24  # bytes of the strings whose hashes choose the anchor
PIECE = 1 << 16  # string starts handled at a time; a place in a piece fits PLACE_BITS
PLACE_BITS = 16
PLACE_MASK = np.uint64((1 << PLACE_BITS) - 1)
INDEX_BYTES = 1 << 20  # text of one index, whole anchors; one anchor alone may have 2 HOT stretches
PACKED = 1 << 21  # up to here three ranks of 21 bits make a sort key
WINDOWS = LENGTH - ANCHOR + 1
DEPTH = 72  # bytes of a stretch at most: suffixes are sorted by 8, 24, 72 bytes
MOST = DEPTH - LENGTH + 1  # strings of a stretch at most
HOT = 14_000  # documents, or rows beyond the first of a document, from which an anchor's strings are grouped by themselves
CROWD = 16  # runs of one anchor in a piece that are shipped one by one
SHIP_BYTES = 1 << 26  # text of stretches in one batch of rows
START_BITS, STEP_BITS = 31, 16  # a mark's place: first start, step between starts, starts less one


def _words(codes: np.ndarray) -> np.ndarray:
    """Little-endian 8-byte words at every position (len - 7 of them)."""
    a = codes.astype(np.uint64)
    a = a[:-1] | a[1:] << np.uint64(8)
    a = a[:-2] | a[2:] << np.uint64(16)
    return a[:-4] | a[4:] << np.uint64(32)


def _scrambled(h: np.ndarray) -> np.ndarray:
    """``mixed`` in place."""
    t = h >> np.uint64(30)
    h ^= t
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, np.uint64(27), out=t)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= np.right_shift(h, np.uint64(31), out=t)
    return h


def _places(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the short strings of a piece, and the anchor place of every string start."""
    words = _words(part)
    count = len(part) - ANCHOR + 1
    h = words[:count].copy()
    for j in range(8, ANCHOR, 8):
        h = _scrambled(h)
        h += words[j:j + count]
    h = _scrambled(h)
    low = h & ~PLACE_MASK
    low |= np.arange(count, dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOWS:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < WINDOWS:
        low = np.minimum(low[:-(WINDOWS - span)], low[WINDOWS - span:])
    low &= PLACE_MASK
    return h, low.astype(np.int64)


def _runs(h: np.ndarray, place: np.ndarray, starts: np.ndarray | None = None) -> tuple:
    """(anchor hash, first string start, number of strings, first start - anchor place) of the runs of string starts with
    one anchor place. ``starts`` are the starts behind ``place``, if not all are strings."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    counts = np.diff(np.append(first, len(place)))
    long = np.flatnonzero(counts > MOST)  # cut in two, so that a stretch has at most DEPTH bytes
    if len(long):
        first = np.sort(np.concatenate([first, first[long] + MOST]))
        counts = np.diff(np.append(first, len(place)))
    at = place[first]
    # Smallest hashes crowd at the low end; scrambled, anchors spread evenly.
    anchor = mixed(h[at] & ~PLACE_MASK, 3)
    first = first if starts is None else starts[first]
    return anchor, first, counts, first - at


def pieces(codes: np.ndarray):
    """Per piece of a text (anchor hash, first string start, number of strings, first start - anchor place) of its runs of
    strings with one anchor place, and the hashes of the short strings from the piece's begin on. Texts shorter than
    LENGTH have none."""
    for begin in range(0, len(codes) - LENGTH + 1, PIECE - LENGTH):
        part = codes[begin:begin + PIECE]
        if len(part) < LENGTH:
            break
        h, place = _places(part)
        anchor, first, counts, lead = _runs(h, place)
        yield anchor, first + begin, counts, lead, h, begin


def text_pieces(data: np.ndarray, at: np.ndarray, wanted=None):
    """(text number, piece as of ``pieces``) of every text ``data[at[i]:at[i + 1]]``, in order; short texts are hashed
    together, by the same hashes and choices. Of the runs those stay whose anchors ``wanted`` marks; a piece has one or more."""
    def kept(anchor, *rest):
        if wanted is None:
            return anchor, *rest
        keep = np.flatnonzero(wanted(anchor))
        return tuple(x[keep] for x in (anchor, *rest))

    for one, last in spans_of(at, PIECE - 1):  # a text below PIECE bytes is one piece
        data_here, ends = data[at[one]:at[last]], at[one + 1:last + 1] - at[one]
        if last == one + 1:
            for *runs, h, begin in pieces(data_here):
                runs = kept(*runs)
                if len(runs[0]):
                    yield one, (*runs, h, begin)
            continue
        if len(data_here) < LENGTH:
            continue
        h, place = _places(data_here)
        whole = np.ones(len(place), bool)  # strings that do not run over the end of their text
        over = (ends[:, None] - np.arange(1, LENGTH)).ravel()
        whole[over[(over >= 0) & (over < len(place))]] = False
        starts = np.flatnonzero(whole)
        if not len(starts):
            continue
        anchor, first, counts, lead = kept(*_runs(h, place[starts], starts))
        cuts = [0, *np.searchsorted(first, ends).tolist()]
        begins = [0, *ends.tolist()]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                yield one + i, (anchor[a:b], first[a:b] - begins[i], counts[a:b], lead[a:b], h[begins[i]:begins[i + 1]], 0)


def collapsed(codes, anchor, first, counts, lead, h, begin):
    """Rows of a piece to ship: (which run, its starts as one number). Equal stretches at even distances of an anchor with
    more than CROWD runs are one row, so a long run of a short period has about as many rows as the period has bytes."""
    order = np.sort(anchor)
    crowded = order[CROWD:][order[CROWD:] == order[:-CROWD]]
    if not len(crowded):
        return np.arange(len(anchor)), first
    among = np.isin(anchor, crowded)
    rest, among = np.flatnonzero(~among), np.flatnonzero(among)
    which, start = _collapsed(codes, *(x[among] for x in (anchor, first, counts, lead)), h, begin)
    return np.concatenate([rest, among[which]]), np.concatenate([first[rest], start])


def _collapsed(codes, anchor, first, counts, lead, h, begin):
    alone = np.arange(len(anchor))
    size, at = counts + LENGTH - 1, first - begin
    key = anchor
    for x in (lead, counts, h[at], h[at + ANCHOR], h[at + size - ANCHOR]):
        key = mixed(key) + x.astype(np.uint64)
    _, one, group = np.unique(key, return_index=True, return_inverse=True)
    again = np.flatnonzero(one[group] != alone)
    twin = one[group[again]]
    spot = np.arange(DEPTH)
    equal = (anchor[again] == anchor[twin]) & (lead[again] == lead[twin]) & (counts[again] == counts[twin])
    own, other = (codes[np.minimum(first[x][:, None] + spot, len(codes) - 1)] for x in (again, twin))
    equal &= ((own == other) | (spot >= size[again][:, None])).all(1)
    odd = again[~equal]  # equal hashes of unlike stretches
    group[odd] = len(one) + np.arange(len(odd))
    order = np.argsort(group, kind="stable")
    group, start = group[order], first[order]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    gap = np.where(new, 0, np.diff(start, prepend=0))
    uneven = np.concatenate([[False], (gap[1:] != gap[:-1]) & ~new[:-1]])
    head = np.flatnonzero(new | uneven)
    more = np.diff(np.append(head, len(start))) - 1
    step = np.where(more > 0, gap[np.minimum(head + 1, len(gap) - 1)], 0)
    return order[head], start[head] | step << START_BITS | more << START_BITS + STEP_BITS


def starts_of(places: np.ndarray):
    """The starts behind the numbers of ``collapsed``, and which number each is of."""
    more = places >> START_BITS + STEP_BITS
    which = np.repeat(np.arange(len(places)), more + 1)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    step = places >> START_BITS & (1 << STEP_BITS) - 1
    return (places & (1 << START_BITS) - 1)[which] + nth * step[which], which


def again_token(anchor: np.ndarray) -> np.ndarray:
    """The token that counts an anchor's rows beyond the first of each document."""
    return mixed(anchor, 5)


class AnchorSource:
    """For the counting pass: the distinct anchors of every text, and a token of its own for each further row of one."""

    def sets(self, data, at):
        for i, some in groupby(text_pieces(data, at), lambda found: found[0]):
            codes = data[at[i]:at[i + 1]]
            anchors = np.sort(np.concatenate([p[0][collapsed(codes, *p)[0]] for _, p in some]))
            again = np.flatnonzero(anchors[1:] == anchors[:-1]) + 1
            anchors[again] = again_token(anchors[again])
            yield anchors


def _repeated_segments(maps, bits):
    def marked(bitmap, tokens):
        spots = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        return (bitmap[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8) & 1).astype(bool)

    def table(parts):
        anchor, lead, text, size, doc, row, start, hot = (np.concatenate(x) for x in zip(*parts))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        context = pa.Array.from_buffers(
            pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text))])
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(lead.astype(np.int32)), context, pa.array(doc), pa.array(row), pa.array(start), pa.array(hot)],
            ["anchor", "lead", "context", "doc_id", "row_key", "start", "hot"])

    def run(batches):
        several, many = maps.value
        any_hot = many.any()
        for batch in batches:
            data, at = byte_view(batch.column("bytes"))
            docs, rows = batch.column("doc_id").to_numpy(), batch.column("row_key").to_numpy()
            parts, held = [], 0
            for i, (anchor, first, counts, lead, h, begin) in text_pieces(data, at, lambda anchor: marked(several, anchor)):
                codes = data[at[i]:at[i + 1]]
                keep, start = collapsed(codes, anchor, first, counts, lead, h, begin)
                hot = np.zeros(len(keep), bool)
                if any_hot:
                    hot = marked(many, anchor[keep]) | marked(many, again_token(anchor[keep]))
                size = counts[keep] + LENGTH - 1
                ends = np.cumsum(size)
                where = np.repeat(first[keep] - (ends - size), size) + np.arange(ends[-1])
                parts.append((anchor[keep].astype(np.int64), lead[keep], codes[where], size,
                              np.full(len(keep), docs[i]), np.full(len(keep), rows[i]), start, hot))
                held += int(ends[-1])
                if held >= SHIP_BYTES:
                    yield table(parts)
                    parts, held = [], 0
            if parts:
                yield table(parts)

    return run


class RunIndex:
    """A run-length Burrows-Wheeler transform of texts of at most DEPTH bytes, each closed by its own end mark.

    Rows are all suffixes in order, end marks first. ``starts`` and ``symbols`` are the stretches of rows with one
    preceding symbol (0: start of a text, else byte + 1); ``string_starts`` are the ends of the stretches of rows that
    begin with one string of LENGTH bytes, sampled with the smallest document among them.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, docs: np.ndarray):
        count, sizes = len(at) - 1, np.diff(at)
        assert len(data) < 1 << 31, "ranks have 31 bits"
        text = np.repeat(np.arange(count), sizes)
        left = (at[1:][text] - np.arange(len(data))).astype(np.uint8)  # bytes up to the end of the text
        rank = self._rank(self._first_words(data, left))
        rank24 = self._rank(self._three(rank, left, 8, PACKED))
        # Equal suffixes come in order of their texts; one that ends before a NUL byte comes first.
        by_left = np.argsort(left, kind="stable")
        order = by_left[np.argsort(self._three(rank24, left, 24, PACKED)[by_left], kind="stable")]
        before = np.concatenate([[0], data[:-1].astype(np.int16) + 1])
        before[at[:-1][sizes > 0]] = 0
        last = np.zeros(count, np.int16)
        last[sizes > 0] = data[at[1:][sizes > 0] - 1].astype(np.int16) + 1
        symbols = np.concatenate([last, before[order]])
        self.starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        self.symbols = symbols[self.starts]
        lengths = np.diff(np.append(self.starts, len(symbols)))
        self.run_of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)  # rank of a row among the run starts
        by_symbol = np.argsort(self.symbols, kind="stable")
        self.target = np.empty(len(self.starts), np.int64)  # row that a run's first row steps to
        # Symbol 0 leads to the rows of the end marks, which come first, as many as there are texts.
        self.target[by_symbol] = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        begins = self._string_begins(rank24, left, order)
        self.string_starts = begins + count
        self.string_of = np.repeat(np.arange(len(begins), dtype=np.int32), np.diff(np.append(begins, len(order))))
        self.samples = np.minimum.reduceat(docs[text[order]], begins) if len(order) else docs[:0]
        self.count, self.sizes = count, sizes

    @staticmethod
    def _first_words(data, left):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        w = padded[:-1] << np.uint64(8) | padded[1:]
        w = w[:-2] << np.uint64(16) | w[2:]
        w = w[:-4] << np.uint64(32) | w[4:]
        short = np.array([0, *((1 << 64) - (1 << 8 * (8 - n)) for n in range(1, 9))], np.uint64)
        return w[:len(data)] & short[np.minimum(left, 8)]

    @staticmethod
    def _rank(keys):
        order = np.argsort(keys)
        ranks = np.empty(len(keys), np.int64)
        values = keys[order]
        ranks[order] = np.cumsum(np.concatenate([[1], (values[1:] != values[:-1])]))[:len(keys)]
        return ranks

    @classmethod
    def _three(cls, rank, left, step, packed):
        """Ranks here, ``step`` and 2 ``step`` bytes on (0 beyond the end) as one key."""
        def add(key, k, shift):
            if len(rank) > k:
                key[:-k] |= np.where(left[:-k] > k, rank[k:], 0) << shift
            return key

        if len(rank) < packed:
            return add(add(rank << 42, step, 21), 2 * step, 0)
        return add(cls._rank(add(rank << 31, step, 0)) << 31, 2 * step, 0)

    @staticmethod
    def _string_begins(rank24, left, order):
        """Rows at which another string of LENGTH bytes begins; shorter suffixes stand alone."""
        if not len(order):
            return np.zeros(0, np.int64)
        same = (left[order[1:]] >= LENGTH) & (left[order[:-1]] >= LENGTH)
        for k in (0, 24, LENGTH - 24):
            ahead = rank24[np.minimum(order + k, len(rank24) - 1)]
            same &= ahead[1:] == ahead[:-1]
        return np.flatnonzero(np.concatenate([[True], ~same]))

    def smallest(self) -> np.ndarray:
        """For each text and each of its first MOST places: the smallest document that holds the string there."""
        found = np.full((self.count, MOST), np.iinfo(np.int64).max)
        text, row = np.arange(self.count), np.arange(self.count)
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            run = self.run_of[row]
            go = self.symbols[run] > 0
            text, row, run = text[go], row[go], run[go]
            row = self.target[run] + row - self.starts[run]
            if step >= LENGTH:
                found[text, self.sizes[text] - step] = self.samples[self.string_of[row - self.count]]
        return found


def _strings_of(size):
    return size - LENGTH + 1


def _mask_of(anchor: np.ndarray, context: list, first: np.ndarray) -> np.ndarray:
    """For distinct stretches sorted by anchor, each with its smallest document: bits of the strings that start in a
    smaller document. A stretch that is its anchor's only one has none."""
    mask = np.zeros(len(context), np.int64)
    change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    counts = np.diff(np.append(change, len(anchor)))
    among = np.flatnonzero(np.repeat(counts, counts) > 1)
    if len(among):
        held = [context[i] for i in among]
        at = np.concatenate([[0], np.cumsum([len(c) for c in held])])
        smallest = RunIndex(np.frombuffer(b"".join(held), np.uint8), at, first[among]).smallest()
        mask[among] = ((smallest < first[among, None]) << np.arange(MOST)).sum(1)
    return mask


def _groups(batches, names, weigh):
    """Columns of sorted batches, cut into runs of whole anchors of about INDEX_BYTES."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [np.array(batch.column(n).to_pylist(), object) if n == "context" else batch.column(n).to_numpy() for n in names]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        while True:
            total = np.cumsum(weigh(held))
            if total[-1] < INDEX_BYTES:
                break
            cut = int(np.searchsorted(held[0], held[0][np.searchsorted(total, INDEX_BYTES)]))
            if cut == 0:  # one anchor alone fills the index
                cut = int(np.searchsorted(held[0], held[0][0], side="right"))
            if cut == len(total):
                break
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _sizes(held):
    return np.array([len(c) for c in held[2]])


def _marks(batches):
    """Rows of stretches sorted by anchor become marks (doc_id, row_key, start, mask) of strings that go."""
    for anchor, lead, context, doc, row, start in _groups(
            batches, ["anchor", "lead", "context", "doc_id", "row_key", "start"], _sizes):
        names: dict = {}
        which = np.array([names.setdefault(k, len(names)) for k in zip(anchor.tolist(), lead.tolist(), context.tolist())])
        first = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(first, which, doc)
        keys = list(names)
        mask = _mask_of(np.array([k[0] for k in keys]), [k[2] for k in keys], first)
        every = (np.int64(1) << _strings_of(_sizes((0, 0, context)))) - 1
        mask = np.where(doc > first[which], every, mask[which])
        go = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays([pa.array(x[go]) for x in (doc, row, start, mask)], MARK)


MARK = ["doc_id", "row_key", "start", "mask"]
MARK_SQL = "doc_id long, row_key long, start long, mask long"
STRETCH = ["anchor", "lead", "context"]
STRETCH_SQL = "anchor long, lead int, context binary"


def _marks_and_hot(batches):
    """Marks of the cold rows, and the hot rows as they are, without mask."""
    def runs():
        for batch in batches:
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(hot[1:] != hot[:-1]) + 1).tolist(), len(hot)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield bool(hot[a]), batch.slice(a, b - a)

    names = [*MARK, *STRETCH]
    for hot, run in groupby(runs(), lambda r: r[0]):
        rows = (batch for _, batch in run)
        for batch in rows if hot else _marks(rows):
            n = batch.num_rows
            none = {"mask": pa.nulls(n, pa.int64()), "anchor": pa.nulls(n, pa.int64()), "lead": pa.nulls(n, pa.int32()),
                    "context": pa.nulls(n, pa.binary())}
            yield pa.RecordBatch.from_arrays([batch.column(c) if c in batch.schema.names else none[c] for c in names], names)


def _covered(places: np.ndarray, mask: np.ndarray, n: int) -> np.ndarray:
    """At each byte, the strings that go and begin there less those that end before it."""
    change = np.zeros(n + 1, np.int64)
    total = np.cumsum((places >> START_BITS + STEP_BITS) + 1)
    cuts = np.searchsorted(total, np.arange(0, total[-1], PIECE))
    for a, b in zip(cuts, [*cuts[1:], len(places)]):
        if a < b:
            start, which = starts_of(places[a:b])
            begins = (start[:, None] + np.arange(MOST))[(mask[a:b][which, None] >> np.arange(MOST)) & 1 == 1]
            low = int(begins.min())
            found = np.bincount(begins - low)
            change[low:low + len(found)] += found
            change[low + LENGTH:low + LENGTH + len(found)] -= found
    return change


def _result(batches):
    for batch in batches:
        data, at = byte_view(batch.column("bytes"))
        copies = batch.column("copy").to_pylist()
        out = []
        for i, marks in enumerate(batch.column("marks").to_pylist()):
            codes = data[at[i]:at[i + 1]]
            n = len(codes)
            if copies[i]:
                gone = np.full(n, n >= LENGTH)
            elif marks:
                start = np.array([m["start"] for m in marks])
                mask = np.array([m["mask"] for m in marks])
                gone = np.cumsum(_covered(start, mask, n))[:n] > 0
            else:
                gone = np.zeros(n, bool)
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((n, int(gone.sum()), spans, hashlib.sha256(codes[~gone].tobytes()).hexdigest()))
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _hot_marks(found: DataFrame) -> DataFrame:
    """Marks of anchors with very many rows. Equal stretches are collapsed on the way, then the strings of the distinct
    ones are grouped by themselves, so that no task holds an anchor; both are joined back with hot keys spread."""
    distinct = stored(found.groupBy(*STRETCH).agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "hot-stretches")
    places = F.explode(F.expr(f"sequence(0, octet_length(context) - {LENGTH})"))
    strings = distinct.select(*STRETCH, "first", places.alias("place")).withColumn(
        "string", F.expr(f"substring(context, place + 1, {LENGTH})"))
    smallest = strings.groupBy("string").agg(
        F.min("first").alias("smallest"), F.max("first").alias("largest"), F.count(F.lit(1)).alias("uses"))
    smallest = smallest.where("smallest < largest").drop("largest")
    later = attach(strings, smallest, ["string"], rows="uses").where("smallest < first")
    bits = later.select(*STRETCH, "first", F.lit(0).cast("long").alias("rows"), F.expr("shiftleft(1L, place)").alias("bits"))
    marks = distinct.select("*", F.lit(0).cast("long").alias("bits")).unionByName(bits).groupBy(*STRETCH).agg(
        F.min("first").alias("first"), F.sum("rows").alias("rows"), F.bit_or("bits").alias("bits"))
    every = F.expr(f"shiftleft(1L, octet_length(context) - {LENGTH - 1}) - 1")
    mask = F.when(F.col("doc_id") > F.col("first"), every).otherwise(F.col("bits"))
    return attach(found, marks, STRETCH, rows="rows").select("doc_id", "row_key", "start", mask.alias("mask")).where("mask <> 0")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Input: doc_id, text; other columns are ignored. A null text counts as empty; texts shorter than LENGTH
    lose nothing. Strings are judged on the input. Rows that share a doc_id do not count against each
    other. A row without doc_id is neither smaller nor larger than another and loses nothing. An empty
    table gives no rows.
    """
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"))
    rows = rows.withColumn("row_key", F.xxhash64("bytes"))
    digest = F.sha2("bytes", 256)
    firsts = rows.where("doc_id is not null").groupBy(digest.alias("digest")).agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    several = firsts.where("first < last").select(F.col("digest").alias("__digest"), F.col("first").alias("__first"))
    several = stored(several, "copied")
    several = F.broadcast(several) if broadcastable(several) else several
    judged = rows.join(several, (digest == F.col("__digest")) & F.col("doc_id").isNotNull(), "left").withColumn(
        "copy", F.coalesce(F.col("doc_id") > F.col("__first"), F.lit(False))).drop("__digest", "__first")
    # Copies of a whole text lose it all; their strings start in the first copy too.
    texts = judged.where("not copy and doc_id is not null and octet_length(bytes) >= 50").select("doc_id", "row_key", "bytes")
    size = rows.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    maps, bits = token_classes(texts, AnchorSource(), 2 * size // (WINDOWS + 1) + 1, HOT)
    found = texts.mapInArrow(
        _repeated_segments(maps, bits),
        "anchor long, lead int, context binary, doc_id long, row_key long, start long, hot boolean")
    if maps.value[1].any():
        # An anchor is hot or not as a whole; rows of hot ones are dealt by document.
        dealt = found.repartition("anchor", F.when(F.col("hot"), F.col("row_key"))).sortWithinPartitions("anchor")
        both = stored(dealt.mapInArrow(_marks_and_hot, f"{MARK_SQL}, {STRETCH_SQL}"), "marks")
        placed = both.where("mask is not null").select(*MARK).unionByName(_hot_marks(both.where("mask is null").drop("mask")))
    else:
        placed = found.drop("hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_marks, MARK_SQL)
    lists = placed.groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("start", "mask")).alias("marks"))  # bounded by one document
    lists = lists.withColumnsRenamed({"doc_id": "__id", "row_key": "__row"})
    whole = judged.join(lists, (F.col("doc_id") == F.col("__id")) & (F.col("row_key") == F.col("__row")), "left")
    return whole.select("doc_id", "bytes", "copy", "marks").mapInArrow(
        _result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, directory):
    return remove_repeats(spark.read.parquet(f"{directory}/documents.parquet"))
