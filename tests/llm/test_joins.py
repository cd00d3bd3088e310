import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import embeddings as E
from gridloom.llm import fuzzy_lines as L
from gridloom.llm import graph
from gridloom.llm import ngram_join as N
from gridloom.llm import repeats as R
from gridloom.llm.shingles import Shingler

from .conftest import SCHEMA, odd_rows, rows_of, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 90)] + [(500, 500)]
    edges += [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(150)]
    union = Union({n for e in edges for n in e})
    for a, b in edges:
        union.join(a, b)
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, (None, 3), (7, None)], "a long, b long").repartition(7)
    got = dict(tuple(r) for r in graph.components(frame).collect())
    assert got == {n: union.find(n) for n in union.parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_near(rows, k, percent):
    sets = [(r[0], shingle_set(r[1], k)) for r in rows]
    union = Union({r[0] for r in rows if r[0] is not None})
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                union.join(a, b)
    return sorted([(a, len(s), a if a is None else union.find(a)) for a, s in sets], key=repr)


@pytest.fixture(scope="module")
def near_rows():
    """Families of near copies at all distances, copied passages, and sets of every small size."""
    rng = random.Random(5)
    rows = odd_rows(3, 20)
    for family in range(6):
        base = words(rng, rng.choice([5, 12, 30, 80, 200])).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 30)}"
            rows.append((1000 + len(rows), " ".join(copy), "en", "s", 0))
    passage = words(rng, 60)
    rows += [(5000 + i, f"{words(rng, 30)} {passage}", "en", "s", 0) for i in range(70)]
    return rows


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, near_rows, k, percent):
    got = rows_of(N.near_duplicates(spark.createDataFrame(near_rows, SCHEMA), k, percent))
    assert got == plain_near(near_rows, k, percent)


def test_near_duplicates_with_crowded_groups(spark, near_rows, monkeypatch):
    for name, value in (("FREQUENT", 3), ("CROWDED", 4), ("BLOCK_ROWS", 5), ("PLAIN", 6)):
        monkeypatch.setattr(N, name, value)
    got = rows_of(N.near_duplicates(spark.createDataFrame(near_rows, SCHEMA), 4, 85))
    assert got == plain_near(near_rows, 4, 85)


def test_every_linked_pair_shares_a_signature(near_rows):
    threshold, shingler, rng = N.Threshold(85), Shingler(4), np.random.default_rng(2)
    texts = [(r[1] or "").encode() for r in near_rows]
    sets = list(shingler.sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))
    tokens = np.unique(np.concatenate(sets))
    often = dict(zip(tokens.tolist(), (rng.random(len(tokens)) < 0.7).astype(int).tolist()))  # any classes do
    signed = [set(N.signatures(s, np.ones(len(s), np.uint8), np.array([often[t] for t in s.tolist()], np.uint8), threshold).tolist())
              if len(s) else set() for s in sets]
    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common and threshold.linked(common, len(sets[i]), len(sets[j])):
                linked += 1
                assert signed[i] & signed[j]
    assert linked > 100


def test_drop_near_duplicates(spark, odd, empty, clashing):
    docs = clashing(odd)
    kept = N.drop_near_duplicates(docs, 4, 85)
    assert kept.columns == docs.columns
    want = sum(a == c or a is None for a, _, c in plain_near(odd_rows(), 4, 85))
    assert kept.count() == want
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).columns == empty.columns


def plain_vectors(rows, least):
    def usable(v):
        return v is not None and None not in v and np.isfinite(v).all() and np.any(v)

    links, union = defaultdict(int), Union({i for i, _, _ in rows if i is not None})
    for x, (a, la, va) in enumerate(rows):
        for b, lb, vb in rows[:x]:
            if None not in (a, b, la, lb) and a != b and la == lb and usable(va) and usable(vb) and len(va) == len(vb):
                u, v = np.array(va), np.array(vb)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                    links[a] += 1
                    links[b] += 1
                    union.join(a, b)
    return sorted([(a, links[a], a if a is None else union.find(a), a is None or union.find(a) == a) for a, _, _ in rows], key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            center = rng.normal(size=24)
            for _ in range(rng.integers(1, 12)):
                rows.append((len(rows), label, [float(np.float32(c)) for c in center + 0.18 * rng.normal(size=24)]))
    rows += [(len(rows) + i, 0, v) for i, v in enumerate([None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23])]
    rows += [(900, None, rows[0][2]), (901, 0, rows[0][2][:12]), (902, 0, rows[0][2]), (None, 0, rows[0][2])]
    return rows


VECTORS = "vec_id long, label int, embedding array<float>"


def test_vectors_equal_all_pairs(spark, vectors, clashing, monkeypatch):
    want = plain_vectors(vectors, 0.93)
    assert sum(w[1] for w in want) > 300
    frame = spark.createDataFrame(vectors, VECTORS)
    assert rows_of(E.near_vectors(frame)) == want
    doubles = clashing(frame.withColumn("embedding", F.col("embedding").cast("array<double>")))
    monkeypatch.setattr(E, "BLOCK_ROWS", 3)
    monkeypatch.setattr(E, "SMALL", 2)
    assert rows_of(E.near_vectors(doubles)) == want
    assert E.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_vector_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * side
    rows = [(i, 0, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.98 * 2 * len(a)


def plain_repeats(rows):
    seen, out = {}, []
    for doc_id, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for i in range(len(data) - 49):
            seen.setdefault(data[i:i + 50], doc_id)
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if doc_id is not None and seen[data[i:i + 50]] < doc_id:
                gone[i:i + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_equal_a_table_of_all_strings(spark, odd, empty, clashing, monkeypatch):
    assert rows_of(R.remove_repeats(clashing(odd))) == plain_repeats(odd_rows())
    assert R.remove_repeats(empty).count() == 0
    rng = random.Random(6)
    base = ["".join(rng.choice("abcd é") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [rng.choice(base)[rng.randint(0, 200):][:rng.randint(0, 150)] + "".join(rng.choice("xyz\0") for _ in range(rng.randint(0, 60)))
                 for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 50), "".join(parts), "", "", 0))
    rows += [(60, "a" * 500, "", "", 0), (61, "a" * 200, "", "", 0), (62, "ab" * 300, "", "", 0), (63, "ab" * 30, "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain_repeats(rows)
    assert rows_of(R.remove_repeats(docs)) == want
    monkeypatch.setattr(R, "HOT", 3)  # the way of very common anchors
    assert rows_of(R.remove_repeats(docs)) == want
    monkeypatch.setattr(R, "INDEX_BYTES", 500)
    monkeypatch.setattr(R, "PIECE", 120)
    assert rows_of(R.remove_repeats(docs)) == want


def test_index_gives_the_smallest_document():
    rng = random.Random(2)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 72))) for _ in range(rng.randint(1, 10))]
        texts = [t[:72] for t in texts + [t[:rng.randint(0, len(t))] + t for t in texts]]
        docs = np.array([rng.randint(0, 20) for _ in texts])
        at = np.cumsum([0, *map(len, texts)])
        found = R.RunIndex(np.frombuffer(b"".join(texts), np.uint8), at, docs).smallest()
        for i, text in enumerate(texts):
            for place in range(len(text) - 49):
                string = text[place:place + 50]
                assert found[i, place] == min(d for t, d in zip(texts, docs) if string in t)


def plain_lines(rows, percent=80):
    first, sets = {}, {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for number, line in L.lines_of(text or ""):
            first.setdefault(line, (doc_id is None, doc_id, number))
            sets[line] = {line[i:i + 8] for i in range(len(line) - 7)} if len(line) >= 8 else {line}
    names = sorted(first, key=lambda s: (first[s][0], first[s][1] or 0, first[s][2]))
    parent = Union(range(len(names)))
    for i in range(len(names)):
        for j in range(i):
            a, b = sets[names[i]], sets[names[j]]
            if 100 * len(a & b) >= percent * len(a | b):
                parent.join(i, j)
    keep = {first[names[parent.find(i)]] for i in range(len(names))}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for i, x in enumerate(lines) if not x.strip() or (doc_id is None, doc_id, i) in keep]
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_fuzzy_lines_equal_all_pairs(spark, empty, clashing):
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 25)) for _ in range(25)] + ["a", "Yes", "ab cd"]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice("abcxyz ")
            lines.append(rng.choice(["", "  "]) + "".join(line))
        rows.append((i * 2, "\n".join(lines), "", "", 0))
    rows += [(500, None, "", "", 0), (501, "", "", "", 0), (502, "\n \n", "", "", 0), (503, rows[5][1], "", "", 0), rows[5]]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(L.dedup_lines(clashing(docs))) == plain_lines(rows)
    assert L.dedup_lines(empty).count() == 0


def test_line_hashes_do_not_depend_on_the_blocks_they_are_made_in(monkeypatch):
    """Short, long and repeated lines under tiny blocks: the same hashes, keys and sets, each set sorted and distinct."""
    lines = ["a", "abcdefgh", "abcabcabcabcabcabc", "ünï" * 40, "x" * 50, "the quick brown fox jumps"] * 3
    plain = [L.shingle_hashes([line])[0] for line in lines]
    monkeypatch.setattr(L, "HASH_CHARACTERS", 16)
    monkeypatch.setattr(L, "SIGN_SHINGLES", 16)
    hashes, begins = L.shingle_hashes(lines)
    assert np.array_equal(hashes, np.concatenate(plain))
    keys = L.band_keys(hashes, begins)
    for line, key, found in zip(plain, keys, L.line_sets(pa.array([x.encode() for x in lines]))):
        assert np.array_equal(found, np.unique(line))
        x = (line >> np.uint64(32)).astype(np.uint32)
        expected = np.zeros(L.BANDS, np.uint64)
        for band in range(L.BANDS):
            k = np.full(1, band, np.uint64)
            for row in range(band * L.ROWS, (band + 1) * L.ROWS):
                k = L.mixed(k) + ((x ^ L._FLIPS[row]) * L._ODD[row]).min()
            expected[band] = L.mixed(k)[0]
        assert np.array_equal(key, expected)
    assert L.line_sets(pa.array([], pa.binary())) == []
