import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import vector_codes as V

from .conftest import rows_of

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_nearest(parts, book):
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in book] for x in parts]
    return [min(range(len(book)), key=lambda e: (row[e], e)) for row in far], [min(row) for row in far]


def plain(rows, entries, rounds, parts=4):
    kept = [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in rows
            if v is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    cuts = [i * size // parts for i in range(parts + 1)]
    books, codes, errors = [], [""] * len(kept), [0] * len(kept)
    for a, b in zip(cuts, cuts[1:]):
        mine = [r[1][a:b] for r in kept]
        book = [list(x) for x in mine[:entries]]
        for _ in range(rounds):
            chosen, _ = plain_nearest(mine, book)
            for e in set(chosen):
                members = [x for x, c in zip(mine, chosen) if c == e]
                book[e] = [sum(col) // len(members) for col in zip(*members)]
        chosen, far = plain_nearest(mine, book)
        codes = [c + f"{e:02x}" for c, e in zip(codes, chosen)]
        errors = [x + y for x, y in zip(errors, far)]
        books.append(book)
    digest = hashlib.sha256(",".join(str(v) for book in books for row in book for v in row).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, c, e, by_label[label], digest) for (i, _, label), c, e in zip(kept, codes, errors)), key=repr)


def vectors(seed, count, size=8, levels=5):
    rng = random.Random(seed)
    rows = [(i * 2, [rng.randint(-levels, levels) / 7 for _ in range(size)], rng.choice([1, 2, None])) for i in range(count)]
    return rows + [(1001, None, 1), (1003, [None] * size, 1), (1005, [float("nan")] * size, 1), (1007, [float("inf")] + [0.0] * (size - 1), 2),
                   (1009, [], 1), (1011, [1.0], 1), (1013, [0.0] * size, None), (None, [0.5] * size, 3), rows[3], rows[3]]


@pytest.mark.parametrize("size", [8, 10])
def test_equals_plain_rounds(spark, size):
    rows = vectors(size, 120, size)
    got = rows_of(V.compress(spark.createDataFrame(rows, SCHEMA), entries=16))
    assert got == plain(rows, 16, 4)


@pytest.mark.parametrize("leaves", [1, 3, 50, 10_000])
def test_trie_finds_the_nearest_entries(leaves):
    rng = np.random.default_rng(leaves)
    for levels, dims in ((2, 6), (40, 5), (1, 1), (3, 0)):
        parts, place = V._sorted_distinct(rng.integers(-levels, levels + 1, (300, dims)))
        assert len(place) == 300 and [tuple(p) for p in parts] == sorted(set(map(tuple, parts)))
        book = rng.integers(-levels, levels + 1, (9, dims))
        entry, error = V.nearest_entries(parts, book, leaves)
        assert (entry.tolist(), error.tolist()) == plain_nearest(parts.tolist(), book.tolist())


def test_large_components_stay_exact():
    parts, _ = V._sorted_distinct(np.array([[2**26, -2**26, 5], [2**26, -2**26, 6], [0, 1, 2]]))
    book = np.array([[2**26, -2**26, 4], [-2**26, 2**26, 0]])
    entry, error = V.nearest_entries(parts, book, 1)
    assert (entry.tolist(), error.tolist()) == plain_nearest(parts.tolist(), book.tolist())


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert V.compress(empty).count() == 0
    rows = vectors(1, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.selectExpr("*", *[f"'x' as {c}" for c in ("vector", "position", "part", "entry", "n", "total", "code", "error", "rows")])
    assert rows_of(V.compress(extra)) == rows_of(V.compress(df))
    huge = spark.createDataFrame([(1, [1e300, -1e300], 1), (2, [0.0, 0.0], 1)], SCHEMA)
    assert V.compress(huge).count() == 2
