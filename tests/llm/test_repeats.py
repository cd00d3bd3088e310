import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import repeats as R

from .conftest import SCHEMA, rows_of
from .test_joins import plain_repeats


def common_phrase(rng):
    """24 bytes whose hash is so small that they are the anchor of nearly all strings around them."""
    data = np.frombuffer(bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), np.uint8)
    words = R._words(data)
    count = len(data) - R.ANCHOR + 1
    h = words[:count]
    for j in range(8, R.ANCHOR, 8):
        h = R.mixed(h) + words[j:j + count]
    best = int(R.mixed(h).argmin())
    return data[best:best + R.ANCHOR].tobytes().decode()


def contexts(rng, phrase, count):
    """Texts with one phrase and different letters around it; some strings that hold the phrase recur."""
    sides = [["".join(rng.choices("abcdefghij", k=n)) for _ in range(40)] for n in (26, 3)]
    return ["".join([*rng.choices("klmnopqrst", k=4), rng.choice(sides[0]), phrase, rng.choice(sides[1]), *rng.choices("klmnopqrst", k=27)])
            for _ in range(count)]


def test_one_anchor_of_many_contexts(spark):
    rng = random.Random(11)
    texts = contexts(rng, common_phrase(rng), 60_000)
    ids = rng.sample(range(1_000_000), len(texts))
    rows = [(i, t, "", "", 0) for i, t in zip(ids, texts)]
    got = rows_of(R.remove_repeats(spark.createDataFrame(rows, SCHEMA)))
    want = plain_repeats(rows)
    assert sum(w[2] for w in want) > 2_000_000
    assert got == want


def test_an_index_beyond_packed_ranks():
    rng = random.Random(12)
    texts = [t[4:76].encode() for t in contexts(rng, common_phrase(rng), 50_000)]
    docs = np.array([rng.randint(0, 1 << 40) for _ in texts])
    smallest = {}
    for t, d in zip(texts, docs.tolist()):
        for i in range(len(t) - 49):
            smallest[t[i:i + 50]] = min(d, smallest.get(t[i:i + 50], d))
    at = np.cumsum([0, *map(len, texts)])
    assert at[-1] > R.PACKED
    found = R.RunIndex(np.frombuffer(b"".join(texts), np.uint8), at, docs).smallest()
    assert found[:, :23].tolist() == [[smallest[t[i:i + 50]] for i in range(23)] for t in texts]


def shipped(spark, texts, monkeypatch):
    """What goes to the anchors' tasks: text, hot."""
    seen = []
    real = R._repeated_segments

    def watched(maps, bits):
        seen.append((maps, bits))
        return real(maps, bits)

    monkeypatch.setattr(R, "_repeated_segments", watched)
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(R.remove_repeats(docs)) == plain_repeats(rows)
    source = docs.select("doc_id", F.lit(0).cast("long").alias("row_key"), F.col("text").cast("binary").alias("bytes"))
    return source.mapInArrow(real(*seen[-1]), "anchor long, lead int, context binary, doc_id long, row_key long, start long, hot boolean")


def test_a_run_of_one_period_is_a_few_rows(spark, monkeypatch):
    texts = ["=" * 300_000, "x" + "=" * 200_000 + "y", "0,0,0," * 20_000, " 0,0,0," + "0,0,0," * 9_000]
    assert shipped(spark, texts, monkeypatch).count() < 300


def test_an_anchor_is_hot_by_its_rows(spark, monkeypatch):
    rng = random.Random(13)
    around = contexts(rng, common_phrase(rng), 600)
    texts = [" ".join(around[:300]), " ".join(around[300:])]
    monkeypatch.setattr(R, "HOT", 100)
    rows = shipped(spark, texts, monkeypatch)
    cold = rows.where("not hot").groupBy("anchor").count().agg(F.max("count")).first()[0] or 0
    assert rows.where("hot").count() > 500 and cold < 2 * R.HOT


def test_short_texts_hashed_together_give_the_pieces_of_each(monkeypatch):
    """Texts of 0 to 400 bytes, some equal, some of one letter, beside a long one: as if each were cut by itself."""
    rng = random.Random(5)
    monkeypatch.setattr(R, "PIECE", 1000)
    texts = [bytes(rng.choice(b"abcd \n") for _ in range(n)) for n in (0, 10, 49, 50, 51, 400, 73, 0, 260, 49, 900, 999, 2500, 50, 50)]
    texts += [b"x" * 300, texts[5], b"", texts[8][:200] + texts[5][100:], bytes(120)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    alone = [(i, p) for i, t in enumerate(texts) for p in R.pieces(np.frombuffer(t, np.uint8))]
    found = list(R.text_pieces(data, at))
    assert [i for i, _ in found] == [i for i, _ in alone] and len(found) > len(texts) - 6
    for (_, p), (_, q) in zip(found, alone):
        assert all(np.array_equal(x, y) for x, y in zip(p[:4], q[:4])) and p[5] == q[5]
        assert np.array_equal(p[4][:len(q[4])], q[4])
    few = list(R.text_pieces(data, at, lambda anchor: anchor % np.uint64(3) == 0))
    thirds = [(i, p[0][p[0] % np.uint64(3) == 0]) for i, p in alone]
    assert [(i, p[0].tolist()) for i, p in few] == [(i, a.tolist()) for i, a in thirds if len(a)]
