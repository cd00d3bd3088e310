import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import exact_dedup as X

from .conftest import SCHEMA, odd_rows, rows_of


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids) if ids else None
        data = (text or "").encode()
        out.append((doc_id, keep, len(groups[text or ""]), doc_id == keep, hashlib.sha256(data).hexdigest(), len(data)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes", [64, 1 << 20])
def test_equals_grouping_by_text(odd, chunk_bytes):
    assert rows_of(X.exact_groups(odd, chunk_bytes)) == plain(odd_rows())


def test_empty_and_clashing(spark, odd, empty, clashing):
    assert X.exact_groups(empty).count() == 0
    assert X.drop_exact_duplicates(empty).columns == empty.columns
    assert rows_of(X.exact_groups(clashing(odd))) == rows_of(X.exact_groups(odd))
    kept = X.drop_exact_duplicates(clashing(odd))
    assert kept.columns == clashing(odd).columns
    assert kept.count() == len({t or "" for _, t, *_ in odd_rows()})


def test_hash_is_the_polynomial_and_chunks_compose():
    rng = random.Random(4)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 255, 256, 257, 1000)]
    at = np.cumsum([0, *map(len, texts)])
    got = X.polynomial_hashes(np.frombuffer(b"".join(texts), np.uint8), at)
    for text, row in zip(texts, got):
        for base, value in zip(X.BASES, row):
            want = 0
            for byte in text:
                want = (want * base + byte) % X.PRIME
            assert int(value) == want
    left, right = texts[3], texts[5]
    whole = X.polynomial_hashes(np.frombuffer(left + right, np.uint8), np.array([0, len(left) + len(right)]))[0]
    parts = [got[3], got[5]]
    for k, base in enumerate(X.BASES):
        assert int(whole[k]) == (int(parts[0][k]) * pow(base, len(right), X.PRIME) + int(parts[1][k])) % X.PRIME


def test_unequal_texts_in_one_fingerprint_are_split(spark, monkeypatch):
    monkeypatch.setattr(X, "fingerprints", lambda docs, size, f=X.fingerprints: f(docs, size).selectExpr(
        "doc_id", "text_sha256", "n_bytes", "copies", "0L as h1", "0L as h2", "0L as h3", "0L as h4"))
    docs = spark.createDataFrame([(1, "ab", "", "", 0), (2, "cd", "", "", 0), (3, "ab", "", "", 0)], SCHEMA)
    assert [r[:4] for r in rows_of(X.exact_groups(docs))] == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]


def test_a_large_group_stays_whole(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', cast(id as string)) as text")
    got = X.exact_groups(docs).where("doc_id % 3 = 0").selectExpr("min(keep_id)", "max(keep_id)", "min(group_size)").first()
    assert tuple(got) == (4998, 4998, 1667)
