import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing as K
from gridloom.llm import token_counts as T
from gridloom.llm.common import lean
from gridloom.llm.tokens import PartEncoder, release
from gridloom.session import scratch_path

from .conftest import odd_rows, rows_of

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b\t c", "x　 y", "   z", "<|endoftext|> a  <|endoftext|>",
    "foo  <|endoftext|>", "e ́ é.", "\x1c \x1d a\x1cb", "a\x85 b \x85c", "don't  I'm\n\n ok", "ΑΣ Σ σ",
    " '", "᠎ a", "12 345 6", "a b c", "İstanbul", "a\nb", "\na b", "a \nb", "x.\ny, z..", ". , a.,", "A\tb \tc d", "½, ½."]


@pytest.mark.parametrize("path, spaced", [(WORDS, False), (BYTES, True)])
def test_parts_give_the_library_s_ids(path, spaced):
    rng = random.Random(8)
    texts = ODD_TEXTS + ["".join(rng.choice("ab .,\n\t'1é́") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = PartEncoder(path, spaced), PartEncoder(path, spaced, count_only=True)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(texts)] == want
        assert counts.encode(texts) == [len(w) for w in want]


def test_counts(odd, clashing, empty):
    library = Tokenizer.from_file(WORDS)
    want = []
    for doc_id, text, *_ in odd_rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 2048))
    assert rows_of(T.token_counts(odd, WORDS)) == sorted(want, key=repr)
    assert rows_of(T.token_counts(clashing(odd), WORDS)) == sorted(want, key=repr)
    assert T.token_counts(empty, WORDS).count() == 0
    assert any(w[3] for w in want)


def test_cache_encodes_only_misses(spark, odd):
    cache = scratch_path(spark, "test-cache")
    first = rows_of(T.token_counts(odd.limit(20), WORDS, cache))
    stored = T.read_cache(spark, cache, T.file_digest(WORDS)).count()
    assert stored == len({t or "" for _, t, *_ in odd_rows()[:20]})
    whole = rows_of(T.token_counts(odd, WORDS, cache))
    assert set(first) <= set(whole)
    rows = spark.read.parquet(cache)
    assert rows.count() == rows.select("digest").distinct().count() == len({t or "" for _, t, *_ in odd_rows()})
    # Another tokenizer's counts are other rows.
    T.token_counts(odd, BYTES, cache).count()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def check_plan(histogram, capacity=1024):
    rows, sequences = K.packing_plan(histogram, capacity)
    places, ranks = defaultdict(list), defaultdict(list)
    for length, rank, count, sequence, offset in rows:
        ranks[length].append((rank, count))
        for i in range(count):
            places[sequence + i].append((offset, length))
    for length, count in histogram.items():
        reached = 0
        for rank, n in sorted(ranks[length]):
            assert rank == reached
            reached += n
        assert reached == count
    for held in places.values():
        reached = 0
        for offset, length in sorted(held):
            assert offset == reached
            reached += length
        assert reached <= capacity
    assert len(places) == sequences
    return sequences


def test_plans_are_whole_and_tight():
    rng = random.Random(3)
    assert check_plan({500: 7}) == 4
    assert check_plan({3: 10_000}) == 30
    assert check_plan({342: 999, 1: 5}) == 500
    assert check_plan({}) == 0
    many = Counter()
    for _ in range(20_000):
        length = int(rng.lognormvariate(6.4, 1)) + 1
        many[length % 1024 or 1024] += 1
    bound = -(-sum(n * c for n, c in many.items()) // 1024)
    assert check_plan(dict(many)) <= 1.005 * bound


def test_packing(odd, empty, clashing):
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for doc_id, text, *_ in odd_rows():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (start, length) in enumerate(K.cut_pieces(len(ids), 1024)):
            assert length == 1024 or k == 0
            want[doc_id, k, start, length, zlib.crc32(ids[start:start + length].tobytes())] += 1
    got = K.pack(clashing(odd), BYTES).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by_sequence.values():
        reached = 0
        for offset, length in sorted(held):
            assert offset == reached
            reached += length
        assert reached <= 1024
    assert K.pack(empty, BYTES).count() == 0


def test_freed_memory_goes_back_to_the_system():
    """An executor's limit counts what idle workers keep: blocks below the largest allocation that glibc maps by itself."""
    def held():
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    blocks = [b"x" * (100_000 + i) for i in range(2000)]
    last, full = b"x" * 100_000, held()
    del blocks
    release()
    assert full - held() > 150 and len(last) == 100_000
    blocks = [b"x" * (100_000 + i) for i in range(2000)]
    last, full = b"x" * 100_000, held()
    del blocks
    assert list(lean(iter)([1, 2])) == [1, 2]
    assert full - held() > 150 and len(last) == 100_000
