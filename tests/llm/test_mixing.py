import re
from collections import defaultdict

from gridloom.llm import mixing as M

from .conftest import SCHEMA, odd_rows, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Raise one common level per unit of weight; sources stop at three times their size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    return target


def check(rows, got):
    sizes, taken, most = defaultdict(int), defaultdict(int), 0
    for _, text, _, source, _ in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        most = max(most, n)
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most
    assert sum(taken.values()) <= sum(sizes.values())


def test_targets_and_taken_words(odd):
    check(odd_rows(), M.shares(odd).collect())


def test_small_sources_stop_at_three_epochs(spark):
    rows = [(i, "w " * (3 + i % 5), "", "a" if i < 3 else "b" if i < 300 else "c", 0) for i in range(400)]
    check(rows, M.shares(spark.createDataFrame(rows, SCHEMA)).collect())


def test_reruns_agree_whatever_the_partitions(odd):
    first = rows_of(M.shares(odd.repartition(3)))
    assert first == rows_of(M.shares(odd.repartition(7)))


def test_mix_is_sorted_by_finish_time(odd):
    finish = [r["finish"] for r in M.mix(odd).collect()]
    assert finish == sorted(finish)


def test_mixed_documents_repeat_rows(odd, clashing):
    docs = clashing(odd)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect())
    assert words == sum(r["taken"] for r in M.shares(odd).collect())


def test_empty(empty, spark):
    assert M.shares(empty).count() == 0
    assert M.mixed_documents(empty).columns == empty.columns
    blank = spark.createDataFrame([(1, None, "", "s", 0), (2, " ", "", None, 0)], SCHEMA)
    assert [r["taken"] for r in M.shares(blank).collect()] == [0, 0]
