"""CSV with quoted line ends, read in byte ranges, against Python's csv module."""

import csv
import io
import random

import pytest

from gridloom.session import scratch_path
from gridloom.sources import records as R
from gridloom.sources.files import read_csv, write_csv


@pytest.fixture
def ranges(spark):
    """Set the bytes of a range for one test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        for name, value in zip(names, (size, 1, 1)):
            spark.conf.set(name, str(value))

    yield use
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def field(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice('a"\n,é x') for _ in range(rng.randint(0, 12)))
    if kind < 0.35:
        return "\n".join(["long"] * rng.randint(50, 900))  # longer than a range
    return rng.choice(["plain", "two words", "", '"', '""', 'said "no"', "5 inch", "\n", ",\n,"])


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL).writerows([("k", "a", "b"), *rows])
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [97, 1000, 1 << 27])
def test_records_of_any_ranges(spark, tmp_path, ranges, size, end):
    rng = random.Random(size)
    want = []
    for f in range(3):
        rows = [(f"{f}-{i}", field(rng), field(rng)) for i in range(60)]
        (tmp_path / f"{f}.csv").write_text(written(rows, end), newline="", encoding="utf-8")
        want += rows
    ranges(size)
    df = read_csv(spark, f"file://{tmp_path}")
    assert df.columns == ["k", "a", "b"]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert R.lines_of(spark, f"file://{tmp_path}").rdd.getNumPartitions() > (100 if size == 97 else 0)


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    path = f"file://{tmp_path}/one"
    src = spark.range(60_000).selectExpr("id", """concat('line "', id, '"\n, second ', repeat('x', 40), '\n') as text""")
    write_csv(src.coalesce(1), path)
    ranges(100_000)
    assert R.lines_of(spark, path).rdd.getNumPartitions() >= 40
    back = read_csv(spark, path)
    assert back.count() == 60_000 and back.join(src, ["id", "text"]).count() == 60_000


def test_without_a_broadcast_of_the_ranges(spark, tmp_path, ranges, monkeypatch):
    rng = random.Random(5)
    rows = [(str(i), field(rng), field(rng)) for i in range(80)]
    (tmp_path / "x.csv").write_text(written(rows), newline="", encoding="utf-8")
    ranges(200)
    monkeypatch.setattr(R, "broadcastable", lambda df: False)
    assert sorted((str(r["k"]), r["a"], r["b"]) for r in read_csv(spark, f"file://{tmp_path}").collect()) == sorted(rows)


def test_quotes_inside_unquoted_fields_are_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,a\n1,5" pipe\n2,"a\nb"\n3,x"y"z\n\n4,\n')
    got = sorted(tuple(r) for r in read_csv(spark, f"file://{tmp_path}").collect())
    assert got == [(1, '5" pipe'), (2, "a\nb"), (3, 'x"y"z'), (4, None)]


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a""', True, False), ('"a"",b",c', False, False),
    ('x,"y', True, False), ('"x","', True, True), ('""', False, True), ('"', True, False), ("", False, True), (',"",', False, True)])
def test_line_ends(line, outside, inside):
    assert (R.ends_inside(line, False), R.ends_inside(line, True)) == (outside, inside)
