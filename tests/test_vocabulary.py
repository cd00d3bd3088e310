"""Names of a vocabulary table against all pairs."""

import random

import pytest

from gridloom.functions.text import closest_names as listed_names
from gridloom.operators import vocabulary as V
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edits(word, name):
    swaps = [name[:i] + name[i + 1] + name[i] + name[i + 2:] for i in range(len(name) - 1)]
    return min([distance(word, name), *(distance(word, s) + 1 for s in swaps)])


def spoiled(rng, word):
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(word))
        word = rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("abc") + word[i:], word[:i] + word[i + 1:i + 2] + word[i:i + 1] + word[i + 2:],
                           word[:i] + rng.choice("abc") + word[i + 1:]]) or "a"
    return word


@pytest.mark.parametrize("cutoff", [0.8, 0.7])
def test_index_loses_no_close_pair(spark, cutoff):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 24))) for _ in range(150)})
    words = sorted({spoiled(rng, n) for n in names} | {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 20))) for _ in range(60)})
    want = sorted((w, n) for w in words for n in names if 1 - edits(w, n) / max(len(w), len(n)) >= cutoff)
    got = V.close_pairs(spark.createDataFrame([(w,) for w in words], "word string"),
                        spark.createDataFrame([(n, n) for n in names], "name string, plain string"), cutoff)
    assert sorted((r["word"], r["name"]) for r in got.collect()) == want and len(want) > 100


def test_index_drops_no_more_letters_than_slips_are_allowed(spark):
    """A name of 14 letters allows 2 slips at 0.8: 1 + 14 + 91 keys; and those meet a name that is longer by its slips."""
    names = spark.createDataFrame([("abcdefghijklmn",), ("abcdefgh",), ("abcd",)], "name string")
    most = names.select("name", V._keys(F.col("name"), 0.8, V.SHORT).alias("keys")).collect()
    assert {r["name"]: len(r["keys"]) for r in most} == {"abcdefghijklmn": 106, "abcdefgh": 9, "abcd": 1}
    vocabulary = names.select("name", F.col("name").alias("plain"))
    words = ["abcdxe", "abcde", "xabcxdefghijxklmn", "abcdefghijklmnxyz", "bacdefghijkmln", "abcdefghxx", "abcdefxgxhx"]
    found = V.close_pairs(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary, 0.8)
    assert {(r["word"], r["name"]) for r in found.collect()} == {
        (w, r["name"]) for w in words for r in names.collect()
        if 1 - edits(w, r["name"]) / max(len(w), len(r["name"])) >= 0.8}


@pytest.mark.parametrize("cutoff", [0.8, 0.7])
def test_only_lengths_that_can_be_close_are_indexed(cutoff):
    for given in ([], [1], [4, 9], [17], [30]):
        assert V._short_lengths(given, cutoff) == [n for n in range(1, V.SHORT + 1) if any(
            1 - abs(n - m) / max(n, m) >= cutoff for m in given)]


def test_same_names_as_from_a_list(spark):
    names = ["BMI", "weight", "Height", "order_total", "wait", ""]
    questions = ["bmi vs wieght", "heigth and weight, weight", "order total", "nothing", "ordertotal", "wieghts", "", None]
    df = spark.createDataFrame(list(enumerate(questions)), "i int, q string")
    table = spark.createDataFrame([(n, p) for p, n in enumerate(names)], "n string, p int")
    got = {}
    for r in sorted(V.closest_names(df, "i", "q", table, "n", "p").collect(), key=lambda r: (r["i"], r["position"])):
        got.setdefault(r["i"], []).append(r["name"])
    want = df.select("i", listed_names(F.col("q"), names[:-1]).alias("v")).collect()
    assert got == {r["i"]: r["v"] for r in want if r["v"]}


@pytest.mark.parametrize("share_bytes", [1 << 20, 100])
def test_mentions(spark, share_bytes):
    names = ["Unit Price", "BMI", "order_date", "!!", "e", None, "BMI"]
    texts = ["price per unit", "the BMI-index", "dates reordered", "order the date", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, q string")
    table = spark.createDataFrame([(n,) for n in names], "n string")
    got = sorted((r["i"], r["name"]) for r in V.mentions(df, "i", "q", table, "n", share_bytes).collect())
    assert got == [(0, "Unit Price"), (0, "e"), (1, "BMI"), (1, "e"), (2, "e"), (3, "e"), (3, "order_date")]


def test_plan_does_not_grow_with_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "some text")], "i long, q string")

    def plan(count):
        table = spark.range(count).selectExpr("concat('name', id) as n", "id as p")
        return len(V.closest_names(df, "i", "q", table, "n", "p")._jdf.queryExecution().toString())

    assert plan(5000) < 1.2 * plan(5)
