"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

from gridloom.session import local_session, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns named like columns that operators use inside.
CLASHING = ("row", "id", "size", "bytes", "score", "component", "node", "take", "n", "label", "hub", "digest")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    return session


def words(rng, count):
    return " ".join(rng.choice("the of and alpha beta gamma delta river stone cloud seven lamp tower".split()) + str(rng.randint(0, 40))
                    for _ in range(count))


def odd_rows(seed=0, count=40):
    """(doc_id, text, lang, source, n_chars): random texts, copies, near copies, and the odd cases."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(count)]
    texts += [texts[0], texts[0], texts[3], texts[5] + " tail", "\n".join([texts[6], texts[7], texts[6]])]
    texts += [None, "", " ", "\n\n", "a", "A a A a A a", "é", "x" * 3000, words(rng, 6000), texts[1].upper()]
    rows = [(i * 3, t, "en", rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[2], "en", "s1", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing():
    from pyspark.sql import functions as F

    def add(df):
        return df.select("*", *[F.lit(f"extra-{c}").alias(c) for c in CLASHING if c not in df.columns])

    return add


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
