import numpy as np
import pytest

from gridloom.llm import neighbour_graph as N

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every, k):
    named = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        if i not in named or v < named[i]:
            named[i] = v
    out = {}
    for q, v in named.items():
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in named.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


def test_small_and_odd_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist(), 1) for i in range(60)]
    rows += [(100 + i, rows[4][1], 1) for i in range(45)]  # copies: ties go to smaller ids
    rows += [(200, None, 1), (201, [0.0] * 6, 1), (220, [float("nan")] * 6, 1), (240, [], 1), (None, rows[1][1], 1), (260, [None] * 6, 1)]
    rows += [(300 + i, rng.normal(size=3).tolist(), 1) for i in range(8)]  # another length
    rows += [rows[0], (7, [9.0] * 6, 1)]
    got = found(N.nearest_vectors(spark.createDataFrame(rows, SCHEMA)))
    want = plain(rows, 20, 20)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], rtol=1e-12)


def test_empty_and_clashing(spark):
    assert N.nearest_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(1, 45)], SCHEMA)
    extra = df.selectExpr("*", *[f"'x' as {c}" for c in ("vector", "node", "ids", "nbrs", "sims", "code", "at", "score")])
    assert found(N.nearest_vectors(extra)) == found(N.nearest_vectors(df))


def test_recall_on_random_vectors_with_a_crowd_and_unequal_norms(spark, monkeypatch):
    """Random directions are the hardest case; a third of the rows are near copies of one vector."""
    monkeypatch.setattr(N, "CROWD", 100)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32)) * rng.lognormal(0, 0.3, size=(4000, 1))
    x[::3] = x[0] + rng.normal(size=(len(x[::3]), 32)) * 0.05
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], SCHEMA)
    got = found(N.nearest_vectors(df))
    asked = np.arange(0, 4000, 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {int(q): [(int(i), 0) for i in np.argsort(-s, kind="stable")[:20]] for q, s in zip(asked, scores)}
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    assert recall(got, want) >= 0.9
    for q in got:
        assert np.allclose([s for _, s in got[q]], [x[q] @ x[i] for i, _ in got[q]])


def test_codes_keep_angles_and_norms():
    x = np.random.default_rng(1).normal(size=(50, 16)) * 1e6
    unit, norm = N.decode(N.encode(x))
    assert np.allclose(norm, np.linalg.norm(x, axis=1), rtol=1e-6)
    assert np.abs(unit - x / np.linalg.norm(x, axis=1)[:, None]).max() < 1e-4


@pytest.mark.parametrize("count", [None, 0, 1, 2])
def test_first_flags_of_lists(count):
    flags, sizes = np.array([1, 1, 0, 1, 0, 0, 1], bool), np.array([4, 0, 2, 1])
    want = {None: flags, 0: np.zeros(7, bool), 1: np.array([1, 0, 0, 0, 0, 0, 1], bool), 2: np.array([1, 1, 0, 0, 0, 0, 1], bool)}
    assert N._first(flags, sizes, count).tolist() == want[count].tolist()
