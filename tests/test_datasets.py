"""The dataset store: versions, saves that break off, saves side by side, and removal."""

import pytest

from gridloom.session import scratch_path
from gridloom.sources import datasets
from gridloom.sources.datasets import Datasets


@pytest.fixture
def store(spark):
    found = Datasets(spark, scratch_path(spark, "workspace"))
    found.add("sales", spark.range(3))
    return found


def save(store, rows):
    store.add("sales", store.spark.range(rows))
    return store.save()["sales"]


def test_versions_stay_readable(store):
    assert [save(store, n) for n in (3, 5, 8)] == [1, 2, 3] == store.versions("sales")
    assert [store.load("sales", v).count() for v in (1, 2, 3)] == [3, 5, 8] and store.load("sales").count() == 8
    with pytest.raises(ValueError, match="version 9"):
        store.load("sales", 9)
    with pytest.raises(ValueError, match="nothing"):
        store.load("nothing")


def test_a_save_that_breaks_off_leaves_the_last_version(store, monkeypatch):
    """Killed before the data, between data and commit, and inside the commit."""
    save(store, 3)

    class Killed(BaseException):
        pass

    def kill(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(Datasets, "_log", kill)  # data is written, no commit
        with pytest.raises(Killed):
            save(store, 4)
    assert store.load("sales").count() == 3
    with monkeypatch.context() as m:
        real = datasets._Versions.commit

        def half(self, folder):  # the file is there, its line is not
            self.files.create(self._at(f"{self.path}/{datasets.COMMIT}{2:012d}"), False).close()
            raise Killed

        m.setattr(datasets._Versions, "commit", half)
        with pytest.raises(Killed):
            save(store, 5)
        assert real is not datasets._Versions.commit
    assert store.load("sales").count() == 3 and store.versions("sales") == [1]
    assert save(store, 6) == 3 and store.load("sales").count() == 6  # number 2 is not used again


def test_saves_side_by_side_get_numbers_of_their_own(store, monkeypatch):
    """A save that lists the versions before another one commits finds the number taken and goes on."""
    save(store, 3)
    log = store._log("sales")
    before = log._listed(datasets.COMMIT)
    assert log.commit("data-other") == 2
    monkeypatch.setattr(log, "_listed", lambda prefix: before)
    assert log.commit("data-late") == 3
    assert store._log("sales").versions() == {**store._log("sales").versions(), 2: "data-other", 3: "data-late"}


def test_tidy_keeps_what_is_named_and_what_is_young(store):
    for n in (3, 5, 8):
        save(store, n)
    store.spark.range(1).write.parquet(f"{store._path('sales')}/data-running")
    assert len(store.tidy("sales", keep=2)) == 1 and store.versions("sales") == [2, 3]
    assert store.load("sales", 2).count() == 5
    assert store.tidy("sales", keep=2, hours=0) == ["data-running"]
    assert len(store.tidy("sales")) == 1 and store.load("sales").count() == 8
    with pytest.raises(ValueError):
        store.tidy("sales", keep=0)
