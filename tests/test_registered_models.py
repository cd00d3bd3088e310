"""The registered fits and leaderboards run the whole job."""

import inspect

import pytest

from gridloom.catalog import models
from gridloom.operators.models import CLASSIFIERS, REGRESSORS


def called(monkeypatch, name, build):
    """The arguments of the one call of an operator that a query makes."""
    real, seen = getattr(models, name), []

    def watched(*args, **kwargs):
        seen.append(inspect.signature(real).bind(*args, **kwargs))
        raise InterruptedError

    monkeypatch.setattr(models, name, watched)
    for helper in ("labelled_documents", "documents_split", "random_split"):
        if hasattr(models, helper):
            monkeypatch.setattr(models, helper, lambda *a: Rows())
    with pytest.raises(InterruptedError):
        build(lambda table: Rows())
    return seen[0]


class Rows:
    def __iter__(self):
        return iter((self, self))

    def where(self, _):
        return self


@pytest.mark.parametrize("build, pool", [
    (models.class_board, CLASSIFIERS), (models.number_board, REGRESSORS), (models.time_board, REGRESSORS)])
def test_leaderboards_run_every_candidate(monkeypatch, build, pool):
    call = called(monkeypatch, "leaderboard", build)
    assert [s.name for s in call.arguments["specs"]] == list(pool)
    call.apply_defaults()
    assert call.arguments["folds"] == 3 and not call.arguments["params"]


@pytest.mark.parametrize("build", [models.boosted, models.boosted_regressor])
def test_boosted_trees_run_every_round(monkeypatch, build):
    assert not called(monkeypatch, "fit_model", build).arguments.get("params")
