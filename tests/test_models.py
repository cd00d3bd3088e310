"""Leak-free pipelines, candidates, leaderboard, importance, scoring and saved models."""

import random
import threading

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gridloom.operators.models import (
    CLASSIFIERS, REGRESSORS, ModelSpec, candidates, fit_model, fit_prepared, load_model, save_model, score_rows, with_score,
)
from gridloom.operators.rank import embedded_scores, tree_scores, unify, variance_filter
from gridloom.plans.leaderboard import cross_validate, leaderboard, permutation_importance, permuted
from gridloom.operators.split import kfold
from gridloom.session import scratch_path


@pytest.fixture(scope="module")
def colors(spark):
    """The label follows from the color alone."""
    rng = random.Random(0)
    rows = []
    for i in range(150):
        color = rng.choice(["red", "green", "blue"])
        rows.append((i, color, rng.gauss(0, 1), int(color == "red")))
    return spark.createDataFrame(rows, "key long, color string, noise double, label int").cache()


@pytest.mark.parametrize("name", ["log_reg", "rf", "knn", "svm", "nb", "mlp", "gbt"])
def test_classifiers_learn_a_category(colors, name):
    params = {"rf": {"numTrees": 20}, "gbt": {"maxIter": 5}, "mlp": {"maxIter": 60}, "knn": {"k": 3}}.get(name, {})
    model = fit_model(colors, CLASSIFIERS[name], ["color", "noise"], "label", classes=2, **params)
    right = with_score(model.transform(colors)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.95


@pytest.mark.parametrize("name", ["lin_reg", "rf_reg", "knn_reg", "gbt_reg"])
def test_regressors_follow_a_line(spark, name):
    df = spark.range(120).select("id", (F.col("id") / 10.0).alias("x"), (F.col("id") * 3.0 + 1).alias("y"))
    params = {"rf_reg": {"numTrees": 10}, "gbt_reg": {"maxIter": 10}}.get(name, {})
    model = fit_model(df, REGRESSORS[name], ["x"], "y", **params)
    worst = model.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert worst < (1e-3 if name == "lin_reg" else 40)


def test_unseen_level_and_missing_number_are_scored(spark, colors):
    model = fit_model(colors, CLASSIFIERS["log_reg"], ["color", "noise"], "label", classes=2)
    new = spark.createDataFrame([("purple", 0.0), (None, None), ("red", 1.0)], "color string, noise double")
    scored = score_rows(model, new, ["color", "noise"], "label", classes=["no", "yes"])
    assert scored.columns == ["color", "noise", "predicted_label"]
    assert [r["predicted_label"] for r in scored.collect()][2] == "yes"
    with pytest.raises(ValueError, match="noise"):
        score_rows(model, new.drop("noise"), ["color", "noise"], "label")


def test_many_classes_use_one_vs_rest(spark):
    df = spark.range(90).select("id", (F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 3).cast("string").alias("g"))
    for name, params in (("svm", {"maxIter": 20}), ("gbt", {"maxIter": 3})):
        model = fit_model(df, CLASSIFIERS[name], ["g"], "label", classes=3, **params)
        assert model.transform(df).where("prediction = label").count() == 90


@pytest.mark.parametrize("name", ["nb", "knn"])
def test_saved_models_predict_the_same(spark, colors, name):
    model = fit_model(colors, CLASSIFIERS[name], ["color", "noise"], "label", classes=2)
    path = scratch_path(spark, "model")
    save_model(model, path)
    pick = lambda m: sorted((r["key"], r["prediction"]) for r in m.transform(colors).select("key", "prediction").collect())
    assert pick(load_model(path)) == pick(model)


def test_candidates_follow_the_shape():
    def doubtful(*shape):
        found = candidates(*shape)
        assert [c.spec.name for c in found] == list(CLASSIFIERS if shape[0] == "classification" else REGRESSORS)
        assert all((c.reason is None) == c.recommended for c in found)
        return {c.spec.name for c in found if not c.recommended}

    assert doubtful("classification", 5000, 5, 1) == set() and doubtful("classification", 500, 5, 1) == {"gbt"}
    assert doubtful("classification", 5000, 201, 1) == {"svm"} and doubtful("classification", 5000, 501, 1) == {"svm", "knn"}
    assert doubtful("classification", 5000, 5, 0) == {"nb"} and doubtful("regression", 10, 2, 0) == {"gbt_reg"}


def test_leaderboard_ranks_and_names_failures(colors):
    table = leaderboard(
        colors, [CLASSIFIERS["nb"], CLASSIFIERS["log_reg"], CLASSIFIERS["mlp"]], ["color", "noise"], "label", ["key"],
        classes=2, folds=2, params={"mlp": {"layers": [1, 2]}},  # does not fit the features
    )
    found = table.collect()
    assert [r["place"] for r in found] == [1, 2, 3] and {r["model"] for r in found[:2]} == {"nb", "log_reg"}
    assert found[2]["model"] == "mlp" and found[2]["error"] and found[2]["roc_auc"] is None
    assert found[0]["error"] is None
    assert found[0]["roc_auc"] >= found[1]["roc_auc"] > 0.95


def test_penalty_follows_the_rows(spark):
    """A unit penalty: twice the rows weigh twice as much against it, so repeated rows sharpen the fit."""
    df = spark.range(40).selectExpr("cast(id % 2 as double) as label", "cast(id % 2 as double) + 0.5 * (id % 3) as x")

    def slope(rows):
        model = fit_model(rows, CLASSIFIERS["log_reg"], ["x"], "label", classes=2)
        return abs(model.stages[-1].coefficients[0])

    once, often = slope(df), slope(df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("n"))
    assert often > 1.3 * once


def test_time_folds_score_a_regression(spark):
    df = spark.range(80).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    table = leaderboard(df, [REGRESSORS["lin_reg"]], ["x"], "y", ["id"], folds=3, time="id").first()
    assert table["rmse"] < 1e-3 and table["r2"] > 0.999


def test_cross_validation_covers_every_fold(colors):
    folded = kfold(colors, ["key"], 2)
    found = cross_validate(folded, CLASSIFIERS["nb"], ["color", "noise"], "label", 2, 2)
    assert {row[1] for row in found} == {0, 1} and {"f1", "roc_auc"} <= {row[2] for row in found}


def test_permutation_keeps_the_values(colors):
    mixed = permuted(colors, ["color", "noise"], ["key"], repeats=2)
    assert mixed.count() == 150 * 4
    noise = lambda d: sorted(r["noise"] for r in d.collect())
    one = mixed.where("feature = 'noise' and repeat = 1")
    assert noise(one) == noise(colors)
    moved = one.join(colors.select("key", F.col("noise").alias("old")), "key").where("noise <> old").count()
    assert moved > 140


def test_permutation_importance_finds_the_cause(colors):
    model = fit_model(colors, CLASSIFIERS["nb"], ["color", "noise"], "label", classes=2)
    ranked = permutation_importance(model, colors, ["color", "noise"], "label", ["key"], "classification", repeats=2).collect()
    assert ranked[0]["feature"] == "color" and ranked[0]["importance"] > 0.2 > abs(ranked[1]["importance"])


def test_feature_scores(colors):
    tables = embedded_scores(colors, ["color", "noise"], "label", "classification", trees=10, depth=4)
    best = unify(tables).collect()
    assert {r["feature"] for r in best} == {"color", "noise"}
    trees = {r["feature"]: r["score"] for r in tree_scores(colors, ["color", "noise"], "label", "classification", 10, 4).collect()}
    assert trees["color"] > trees["noise"]
    assert variance_filter(colors, ["noise"], 0.0).count() == 0 and variance_filter(colors, ["noise"], 0.1).count() == 1


def test_sets_of_one_model_are_fitted_side_by_side(spark):
    """Every fit waits until the other has begun; the models stand in the order of their sets."""
    begun = threading.Barrier(2)

    class Waits(LinearRegression):
        def _fit(self, df):
            begun.wait(60)
            return super()._fit(df)

    def rows(slope):
        return spark.range(20).select(
            array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") * slope).cast("double").alias("label"))

    spec = ModelSpec("line", "regression", lambda d, k, p: [Waits(**p)])
    fitted = fit_prepared(spec, [rows(2), rows(5)], [1, 1], 0, {})
    assert [round(float(m.stages[-1].coefficients[0]), 6) for m in fitted] == [2.0, 5.0]
