"""Ridge recovery, ablation, imputation, cross-validation and explanations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import explain as ex
from cohortlab.operators import folds as fd
from cohortlab.operators import linear as ln
from cohortlab.operators import models as md


@pytest.fixture(scope="module")
def normal_rows(spark):
    values = np.random.RandomState(0).normal(1, 3, (10000, 3))
    frame = pd.DataFrame(values, columns=["X0", "X1", "X2"])
    frame["id"] = np.arange(len(frame))
    return spark.createDataFrame(frame)


def labelled(rows, coefficients, intercept=1.0):
    y = F.lit(intercept)
    for i, c in enumerate(coefficients):
        y = y + F.lit(float(c)) * F.col(f"X{i}")
    return rows.withColumn("y", y)


@pytest.mark.parametrize("positive,coefficients", [(True, [0, 1, 2]), (False, [-1, 0, 1])])
def test_ridge_recovers_coefficients(normal_rows, positive, coefficients):
    rows = labelled(normal_rows, coefficients)
    model = ln.fit_ridge(rows, ["X0", "X1", "X2"], "y", positive=positive, scaling=False, imputing=False)
    np.testing.assert_allclose(list(model.coefficients.values()), coefficients, atol=1e-6)
    assert model.intercept == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("chosen", [None, ["X2"], ["X1", "X2"], ["X0", "X1", "X2"]])
def test_ablated_model_contributes_chosen_features_only(normal_rows, chosen):
    rows = labelled(normal_rows, [-0.2, 0, 0.2])
    model = ln.fit_ridge(rows, ["X0", "X1", "X2"], "y", scoring_features=chosen, imputing=False)
    found = ex.linear_contributions(rows.limit(5), model, ["id"]).select("feature").distinct().collect()
    assert sorted(r[0] for r in found) == (chosen or ["X0", "X1", "X2"])


def test_unknown_scoring_feature_is_refused(normal_rows):
    with pytest.raises(ValueError):
        ln.fit_ridge(labelled(normal_rows, [1, 1, 1]), ["X0", "X1"], "y", scoring_features=["X2"])


def test_nonnegative_solution_meets_optimality_conditions():
    rng = np.random.RandomState(3)
    for _ in range(30):
        x = rng.normal(size=(50, 8))
        gram, cross = x.T @ x, x.T @ rng.normal(size=50)
        w = ln._nonnegative_solution(gram, cross)
        slope = gram @ w - cross
        assert (w >= 0).all()
        assert slope.min() > -1e-8
        assert np.abs(slope[w > 0]).max(initial=0) < 1e-8


def test_imputation(spark):
    n = None
    rows = spark.createDataFrame(
        [(1, 1, 1.0, 1.0, 1.0, 1.0), (1, 2, 1.0, 1.0, 1.0, 2.0), (2, 1, 2.0, 2.0, n, n),
         (2, 2, 2.0, 2.0, n, 1.0), (3, 1, 3.0, n, n, 2.0), (3, 2, 3.0, n, n, n)],
        "target_id int, disease_id int, target__static_1 double, target__static_2 double, target__static_3 double, "
        "target__clinical__non_static double",
    )
    features = rows.columns[2:]
    found = [tuple(r)[2:] for r in ln.impute(rows, features).orderBy("target_id", "disease_id").collect()]
    assert found == [
        (1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 2.0), (2.0, 2.0, 1.0, 0.0),
        (2.0, 2.0, 1.0, 1.0), (3.0, 1.5, 1.0, 2.0), (3.0, 1.5, 1.0, 0.0),
    ]


def test_positive_model_leaves_out_its_intercept(spark):
    rows = spark.createDataFrame([(0.2,), (5.0,)], "x double")
    free = ln.LinearModel("free", {"x": 0.5}, intercept=0.3, positive=False)
    held = ln.LinearModel("held", {"x": 0.5}, intercept=0.3, positive=True)
    found = held.predict(free.predict(rows)).collect()
    assert [r["free"] for r in found] == [pytest.approx(0.4), 1.0]
    assert [r["held"] for r in found] == [pytest.approx(0.1), 1.0]


def test_composite_refuses_unknown_sources():
    assert ln.composite_weights(["target_disease__literature__europepmc"]) == {"target_disease__literature__europepmc": 0.2}
    with pytest.raises(ValueError):
        ln.composite_weights(["target__tissue_specificity"])


def test_ridge_cv_equals_refitting_each_fold(normal_rows):
    rows = labelled(normal_rows, [0.02, 0.01, -0.03], 0.5).withColumn("fold", (F.col("id") % 3).cast("int"))
    # One fold has the extremes and the gaps, so that what leaks from it would show.
    rows = rows.withColumns({
        "X0": F.when((F.col("fold") == 1) & (F.col("id") % 7 == 0), None).otherwise(F.col("X0")),
        "X1": F.when(F.col("fold") == 2, F.col("X1") * 5).otherwise(F.col("X1")),
        "target_id": F.col("id") % 11,
        "target__tissue_specificity": F.when(F.col("id") % 5 > 0, (F.col("id") % 13) * (F.col("fold") + 1)),
    })
    names = ["X0", "X1", "X2", "target__tissue_specificity"]
    got = md.ridge_cv(rows, "fold", names, "y", ["id"], positive=False)
    for number in range(3):
        model = ln.fit_ridge(rows.filter(F.col("fold") != number), names, "y")
        test = model.predict(rows.filter(F.col("fold") == number), "again").select("id", "again")
        worst = test.join(got, "id").agg(F.max(F.abs(F.col("again") - F.col("prediction")))).first()[0]
        assert worst < 1e-9


def test_group_folds_keep_groups_and_balance(spark):
    rows = spark.range(5000).select("id", F.floor(F.sqrt("id")).alias("g"))
    folds = fd.group_kfold(rows, 4, "g")
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 5000 and max(sizes) - min(sizes) <= 142


def test_stratified_folds_balance_labels(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 10 == 0).alias("y"))
    counts = fd.stratified_kfold(rows, 3, "y", ["id"]).groupBy("fold", "y").count().collect()
    assert sorted(r["count"] for r in counts if r["y"]) == [100, 100, 100]
    assert sorted(r["count"] for r in counts if not r["y"]) == [900, 900, 900]


def test_unlabelled_rows_must_have_no_outcome(spark):
    rows = spark.createDataFrame([(1, True, "0")], "id int, y boolean, fold string")
    extra = spark.createDataFrame([(2, None)], "id int, y boolean")
    assert fd.add_unlabeled(rows, extra, ["y"], "oos").filter("fold = 'oos'").count() == 1
    with pytest.raises(ValueError):
        fd.add_unlabeled(rows, rows.drop("fold"), ["y"], "oos")


def test_shapley_values_add_up(normal_rows):
    rows = normal_rows.limit(50)
    model = ln.LinearModel("m", {"X0": 0.1, "X2": -0.2}, intercept=0.4, positive=False)
    shap = ex.linear_shap(rows, model, ["id"], ["X0", "X1", "X2"], background=normal_rows)
    assert shap.filter("feature = 'X1' AND shap_value IS NOT NULL").count() == 0
    sums = shap.groupBy("id").agg((F.sum("shap_value") + F.max("base_value")).alias("s")).join(rows, "id")
    direct = 0.4 + 0.1 * F.col("X0") - 0.2 * F.col("X2")
    assert sums.agg(F.max(F.abs(F.col("s") - direct))).first()[0] < 1e-9
