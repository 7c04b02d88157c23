"""Newton steps, boosted trees and cross-validation against plain versions."""

from itertools import product
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortlab.operators import boosting as bo
from cohortlab.operators import explain as ex
from cohortlab.operators import logistic as lg
from cohortlab.operators import models as md

NAMES = ["a", "b", "c"]


def frame(n=900, seed=1):
    rng = np.random.RandomState(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = rng.rand(n) < 1 / (1 + np.exp(-(0.3 + x @ [1.2, -0.6, 0.1])))
    pdf = pd.DataFrame(x, columns=NAMES)
    return pdf.assign(y=y.astype(int), target_id=np.arange(n), disease_id=np.arange(n) % 7, fold=(np.arange(n) % 3).astype(str), inner=np.arange(n) // 3 % 5)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(frame()).repartition(3).persist()


def newton(x, y, c):
    """Plain steps on one model."""
    design, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    penalty = np.array([0.0, *[1 / c] * x.shape[1]])
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty), design.T @ (p - y) + penalty * w)
    return w


def test_penalised_fits_equal_spark_ml(rows):
    pdf = frame()
    scales = lg.standards(rows, NAMES, None)
    tasks = [lg.Task((c,), c) for c in (0.01, 1.0, 100.0)]
    weights = lg.fit_tasks(lg.prepared(rows, NAMES, "y", None, None), NAMES, tasks, scales)
    mean, spread = scales[None]
    np.testing.assert_allclose(mean, pdf[NAMES].mean(), atol=1e-12)
    scaled = rows.select("y", *[((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(NAMES, mean, spread)])
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(scaled)
    for task in tasks:
        model = LogisticRegression(labelCol="y", standardization=False, regParam=1 / (len(pdf) * task.inverse_penalty), tol=1e-12, maxIter=500).fit(vectors)
        np.testing.assert_allclose(weights[task.name], [model.intercept, *model.coefficients], atol=1e-4)


def test_penalty_search_equals_a_search_per_fold(rows):
    pdf, penalties = frame(), (0.001, 0.1, 10.0)
    found = lg.penalty_search(rows, NAMES, "y", "inner", "fold", penalties)
    assert set(found) == {None, "0", "1", "2"}
    for outer, model in found.items():
        own = pdf if outer is None else pdf[pdf.fold != outer]
        x = (own[NAMES] - own[NAMES].mean()) / own[NAMES].std(ddof=0)
        shares = []
        for c in penalties:
            hits = []
            for f in range(5):
                train = (own.inner != f).values
                w = newton(x[train].values, own.y[train].values, c)
                z = w[0] + x[~train].values @ w[1:]
                hits.append(((z > 0) == own.y[~train].values).mean())
            shares.append(np.mean(hits))
        best = penalties[int(np.argmax(shares))]
        assert model.inverse_penalty == best
        w = newton(x.values, own.y.values, best)
        np.testing.assert_allclose([model.intercept, *model.coefficients.values()], w, atol=1e-6)


def test_constant_and_separating_features_do_not_break_the_steps(spark):
    pdf = pd.DataFrame({"a": np.arange(60.0), "b": 1.0, "y": (np.arange(60) >= 30).astype(int), "i": np.arange(60) % 5})
    model = lg.penalty_search(spark.createDataFrame(pdf), ["a", "b"], "y", "i")[None]
    assert np.isfinite([model.intercept, *model.coefficients.values()]).all()
    assert model.coefficients["a"] > 0 and model.coefficients["b"] == 0


def count_jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setJobGroup("rest", "rest")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


SPECS = [
    md.ModelSpec("gbm__x__positive", "gbm", NAMES, True), md.ModelSpec("gbm__x__unconstrained", "gbm", ["a", "b"]),
    md.ModelSpec("baseline__most_frequent", "baseline", []), md.ModelSpec("baseline__random_seed_0", "baseline", [], seed=0),
    md.ModelSpec("rdg__x__positive", "rdg", ["a", "b"], True), md.ModelSpec("rdg__x__unconstrained", "rdg", NAMES),
]
LOGISTIC = md.ModelSpec("lrg__x__unconstrained", "lrg", NAMES)
SMALL = bo.Boosting(rounds=3, depth=2)


def test_cross_validation_equals_a_fit_per_fold(rows):
    wide, _ = md.run_cv(rows, "fold", 3, [*SPECS, LOGISTIC], "y", NAMES, lambda p: p, ["target_id", "disease_id"], SMALL)
    got = {(r["target_id"], r["model"]): r["prediction"] for r in wide.collect()}
    assert len(got) == 900 * 7
    for f in "012":
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        models = md.fit_models(train, SPECS, "y", NAMES, SMALL)
        for r in md.score_models(test, models).collect():
            for spec in SPECS:
                if spec.algorithm != "gbm":
                    assert got[(r["target_id"], spec.slug)] == pytest.approx(r[spec.slug], abs=1e-9)


def test_number_of_jobs_does_not_depend_on_the_folds(spark, rows):
    def run(n):
        by = rows.withColumn("fold", (F.col("target_id") % n).cast("string")).persist()
        by.count()
        return count_jobs(spark, f"{n} folds", lambda: md.run_cv(by, "fold", n, SPECS, "y", NAMES, lambda p: p, ["target_id"], SMALL))

    assert run(2) == run(5)


def plain_trees(bins, y, cuts, how, positive):
    """Boosting by trying every split of every node on all rows."""
    share = y.mean()
    z, tree_values = np.full(len(y), np.log(share / (1 - share))), []

    def grow(own, level, low, high):
        p = 1 / (1 + np.exp(-z[own]))
        g, h = p - y[own], p * (1 - p)
        clip = lambda v: min(max(v, low), high)
        value = clip(-g.sum() / h.sum())
        loss = lambda m, w: g[m].sum() * w + 0.5 * h[m].sum() * w * w
        best = None
        for f, b in product(range(bins.shape[1]), range(max(map(len, cuts)))):
            left = bins[own, f] <= b
            if left.sum() < how.least_rows or (~left).sum() < how.least_rows or level == how.depth:
                continue
            wl, wr = clip(-g[left].sum() / h[left].sum()), clip(-g[~left].sum() / h[~left].sum())
            gain = loss(np.ones(len(own), bool), value) - loss(left, wl) - loss(~left, wr)
            if (not positive or wl <= wr) and gain > 1e-10 and (best is None or gain > best[0] + 1e-9 * abs(gain)):
                best = (gain, left, wl, wr)
        if best is None:
            return [(own, value)]
        _, left, wl, wr = best
        middle = (wl + wr) / 2
        halves = ((low, min(high, middle)), (max(low, middle), high)) if positive else ((low, high), (low, high))
        return grow(own[left], level + 1, *halves[0]) + grow(own[~left], level + 1, *halves[1])

    for _ in range(how.rounds):
        step = np.zeros(len(y))
        for own, value in grow(np.arange(len(y)), 0, -np.inf, np.inf):
            step[own] = how.step * value
        z = z + step
        tree_values.append(step)
    return z


@pytest.mark.parametrize("positive", [False, True])
def test_trees_equal_trying_every_split(rows, positive, monkeypatch):
    monkeypatch.setattr(bo, "CHECKPOINT_ROUNDS", 2)
    how = bo.Boosting(rounds=5, depth=3, bins=12)
    model = bo.grow(rows, "y", [bo.Member("m", tuple(NAMES), positive)], how=how)["m"]
    pdf = frame()
    bins = model.binned(pdf[NAMES].values)
    np.testing.assert_allclose(model.margins(bins), plain_trees(bins, pdf.y.values, model.cuts, how, positive), atol=1e-9)
    scored = {r["target_id"]: r["p"] for r in rows.select("target_id", model.score().alias("p")).collect()}
    np.testing.assert_allclose([scored[i] for i in range(len(pdf))], model.probabilities(pdf[NAMES].values), atol=1e-12)


def test_an_excluded_fold_is_not_seen(rows):
    members = [bo.Member("all", tuple(NAMES)), bo.Member("0", tuple(NAMES), False, "0")]
    how = bo.Boosting(rounds=2, depth=2)
    both = bo.grow(rows, "y", members, "fold", how)
    changed = rows.withColumn("y", F.when(F.col("fold") == "0", 1 - F.col("y")).otherwise(F.col("y")))
    again = bo.grow(changed, "y", members, "fold", how)
    x = frame()[NAMES].values
    np.testing.assert_allclose(both["0"].probabilities(x), again["0"].probabilities(x), atol=1e-12)
    assert np.abs(both["all"].probabilities(x) - again["all"].probabilities(x)).max() > 0.05


def test_a_positive_model_never_falls(spark):
    rng = np.random.RandomState(4)
    pdf = pd.DataFrame(rng.normal(size=(1500, 3)), columns=NAMES)
    pdf["y"] = (rng.rand(1500) < 1 / (1 + np.exp(-np.sin(3 * pdf.a) * 2 + pdf.b - pdf.a * pdf.c))).astype(int)
    rows = spark.createDataFrame(pdf)
    how = bo.Boosting(rounds=12, depth=4)
    models = bo.grow(rows, "y", [bo.Member("p", tuple(NAMES), True), bo.Member("u", tuple(NAMES))], how=how)
    line = np.linspace(-3, 3, 15)
    grid = np.array(list(product(line, line, line)))
    for name, wanted in (("p", True), ("u", False)):
        cube = models[name].probabilities(grid).reshape(15, 15, 15)
        falls = min(np.diff(cube, axis=axis).min() for axis in range(3))
        assert bool(falls >= -1e-12) is wanted


def test_edge_inputs_of_boosting(spark):
    rows = spark.createDataFrame([(None, 1, 1), (None, 1, 0), (None, 1, None)] * 30, "a double, b int, y int")
    model = bo.grow(rows, "y", [bo.Member("m", ("a", "b"))], how=bo.Boosting(rounds=2))["m"]
    assert {round(r.p, 9) for r in rows.select(model.score().alias("p")).collect()} == {0.5}
    with pytest.raises(ValueError, match="no training rows"):
        bo.grow(rows.limit(0), "y", [bo.Member("m", ("a",))])
    again = bo.BoostedModel.from_json(model.to_json())
    assert again.to_json() == model.to_json()


def tree_value(tree, known, x, node=0):
    """Mean of a tree where only the features in ``known`` are set."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        return tree_value(tree, known, x, right if x[f] > tree.cut[node] else left)
    share = tree.cover[left] / tree.cover[node]
    return share * tree_value(tree, known, x, left) + (1 - share) * tree_value(tree, known, x, right)


def test_tree_shares_equal_enumeration_over_six_features(spark):
    rng = np.random.RandomState(2)
    names = list("abcdef")
    pdf = pd.DataFrame(rng.normal(size=(700, 6)), columns=names)
    pdf["y"] = (pdf.a * pdf.b + pdf.c - pdf.d * pdf.e + 0.3 * pdf.f + rng.normal(size=700) > 0).astype(int)
    pdf["id"] = np.arange(700)
    rows = spark.createDataFrame(pdf)
    model = bo.grow(rows, "y", [bo.Member("m", tuple(names))], how=bo.Boosting(rounds=3, depth=5))["m"]
    got = ex.tree_shap(rows.where("id < 15"), None, {"m": model}, ["id"], [*names, "g"]).toPandas()
    assert got[got.feature == "g"].shap_value.isna().all()
    bins = model.binned(pdf[names].values)
    subsets = [set(i for i in range(6) if s >> i & 1) for s in range(64)]
    for n in range(15):
        worth = {frozenset(s): model.base + sum(tree_value(t, s, bins[n]) for t in model.trees) for s in subsets}
        own = got[got.id == n].set_index("feature")
        for i, c in enumerate(names):
            share = sum(
                factorial(len(s)) * factorial(5 - len(s)) / factorial(6) * (worth[frozenset(s | {i})] - worth[frozenset(s)])
                for s in subsets if i not in s
            )
            assert own.shap_value[c] == pytest.approx(share, abs=1e-9)
        assert own.shap_value.sum() + own.base_value.iloc[0] == pytest.approx(model.margins(bins[n : n + 1])[0], abs=1e-9)


def test_held_out_rows_are_explained_by_their_own_model(rows):
    members = [bo.Member(f, tuple(NAMES), False, f) for f in "012"]
    models = bo.grow(rows, "y", members, "fold", bo.Boosting(rounds=3, depth=3))
    extra = rows.limit(20).withColumn("fold", F.lit("oos")).withColumn("target_id", F.col("target_id") + 5000)
    both = rows.unionByName(extra)
    shares = ex.explain_held_out(both, "fold", models, ["target_id"], NAMES)
    sums = {r[0]: r[1] for r in shares.groupBy("target_id").agg(F.sum("shap_value") + F.max("base_value")).collect()}
    assert len(sums) == 920
    pdf = both.toPandas()
    for r in pdf.itertuples():
        model = models[r.fold if r.fold in models else "0"]
        x = model.binned(np.array([[r.a, r.b, r.c]]))
        assert sums[r.target_id] == pytest.approx(model.margins(x)[0], abs=1e-9)
