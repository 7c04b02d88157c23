"""Order-dependent operators and metrics against brute force, with one group holding most rows."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.functions.frames import dimension_join
from cohortlab.operators import metrics as mt
from cohortlab.operators.ordering import exact_quantiles, running_totals, top_rows, topk_cutoffs
from cohortlab.operators.stats import fisher_greater, signed_rank, with_relative_risk


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.RandomState(7)
    n = 600
    group = np.where(rng.rand(n) < 0.7, "hot", np.where(rng.rand(n) < 0.5, "a", "b"))
    return pd.DataFrame(
        {"g": group, "id": np.arange(n), "score": rng.randint(0, 40, n) / 40.0, "y": rng.randint(0, 4, n)}
    )


@pytest.fixture(scope="module")
def rows(spark, skewed):
    return spark.createDataFrame(skewed)


@pytest.mark.parametrize("slices", [None, 7, 64])
def test_running_totals(rows, skewed, slices):
    cells = rows.groupBy("g", "score").agg(F.count("*").alias("n"))
    found = running_totals(cells, ["g"], [F.col("score").desc()], ["n"], slices).toPandas()
    want = skewed.groupby(["g", "score"]).size().rename("n").reset_index().sort_values("score", ascending=False)
    want["n_cum"] = want.groupby("g")["n"].cumsum()
    merged = found.merge(want, on=["g", "score"], suffixes=("", "_want"))
    assert len(merged) == len(want) == len(found)
    assert (merged["n_cum"] == merged["n_cum_want"]).all()
    assert (found["n_total"] == found["g"].map(skewed.groupby("g").size())).all()


def test_top_rows_and_cutoffs(rows, skewed):
    top = top_rows(rows, ["g"], [F.col("score").desc(), F.col("id").asc()], ["id"], 25).toPandas()
    ordered = skewed.sort_values(["score", "id"], ascending=[False, True])
    want = ordered.groupby("g").head(25)
    assert set(top["id"]) == set(want["id"])
    cutoffs = topk_cutoffs(rows, ["g"], "score", ["id"], [5, 10_000]).toPandas()
    for r in cutoffs.itertuples():
        assert r.cutoff == ordered[ordered.g == r.g]["score"].head(r.limit).min()


def test_exact_quantiles(rows, skewed):
    found = exact_quantiles(rows, ["g"], "score", [0.05, 0.5, 0.9]).toPandas()
    for r in found.itertuples():
        assert r.cutoff == pytest.approx(skewed[skewed.g == r.g]["score"].quantile(r.quantile))


def test_salted_join_equals_plain_join(spark, rows):
    dimension = rows.groupBy("g").agg(F.max("score").alias("best"))
    plain = sorted(tuple(r) for r in rows.join(dimension, "g", "left").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left"):
            salted = dimension_join(rows, dimension, ["g"], how)
            assert "_salt" in salted._jdf.queryExecution().toString()
            assert sorted(tuple(r) for r in salted.collect()) == plain
        hot = dimension.filter("g = 'hot'")
        assert dimension_join(rows, hot, ["g"], "left_semi").count() == rows.filter("g = 'hot'").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def kendall(y, s):
    pairs = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for a, b in combinations(list(zip(y, s)), 2)]
    net = sum(u * v for u, v in pairs)
    return net / math.sqrt(sum(1 for u, _ in pairs if u)) / math.sqrt(sum(1 for _, v in pairs if v))


def test_kendall_tau_against_all_pairs(rows, skewed):
    scored = mt.graded_rows(rows, ["g"], ["id"], "y", "score")
    for r in mt.kendall_tau(scored, ["g"]).collect():
        own = skewed[skewed.g == r["g"]]
        assert r["kendalls_tau"] == pytest.approx(kendall(own.y.values, own.score.values))


def test_kendall_tau_of_constant_truth_is_null(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.1), ("a", 1.0, 0.2)], "g string, y double, score double")
    assert mt.kendall_tau(rows, ["g"]).first()["kendalls_tau"] is None


def tied_dcg(y, s, k):
    total, position = 0.0, 0
    for value in sorted(set(s), reverse=True):
        gains = [a for a, b in zip(y, s) if b == value]
        held = [1 / math.log2(p + 2) for p in range(position, position + len(gains)) if p < k]
        total += sum(gains) / len(gains) * sum(held)
        position += len(gains)
    return total


def test_ndcg_with_ties(rows, skewed):
    scored = mt.graded_rows(rows, ["g"], ["id"], "y", "score")
    for r in mt.ndcg_at_ranks(scored, ["g"], [3, 20, 200]).collect():
        own = skewed[skewed.g == r["g"]]
        y, s = own.y.values, own.score.values
        for k in (3, 20, 200):
            ideal = sum(v / math.log2(i + 2) for i, v in enumerate(sorted(y, reverse=True)[:k]))
            assert r[f"ndcg@{k}"] == pytest.approx(tied_dcg(y, s, k) / ideal)


def test_auc_and_average_precision(rows, skewed):
    binary = rows.withColumn("y", F.when(F.col("y") > 2, 1).otherwise(-1))
    for r in mt.rank_metrics(mt.scored_rows(binary, ["g"], ["id"], "y", "score"), ["g"]).collect():
        own = skewed[skewed.g == r["g"]]
        pos, neg = own[own.y > 2].score.values, own[own.y <= 2].score.values
        wins = sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos)
        assert r["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))
        ap, last = 0.0, 0.0
        for s in sorted(own.score.unique(), reverse=True):
            above = own[own.score >= s]
            recall = (above.y > 2).sum() / len(pos)
            ap, last = ap + (recall - last) * (above.y > 2).mean(), recall
        assert r["average_precision"] == pytest.approx(ap)


def test_single_class_metrics(spark):
    rows = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.8)], "g string, id int, score double").withColumn("y", F.lit(0))
    r = mt.classification_metrics(rows, ["g"], ["id"], "y", "score", [1, 5]).first()
    assert r["roc_auc"] is None and r["log_loss"] is None and r["balanced_mae"] is None
    assert (r["average_precision"], r["mcc"], r["f1"]) == (0.0, 0.0, 0.0)
    assert r["precision@5"] == 0.0 and r["recall@5"] is None and r["average_precision@5"] == 0.0


def test_threshold_zero_is_a_threshold(spark):
    rows = spark.createDataFrame([("a", 1, 0.2, 1), ("a", 2, 0.0, 0)], "g string, id int, score double, y int")
    scored = mt.scored_rows(rows, ["g"], ["id"], "y", "score")
    assert mt.threshold_metrics(scored, ["g"], 0.0).first()["precision"] == 1.0


def test_bad_truth_is_refused(spark):
    with pytest.raises(ValueError):
        mt.check_truth(spark.createDataFrame([(2,)], "y int"), "y")


def test_risk_ratio_edges(spark):
    rows = spark.createDataFrame(
        [("none exposed", 0, 10, 5, 20), ("none control", 3, 10, 0, 20), ("neither", 0, 10, 0, 20), ("empty", 0, 0, 5, 20)],
        "k string, n_exposed_true int, n_exposed int, n_control_true int, n_control int",
    )
    found = {r["k"]: r for r in with_relative_risk(rows, 0.9).collect()}
    assert "empty" not in found
    assert (found["none exposed"]["relative_risk"], found["none exposed"]["relative_risk_high"]) == (0.0, None)
    assert found["none control"]["relative_risk"] == math.inf
    assert found["neither"]["relative_risk"] is None


def test_fisher_tail_over_several_blocks(spark):
    cells = [("small", 8, 2, 1, 5), ("large", 9000, 6000, 20000, 14000), ("certain", 0, 5, 3, 4)]
    rows = spark.createDataFrame(cells, "k string, a long, b long, c long, d long")
    found = {r["k"]: r["p_value"] for r in fisher_greater(rows, ["k"], ["a", "b", "c", "d"]).collect()}

    def lc(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    for k, a, b, c, d in cells:
        row, col, n = a + b, a + c, a + b + c + d
        want = math.fsum(math.exp(lc(col, x) + lc(n - col, row - x) - lc(n, row)) for x in range(a, min(row, col) + 1))
        assert found[k] == pytest.approx(want, rel=1e-7)


def test_signed_rank(spark):
    data = [(1, "m", a, v) for a, v in enumerate([3.0, 5.0, 4.0, 8.0, 1.0, 2.0])]
    data += [(1, "base", a, v) for a, v in enumerate([1.0, 4.0, 5.0, 2.0, 1.0, 4.0])]
    rows = spark.createDataFrame(data, "k int, item string, area int, v double")
    found = {r["item"]: r for r in signed_rank(rows, ["k"], "area", "item", "v", "base").collect()}
    # Differences 2, 1, -1, 6, 0, -2: ranks of |d| are 3.5, 1.5, 1.5, 5, -, 3.5.
    m = found["m"]
    z = (10.0 - 7.5) / math.sqrt(5 * 6 * 11 / 24 - (2**3 - 2 + 2**3 - 2) / 48)
    assert (m["n_used"], m["statistic"]) == (5, 10.0)
    assert m["z"] == pytest.approx(z)
    assert m["p_value"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))
    assert found["base"]["p_value"] == 0.0
