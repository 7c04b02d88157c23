"""Cases the fixtures do not hold: hot keys with large dimensions, unknown labels, missing sources
and areas, infinite ratios, deep limits and truths outside the contract."""

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import frames
from cohortlab.operators import evidence as ev
from cohortlab.operators import metrics as mt
from cohortlab.operators import ranking as rk
from cohortlab.operators import report as rp
from cohortlab.operators import stats


@pytest.fixture
def no_broadcast(spark):
    key, kept = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "100")
    yield
    spark.conf.set(key, kept)


def test_only_hot_keys_are_repeated(spark, no_broadcast):
    facts = spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.create_map(F.lit("a"), "id").alias("m"), "id"
    )
    dimension = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    for how in ("inner", "left", "left_semi"):
        got = frames.dimension_join(facts, dimension, ["k"], how)
        want = facts.join(dimension, "k", how)
        assert got.count() == want.count()
        assert got.agg(F.sum("id")).first() == want.agg(F.sum("id")).first()
    assert frames.hot_keys(facts, ["k"], 32).collect() == [(0,)]
    # Facts without any other column, all rows equal.
    bare = spark.range(2000).select(F.lit(0).cast("long").alias("k"))
    assert frames.dimension_join(bare, dimension, ["k"]).agg(F.count("*"), F.sum("v")).first() == (2000, 0)
    salted = frames.row_salt(bare, [], 8)
    assert bare.select(salted.alias("s")).distinct().count() > 1


def test_rows_without_a_source_stay(spark):
    rows = spark.createDataFrame(
        [("genetic_association", None, "t", "d", ["1"]), ("genetic_association", "eva", "t", "d", ["1"])],
        "datatypeId string, datasourceId string, targetId string, diseaseId string, literature array<string>",
    )
    got = sorted(str(r.datasourceId) for r in ev.augment_evidence(rows).collect())
    assert got == ["None", "curated", "eva", "omim"]


def test_fractional_phase_counts_for_the_maximum_only(spark):
    rows = spark.createDataFrame([("t", "d", "2000-01-01", 2.5), ("t", "d", "2000-05-01", 1.0)], "targetId string, diseaseId string, d string, clinicalPhase double")
    clinical = rows.withColumn("studyStartDate", F.to_date("d"))
    from cohortlab.config import YearBounds

    row = ev.clinical_stages(clinical, YearBounds()).first()
    assert (row.clinicalPhaseMaxReached, row.clinicalPhase1Reached, row.clinicalPhase2Reached) == (2, 1, None)


def test_unknown_labels_get_columns(spark):
    rows = [(rp.NONE, "SM", "HIGH", "x", "eva", 13), (rp.NONE, "NEW", "HIGH", "x", "eva", 7)]
    columns = [rp.STAGE, rp.MODALITY, rp.EVIDENCE, rp.AREA, "benchmark_name", rp.OVER]
    table = spark.createDataFrame(rows, columns)
    row = rp.opportunities_by_modality(table, "eva").first()
    assert row["total"] == 20 and row["NEW__HIGH"] == 7 and row["SM__HIGH"] == 13


def test_infinite_values_are_counted_beside_the_rest(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", float("inf")), ("a", None)], "g string, v double")
    row = stats.describe(table, ["g"], "v").first()
    assert (row["count"], row["n_infinite"], row["mean"]) == (1, 1, 1.0)


def test_limits_beyond_the_defaults_are_ranked(spark):
    shared = dict(n_exposed=1, is_primary_model_feature=False, is_primary_benchmark_feature=False)
    rows = [
        {**shared, "model_name": "m", "limit": 800, "relative_risk": 3.0, "is_primary_model_feature": True},
        {**shared, "model_name": "m", "limit": 1000, "relative_risk": 1.0, "is_primary_model_feature": True},
        {**shared, "benchmark_name": "eva", "benchmark_slug": "EVA", "relative_risk": 2.0, "is_primary_benchmark_feature": True},
    ]
    schema = (
        "model_name string, `limit` int, relative_risk double, n_exposed long, benchmark_name string, benchmark_slug string, "
        "is_primary_model_feature boolean, is_primary_benchmark_feature boolean"
    )
    enriched = spark.createDataFrame(rows, schema)
    predictions = spark.range(1200).select(
        F.col("id").cast("string").alias("target_id"), F.lit("d").alias("disease_id"), F.lit("m").alias("model"), (1 - F.col("id") / 2000).alias("prediction")
    )
    row = rk.relative_risk_thresholds(enriched, predictions).first()
    assert row["limit"] == 900 and row["model_prediction_threshold"] == pytest.approx(1 - 899 / 2000)
    with pytest.raises(ValueError, match="twice"):
        rk.calibrate_limits(enriched.union(enriched))


def test_a_truth_outside_the_contract_fails(spark):
    rows = spark.createDataFrame([("g", 1, 5, 0.9), ("g", 2, 0, 0.1)], "g string, id int, y int, p double")
    with pytest.raises(Exception, match="y is not in"):
        mt.classification_metrics(rows, ["g"], ["id"], "y", "p", ranks=[1]).collect()


def test_a_pair_without_an_area_is_reported(spark):
    cohort = spark.createDataFrame(
        [("t", "d1", "training", 2000, True, 1.0), ("t", "d2", "training", 2000, True, 1.0)],
        "target_id string, disease_id string, split string, transition_year int, target_disease__outcome__advanced boolean, target_disease__literature__europepmc double",
    )
    cohort = cohort.withColumnRenamed("target_disease__outcome__advanced", stats.OUTCOME)
    areas = spark.createDataFrame([("d1", "a", "A")], "disease_id string, therapeutic_area_id string, therapeutic_area_name string")
    with pytest.raises(ValueError, match="d2"):
        stats.cohort_stats(cohort, areas)
