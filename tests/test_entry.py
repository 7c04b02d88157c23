"""Cohorts need the pairs that enter a phase only: others are neither dated nor accumulated."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as app
from cohortlab.catalog import inputs
from cohortlab.functions.frames import partitions_for
from cohortlab.operators import cohort as ch
from cohortlab.operators import evidence as ev
from cohortlab.operators import features as ft

SOURCES = [("literature", "europepmc"), ("animal_model", "impc")]
SCORED = "datatypeId string, datasourceId string, targetId string, diseaseId string, score double, year int"
STAGED = "targetId string, diseaseId string, year int, clinicalPhaseMaxReached int, " + ", ".join(
    f"clinicalPhase{p}Reached int" for p in (1, 2, 3, 4)
)
TARGETS, DISEASES = [*(f"T{n}" for n in range(12)), None], ["D1", "D2", "D3", None]


def rows_of(table):
    return sorted(tuple(map(str, r)) for r in table.collect())


@pytest.fixture(scope="module")
def known(spark):
    draw = random.Random(3)
    stages, scores = [], []
    for target in TARGETS:
        for disease in DISEASES:
            for year in draw.sample(range(1996, 2001), draw.randint(0, 4)):
                seen = draw.sample([1, 2, 3, 4], draw.randint(1, 2))
                stages.append((target, disease, year, max(seen), *[1 if p in seen else None for p in (1, 2, 3, 4)]))
            for _ in range(draw.randint(0, 3)):
                scores.append((*draw.choice(SOURCES), target, disease, draw.random(), draw.choice([None, 1996, 1998])))
    return spark.createDataFrame(scores, SCORED), spark.createDataFrame(stages, STAGED)


@pytest.mark.parametrize("window", [(None, None), (1996, 1998), (1997, 1999)])
@pytest.mark.parametrize("by_target", [True, 3, 0])
def test_features_of_an_entry_give_the_same_cohorts(known, window, by_target):
    scores, stages = known
    plain = ch.cohort_base(ft.temporal_features(scores, stages, SOURCES, by_target=by_target), 2, *window)
    wanted = ft.stages_entering(stages, ft.Entry(2, *window))
    cut = ft.temporal_features(ev.of_pairs(scores, wanted), stages, SOURCES, by_target=by_target, wanted=wanted)
    assert 0 < cut.select("target_id", "disease_id").distinct().count() == plain.count()
    assert rows_of(ch.cohort_base(cut, 2, *window)) == rows_of(plain)


def test_only_pairs_of_the_entry_are_dated(spark):
    rows, stages, _, wanted = inputs.dealt(spark, SMALL, entry=inputs.entry_of(inputs.TRAINING))
    dated, entering = (t.select("targetId", "diseaseId").distinct() for t in (rows, wanted))
    assert dated.exceptAll(entering).isEmpty()
    assert 0 < dated.count() < stages.select("targetId", "diseaseId").distinct().count()


@pytest.mark.parametrize("name", ["stratified_group_kfold", "dataset_round_trip"])
def test_features_are_not_run_again_by_what_follows(spark, name):
    plan = app.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "clinicalPhase" not in plan and "o_orderdate" not in plan


def test_partitions_follow_the_rows(spark, known, monkeypatch):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("targetId"))
    assert partitions_for(rows, on="targetId") is True
    monkeypatch.setattr("cohortlab.functions.frames.TASK_ROWS", 10)
    assert partitions_for(rows, rows.limit(100), on="targetId") == 100
    assert partitions_for(rows, rows.withColumn("targetId", F.lit("hot")), on="targetId") is False
    plan = ft.temporal_features(*known, SOURCES, by_target=37)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(target_id" in plan and "37), REPARTITION_BY_NUM" in plan
