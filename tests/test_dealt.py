"""Features dealt by target while rows are narrow: same rows as dealt by pair, no later exchange by pair."""

import re

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.frames import dealt_evenly
from cohortlab.operators import cohort as ch
from cohortlab.operators import features as ft

SOURCES = [("literature", "europepmc"), ("animal_model", "impc")]
SCORED = "datatypeId string, datasourceId string, targetId string, diseaseId string, score double, year int"
STAGED = "targetId string, diseaseId string, year int, clinicalPhaseMaxReached int, " + ", ".join(
    f"clinicalPhase{p}Reached int" for p in (1, 2, 3, 4)
)
PHASE2 = (2, None, 1, None, None)


def score(target, disease, value, year, source=0):
    return (*SOURCES[source], target, disease, value, year)


@pytest.fixture(scope="module")
def known(spark):
    scores = [
        score("T1", "D1", 0.5, 1996), score("T1", "D1", 0.5, 1996), score("T1", "D1", 0.2, 1997), score("T1", "D1", 0.7, None),
        score("T1", "D2", 0.9, 1996, 1), score("T2", "D2", 0.3, 1998), score("T3", "D3", 0.4, 1995, 1),
        score(None, "D1", 0.8, 1996), score("T2", None, 0.6, None), ("other", "other", "T1", "D1", 1.0, 1999),
    ]
    stages = [
        ("T1", "D1", 1997, *PHASE2), ("T1", "D1", 2000, 4, None, None, None, 1), ("T2", "D2", 1996, 1, 1, None, None, None),
        ("T2", "D1", 1998, *PHASE2), (None, "D1", 1999, *PHASE2), ("T2", None, 1997, *PHASE2),
    ]
    return spark.createDataFrame(scores, SCORED), spark.createDataFrame(stages, STAGED)


def rows_of(table):
    return sorted(tuple(map(str, r)) for r in table.collect())


def expected(rows, stages):
    """The plain plan: best scores joined to pairs in trials, aggregated by year, then accumulated."""
    staged = ft._stage_columns(stages)
    pairs = staged.select("target_id", "disease_id").distinct()
    own = ft._score_columns(rows, SOURCES).join(pairs, ["target_id", "disease_id"], "left_semi")
    stacked = staged.unionByName(own, allowMissingColumns=True)
    for entity, name in (("target", ft.TARGET_PHASE), ("disease", ft.DISEASE_PHASE)):
        yearly = staged.groupBy(f"{entity}_id", "year").agg(F.max(ft.PAIR_PHASE).alias(name))
        known = pairs.where("target_id IS NOT NULL AND disease_id IS NOT NULL").join(yearly, f"{entity}_id")
        stacked = stacked.unionByName(known, allowMissingColumns=True)
    return ft.cumulative(ft._max_by(stacked, ft.FEATURE_KEY))


def test_dealt_by_target_or_pair_gives_the_same_rows(known):
    plain = expected(*known)
    for by_target in (True, False, None):
        made = ft.temporal_features(*known, SOURCES, by_target=by_target)
        assert made.dtypes == plain.select(*made.columns).dtypes
        assert rows_of(made) == rows_of(plain.select(*made.columns))
    static = [rows_of(ft.static_features(*known, SOURCES, by_target)) for by_target in (True, False)]
    assert static[0] == static[1] and len(static[0]) == 7


def test_no_exchange_by_pair_and_features_read_once(spark, known):
    properties = spark.createDataFrame([("T1", 0.5), ("T2", 0.1)], "target_id string, target__tissue_specificity double")
    # Tables without known sizes are not broadcast; the few histories of diseases are.
    features = ft.add_target_features(ft.temporal_features(*known, SOURCES, by_target=True), properties, by_target=True)
    base = ch.cohort_base(features, 2)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert rows_of(base.select("target_id", "disease_id", "transition_year")) == [
        ("None", "D1", "1999"), ("T1", "D1", "1997"), ("T2", "D1", "1998"), ("T2", "None", "1997"),
    ]
    assert not re.findall(r"Exchange hashpartitioning\(target_id#\d+, disease_id", plan)


def test_a_hot_target_is_not_dealt(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("targetId"))
    assert not dealt_evenly(rows, ["targetId"])
    assert dealt_evenly(rows.where("targetId <> 'hot'"), ["targetId"])
