"""Cohorts straight from evidence: same rows as those taken from a table of all years."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortlab.catalog import inputs
from cohortlab.config import YearBounds
from cohortlab.functions.frames import materialize
from cohortlab.operators import cohort as ch
from cohortlab.operators import evidence as ev
from cohortlab.operators import features as ft

BOUNDS = YearBounds(1996, 2000)
SOURCES = [("genetic_association", "eva"), ("genetic_association", "omim"), ("literature", "europepmc"), ("known_drug", "chembl")]
KINDS = [("genetic_association", "eva"), ("literature", "europepmc"), ("known_drug", "chembl"), ("other", "other")]
SCHEMA = (
    "targetId string, diseaseId string, datatypeId string, datasourceId string, score double, literature array<string>, "
    "publicationYear int, clinicalPhase double, studyStartDate date"
)


def rows_of(table):
    return sorted(tuple(map(str, r)) for r in table.collect())


@pytest.fixture(scope="module")
def known(spark):
    draw = random.Random(8)
    rows = []
    for target in [*(f"T{n}" for n in range(30)), None]:
        for disease in ("D1", "D2", "D3", None):
            for _ in range(draw.choice([0, 1, 3, 6])):
                kind = draw.choice(KINDS)
                phase = draw.choice([1.0, 2.0, 2.0, 2.5, 3.0, None]) if kind[1] == "chembl" else None
                row = (
                    target, disease, *kind, draw.choice([None, draw.random()]), draw.choice([None, [], ["1"], ["2", "3", "x"]]),
                    draw.choice([None, *range(1994, 2002)]), phase, f"{draw.randint(1995, 2001)}-05-01",
                )
                rows += [row] * draw.choice([1, 1, 2])
    texts = SCHEMA.replace("studyStartDate date", "studyStartDate string")
    evidence = spark.createDataFrame(rows, texts).withColumn("studyStartDate", F.col("studyStartDate").cast("date"))
    years = spark.createDataFrame([(1, 1995), (2, 1997), (2, 1997), (3, None)], "pmid bigint, pub_year int")
    # T1 has two rows of properties, T2 has none.
    properties = [(f"T{n}", n / 10) for n in range(30) if n != 2] + [("T1", 9.0), (None, 5.0)]
    return materialize(evidence), years, spark.createDataFrame(properties, "target_id string, target__tissue_specificity double")


@pytest.mark.parametrize("window", [(None, None), (1996, 1998), (1997, 1997)])
def test_same_cohorts_as_from_all_years(known, window):
    evidence, published, properties = known
    stages = materialize(ev.clinical_stages(ev.clinical_evidence(evidence), BOUNDS))
    temporal = ev.temporalize_evidence(ev.augment_evidence(evidence), published, BOUNDS)
    features = ft.add_target_features(ft.temporal_features(temporal, stages, SOURCES, by_target=False), properties)
    plain = ch.cohort_base(features, 2, *window)
    marked = ft.with_transitions(stages, 2)
    pairs = materialize(ft.entering_pairs(ft.entering(marked, ft.Entry(2, *window))))
    years = pairs.select(F.col("target_id").alias("targetId"), F.col("disease_id").alias("diseaseId"), "transition_year")
    dated = ev.dated_rows(ev.augment_evidence(evidence.join(years, ev.PAIR)), published, BOUNDS, ["transition_year"])
    made = ch.cohort_base_of_evidence(pairs, dated, marked, properties, SOURCES)
    assert made.dtypes == plain.dtypes
    assert rows_of(made) == rows_of(plain) and plain.count() > 5


def test_no_table_of_all_years(spark):
    base = inputs.entered(spark, SMALL, inputs.entry_of(inputs.TRAINING))
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" in plan
    assert rows_of(ch.select_cohort(base, inputs.TRAINING)) == rows_of(
        ch.modeling_cohort(inputs.features(spark, SMALL), inputs.TRAINING)
    )
