"""Evidence of ancestors added before it is accumulated: same rows as accumulated rows looked up by year."""

import random
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as app
from cohortlab.functions.frames import materialize
from cohortlab.operators import features as ft
from cohortlab.operators import ontology

SOURCES = [("literature", "europepmc"), ("animal_model", "impc")]
SCORED = "datatypeId string, datasourceId string, targetId string, diseaseId string, score double, year int"
STAGED = "targetId string, diseaseId string, year int, clinicalPhaseMaxReached int, " + ", ".join(
    f"clinicalPhase{p}Reached int" for p in (1, 2, 3, 4)
)
YEARS = range(1996, 2000)
ONTOLOGY = [("D1", ["A1", "A2"]), ("D1", ["A1"]), ("D2", None), ("D3", ["D3", "A2", None]), ("A1", ["A2"]), (None, ["A1"])]


def rows_of(table):
    return sorted(tuple(map(str, r)) for r in table.collect())


@pytest.fixture(scope="module")
def known(spark):
    draw = random.Random(11)
    # One target reaches every stage of the ancestors; the others have gaps.
    stages = [("T0", disease, year, 1, 1, None, None, None) for disease in ("A1", "A2") for year in YEARS]
    scores = []
    for target in [*(f"T{n}" for n in range(1, 40)), None]:
        for disease in ("A1", "A2", "D1", "D2", "D3", None):
            for year in draw.sample(YEARS, draw.choice([0, 1, 2])):
                phase = draw.choice([1, 2, 3, 4])
                stages.append((target, disease, year, phase, *[1 if p == phase else None for p in (1, 2, 3, 4)]))
            for _ in range(draw.choice([0, 0, 1, 3])):
                row = (*draw.choice(SOURCES), target, disease, draw.choice([None, draw.random(), draw.random()]))
                # As in dated evidence, every row has a copy without a year.
                scores += [(*row, None), *[(*row, year) for year in draw.sample(YEARS, draw.choice([0, 1, 2]))]]
    return spark.createDataFrame(scores, SCORED), spark.createDataFrame(stages, STAGED), spark.createDataFrame(ONTOLOGY, "id string, ancestors array<string>")


@pytest.mark.parametrize("by_target", [True, 3])
def test_added_before_or_looked_up_after(known, by_target):
    scores, stages, diseases = known
    plain = ft.temporal_features(scores, stages, SOURCES, by_target=by_target)
    expected = ontology.aggregated_features(materialize(plain), diseases)
    lineage = ontology.proper_lineage(diseases)
    above = scores.join(lineage.select(F.col("ancestor_id").alias("diseaseId")).distinct(), "diseaseId", "left_semi")
    made = ft.temporal_features(scores, stages, SOURCES, by_target=by_target, heritage=ft.Heritage(lineage, above))
    assert made.dtypes == expected.dtypes
    assert rows_of(made) == rows_of(expected)
    # Evidence is inherited in this example, and by pairs that have none.
    assert rows_of(made) != rows_of(plain.where("target_id IS NOT NULL AND disease_id IS NOT NULL"))
    with pytest.raises(ValueError, match="dealt by target"):
        ft.temporal_features(scores, stages, SOURCES, by_target=False, heritage=ft.Heritage(lineage, above))


def test_only_ancestors_with_stages_in_all_years_qualify(spark, known):
    _, stages, diseases = known
    lineage, phases = ontology.proper_lineage(diseases), ft.yearly_phases(stages, "disease")
    years = spark.createDataFrame([(y,) for y in YEARS], "year int")
    assert ontology.always_staged(lineage, phases, years)
    assert not ontology.always_staged(lineage, phases, years.unionByName(spark.createDataFrame([(2005,)], "year int")))
    assert not ontology.always_staged(lineage, phases.where("NOT (disease_id = 'A2' AND year = 1997)"), years)
    assert ontology.always_staged(lineage, phases.where("disease_id <> 'A2'"), years)  # in no trial, so nothing to inherit


def test_accumulated_rows_are_not_exchanged(spark):
    plan = app.queries()["aggregated_features"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    assert not re.findall(r"Exchange hashpartitioning\([^)]*(?:_source|disease_id)#\d+, year", plan)


def test_gaps_are_looked_up_by_year(spark, monkeypatch):
    rows = rows_of(app.queries()["aggregated_features"](spark, SMALL))
    monkeypatch.setattr(ontology, "always_staged", lambda *_: False)
    assert rows_of(app.queries()["aggregated_features"](spark, SMALL)) == rows
