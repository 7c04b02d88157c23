"""Inherited evidence and odd keys; buckets follow the size of the table."""

import json
import random

import pytest

from cohortlab.operators import ontology
from cohortlab.plans.layout import TargetLayout, inherited_in_place
from cohortlab.sources import bucketed

SCORE, PHASE = "target_disease__literature__europepmc", "target__clinical__phase_max__reached"
DISEASES = [("D1", ["A1", "A2"]), ("D1", ["A1"]), ("D2", None), ("D3", ["D3", "A2", None]), ("A1", []), (None, ["A1"])]


@pytest.fixture(scope="module")
def known(spark):
    draw = random.Random(5)
    rows = [
        (target, disease, year, draw.choice([None, draw.random()]), draw.choice([None, 1, 2]))
        for target in ("T1", "T2", None) for disease in ("D1", "D2", "D3", "A1", "A2", "other", None)
        for year in (1996, 1997, None) if draw.random() < 0.8
    ]
    # One key twice, with other values.
    rows += [("T1", "D1", 1996, 0.999, None), ("T1", "A1", 1996, 0.5, 2)]
    features = spark.createDataFrame(rows, f"target_id string, disease_id string, year int, {SCORE} double, {PHASE} int")
    return features, spark.createDataFrame(DISEASES, "id string, ancestors array<string>")


def rows_of(table):
    return sorted(tuple(map(str, r)) for r in table.collect())


def expected(features):
    above = {}
    for disease, ancestors in DISEASES:
        above.setdefault(disease, {disease}).update(a for a in ancestors or [] if a)
    rows = [tuple(r) for r in features.collect()]
    best = lambda values: max((v for v in values if v is not None), default=None)
    found = set()
    for target, disease, year, _, _ in rows:
        if target is not None and disease is not None:
            known = [r for r in rows if r[0] == target and r[2] == year]
            scores = best(r[3] for r in known if r[1] in above.get(disease, {disease}))
            found.add((target, disease, year, scores, best(r[4] for r in known if r[1] == disease)))
    return sorted(tuple(map(str, r)) for r in found)


def test_best_of_a_disease_and_its_ancestors(known):
    assert rows_of(ontology.aggregated_features(*known)) == expected(known[0])


def test_larger_tables_have_more_buckets(spark, known, tmp_path, monkeypatch):
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 8)
    layout = TargetLayout(str(tmp_path / "layout"), buckets=2)
    written = layout.write_features(known[0])
    n = known[0].count()
    made = json.loads(spark.read.text(f"{layout.path}/features/layout").first()["value"])["buckets"]
    assert made == -(-n // 8) > 2
    assert rows_of(written.rows) == rows_of(known[0])
    assert rows_of(inherited_in_place(written, known[1])) == expected(known[0])
