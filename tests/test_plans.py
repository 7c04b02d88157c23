"""Jobs end to end on the smallest tables, and the data contracts they rely on."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortlab.config import StudyConfig, sweep_configs
from cohortlab.functions.naming import OUTCOME
from cohortlab.operators import linear as ln
from cohortlab.operators import models as md
from cohortlab.operators.cohort import cohort_base, cohort_sweep, select_cohort
from cohortlab.operators.dataset import create_dataset, create_modeling_dataset
from cohortlab.operators.evidence import temporalize_evidence
from cohortlab.operators.opportunity import tractability_buckets
from cohortlab.operators.quality import QualityError, enforce_keys, validate_features
from cohortlab.plans.export import EvidenceTables, export_aggregated_features, export_features
from cohortlab.plans.study import opportunities, run_study, sweep_area_risk
from cohortlab.sources import fixtures as fx
from cohortlab.sources.registry import load_targets
from cohortlab.sources.sinks import load_dataset, save_dataset

AREAS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "all"]


@pytest.fixture(scope="module")
def exported(spark, tmp_path_factory):
    tables = EvidenceTables(
        evidence=fx.evidence(spark, SMALL),
        targets=load_targets(fx.targets(spark, SMALL), fx.prioritisation(spark, SMALL)),
        diseases=fx.diseases(spark, SMALL),
        publication_years=fx.publication_years(spark, SMALL),
    )
    return export_features(tables, str(tmp_path_factory.mktemp("export")), fx.BOUNDS)


def test_export_writes_valid_tables(exported):
    assert exported["temporal_features"].count() == 18176
    assert exported["static_features"].count() == 3579
    enforce_keys(exported["temporal_features"], ["target_id", "disease_id", "year"])


def test_null_year_row_holds_the_maximum(exported):
    temporal, static = exported["temporal_features"], exported["static_features"]
    column = "target_disease__animal_model__impc"
    last = temporal.filter("year IS NULL").select("target_id", "disease_id", F.col(column).alias("a"))
    both = last.join(static.select("target_id", "disease_id", F.col(column).alias("b")), ["target_id", "disease_id"])
    assert both.filter("NOT (a <=> b)").count() == 0


def test_aggregation_keeps_rows(spark, exported, tmp_path):
    export_aggregated_features(exported["temporal_features"], fx.diseases(spark, SMALL), str(tmp_path))


def test_disease_without_ancestors_keeps_its_rows(spark, exported, tmp_path):
    diseases = fx.diseases(spark, SMALL).withColumn("ancestors", F.lit(None).cast("array<string>"))
    export_aggregated_features(exported["temporal_features"], diseases, str(tmp_path))


def test_validation_finds_broken_features(exported):
    temporal = exported["temporal_features"]
    changed = temporal.withColumn(
        "target__tissue_specificity", F.when(F.col("year") == 1997, 9.0).otherwise(F.col("target__tissue_specificity"))
    )
    with pytest.raises(QualityError, match="static"):
        validate_features(changed)
    falling = temporal.withColumn(
        "target_disease__clinical__phase_max__reached",
        F.when(F.col("year") == 2001, 0).otherwise(F.col("target_disease__clinical__phase_max__reached")),
    )
    with pytest.raises(QualityError, match="decrease"):
        validate_features(falling)
    with pytest.raises(QualityError):
        enforce_keys(temporal, ["target_id", "disease_id"])


def test_literature_without_number_is_skipped(spark):
    rows = spark.createDataFrame(
        [("t", "d", "literature", "europepmc", 0.5, ["x1", "7"], None)],
        "targetId string, diseaseId string, datatypeId string, datasourceId string, score double, "
        "literature array<string>, publicationYear int",
    )
    years = spark.createDataFrame([(7, 1998)], "pmid long, pub_year int")
    found = {r["year"] for r in temporalize_evidence(rows, years, fx.BOUNDS).collect()}
    assert found == {1998, None}


@pytest.fixture(scope="module")
def study(exported):
    config = StudyConfig("23.12", 1997, 1, 2, fx.BOUNDS)
    return run_study(
        exported["temporal_features"], exported["therapeutic_areas"], config, boosting=False, logistic=False,
        model_limits=(5, 10, 25),
    )


def test_study_ranks_every_model(study):
    models = {r[0] for r in study.relative_risk.filter("is_model_feature").select("model_name").distinct().collect()}
    assert models == {m for m in study.models if not m.startswith("baseline")}
    assert study.area_risk.count() > 0
    assert study.area_metrics.filter("roc_auc NOT BETWEEN 0 AND 1").count() == 0


def test_opportunities_cover_all_pairs(study, exported):
    table, statistics = opportunities(
        study, exported["static_features"], exported["tractability"], exported["therapeutic_areas"], "rdg__no_time__positive"
    )
    assert table.count() == 3579
    overall = statistics.filter(
        "target_disease__stage = 'ALL' AND target__tractability__modality = 'ALL' "
        "AND target__tractability__evidence = 'ALL' AND disease__therapeutic_area = 'ALL' AND benchmark_name = 'NONE'"
    ).collect()
    assert [r["n_pairs"] for r in overall] == [3579]


def test_sweep_reports_every_configuration(exported):
    features, areas = exported["temporal_features"], exported["therapeutic_areas"]
    versions = {"23.06": features.filter("year IS NULL OR year <= 1998"), "23.09": features.filter("year IS NULL OR year <= 1999"), "23.12": features}
    configs = sweep_configs(list(versions), 1997, (-1, 0, 1), (1, 2), 2, fx.BOUNDS)
    assert len(configs) == 18
    risk = sweep_area_risk(versions, areas, configs, AREAS, (5, 10)).persist()
    keys = ["version", "last_training_year", "window", "therapeutic_area_name", "method"]
    assert risk.groupBy(*keys).count().filter("count > 1").count() == 0
    found = {tuple(r) for r in risk.select(*keys[:3]).distinct().collect()}
    known = {"23.06": 1998, "23.09": 1999, "23.12": 2000}
    # Where no transition can follow the training years, there is nothing to report.
    able = [c for c in configs if c.last_training_year < min(2000 - c.window, known[c.version])]
    assert found == {(c.version, c.last_training_year, c.window) for c in able} and len(able) == 14


def test_sweep_refuses_what_it_cannot_serve(exported):
    features = exported["temporal_features"]
    one, two = StudyConfig("23.12", 1997, 1, 2, fx.BOUNDS), StudyConfig("23.12", 1997, 2, 3, fx.BOUNDS)
    with pytest.raises(ValueError, match="phase"):
        sweep_area_risk({"23.12": features}, exported["therapeutic_areas"], [one, two], AREAS)
    with pytest.raises(ValueError, match="versions"):
        sweep_area_risk({"23.09": features}, exported["therapeutic_areas"], [one], AREAS)
    with pytest.raises(ValueError, match="one version"):
        cohort_sweep(features, [one, StudyConfig("23.09", 1997, 1, 2, fx.BOUNDS)])


def test_swept_models_equal_single_fits(exported):
    base = cohort_base(exported["temporal_features"], 2)
    config = StudyConfig("23.12", 1997, 1, 2, fx.BOUNDS)
    rows = select_cohort(base, config.training).withColumn("g", F.lit("a")).persist()
    names = md.feature_sets(create_modeling_dataset(rows.drop("g", "transition_year", "feature_year")).features)["all"]
    one = ln.fit_ridge(rows, names, OUTCOME, positive=True)
    stats = ln.group_statistics(rows, "g", names, OUTCOME, {"a": ["a"]})
    other = stats.fit("a", ["a"], {"ridge": (True, None)})["ridge"]
    both = rows.select(one.score(one.fills(rows)).alias("x"), ln.grouped_score(F.col("g"), {"a": other}, {"a": stats.fills["a"]}).alias("y"))
    assert both.agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] < 1e-9


def test_dataset_round_trip(spark, study, tmp_path):
    rows = study.evaluation.drop(*study.models)
    dataset = create_modeling_dataset(rows)
    assert "target_disease__time__transition" in dataset.features
    assert dataset.outcome_type == "classification:binary"
    boosted = md.fit_boosting(dataset.rows, dataset.features, dataset.outcomes[0], boosting=md.Boosting(rounds=10))
    linear = study.models["rdg__all__positive"]
    save_dataset(dataset, str(tmp_path / "ds"), {"linear": linear, "boosted": boosted})
    again, models = load_dataset(spark, str(tmp_path / "ds"))
    assert again.roles() == dataset.roles()
    assert again.rows.count() == dataset.rows.count()
    assert models["linear"] == linear
    a, b = (md.score_models(dataset.rows, {"boosted": m}).agg(F.sum("boosted")).first()[0] for m in (boosted, models["boosted"]))
    assert a == pytest.approx(b)


def test_dataset_roles_are_checked(spark):
    rows = spark.createDataFrame([(1, 2.0, 0, "x")], "id int, f double, y int, d string")
    dataset = create_dataset(rows, ["id"], ["y"])
    assert (dataset.features, dataset.descriptors) == (["f"], ["d"])
    with pytest.raises(ValueError):
        create_dataset(rows, ["id"], ["id"])
    with pytest.raises(ValueError):
        create_dataset(rows, [], ["y"])
    three = spark.createDataFrame([(i, 1.0, i) for i in range(3)], "id int, f double, y int")
    with pytest.raises(ValueError):
        create_dataset(three, ["id"], ["y"])


def test_tractability_buckets_match_published_table(spark):
    """The 27 assignments, by modality and confidence."""
    published = {
        ("OC", "LOW"): ["Phase 1 Clinical"], ("OC", "MED"): ["Advanced Clinical"], ("OC", "HIGH"): ["Approved Drug"],
        ("AB", "LOW"): ["GO CC med conf", "Human Protein Atlas loc", "UniProt SigP or TMHMM", "UniProt loc med conf"],
        ("AB", "MED"): ["GO CC high conf", "UniProt loc high conf"],
        ("AB", "HIGH"): ["Advanced Clinical", "Approved Drug", "Phase 1 Clinical"],
        ("PR", "LOW"): ["Database Ubiquitination", "Half-life Data", "Small Molecule Binder"],
        ("PR", "MED"): ["Literature", "UniProt Ubiquitination"], ("PR", "HIGH"): ["Advanced Clinical", "Phase 1 Clinical"],
        ("SM", "LOW"): ["Druggable Family", "High-Quality Pocket", "Med-Quality Pocket"],
        ("SM", "MED"): ["High-Quality Ligand", "Structure with Ligand"],
        ("SM", "HIGH"): ["Advanced Clinical", "Approved Drug", "Phase 1 Clinical"],
    }
    rows = [("t", e, True, m) for (m, _), names in published.items() for e in names] + [("t", "x", False, "SM")]
    table = spark.createDataFrame(
        rows, "target_id string, tractability_id string, tractability_value boolean, tractability_modality string"
    )
    found: dict = {}
    for r in tractability_buckets(table).collect():
        found.setdefault((r["modality"], r["confidence"]), []).append(r["evidence"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in published.items()}
