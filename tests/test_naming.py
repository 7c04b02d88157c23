"""Names, configuration and text helpers."""

import pytest
from pyspark.sql import functions as F

from cohortlab.config import StudyConfig, YearBounds, sweep_configs
from cohortlab.functions.expressions import clamp_year, clip, shorten_text
from cohortlab.functions.naming import feature_info, parse_feature, snake_case, with_feature_info
from cohortlab.sources.registry import VERSIONS, Registry

# The published list of features with their kind.
STATIC = """
target__genetic_constraint target__mouse_ko_score target__tissue_distribution target__tissue_specificity
target_disease__genetic_association__clingen target_disease__genetic_association__curated
target_disease__genetic_association__eva target_disease__genetic_association__gene2phenotype
target_disease__genetic_association__gene_burden target_disease__genetic_association__genomics_england
target_disease__genetic_association__omim target_disease__genetic_association__orphanet
target_disease__genetic_association__ot_genetics_portal target_disease__genetic_association__uniprot_literature
target_disease__genetic_association__uniprot_variants
""".split()
TEMPORAL = """
disease__clinical__phase_max__reached target__clinical__phase_max__reached
target_disease__affected_pathway__cancer_biomarkers target_disease__affected_pathway__crispr
target_disease__affected_pathway__crispr_screen target_disease__affected_pathway__progeny
target_disease__affected_pathway__reactome target_disease__affected_pathway__slapenrich
target_disease__affected_pathway__sysbio target_disease__animal_model__impc
target_disease__known_drug__chembl target_disease__literature__europepmc
target_disease__outcome__advanced target_disease__rna_expression__expression_atlas
target_disease__somatic_mutation__cancer_gene_census target_disease__somatic_mutation__eva_somatic
target_disease__somatic_mutation__intogen target_disease__time__transition
""".split()


def test_feature_kinds_match_published_table(spark):
    kinds = {f.feature: f.kind for f in feature_info(STATIC + TEMPORAL, strict=True)}
    assert len(kinds) == 33
    assert {f for f, kind in kinds.items() if kind == "static"} == set(STATIC)
    names = spark.createDataFrame([(n,) for n in [*STATIC, *TEMPORAL, "year"]], "feature string")
    found = {r["feature"]: r["kind"] for r in with_feature_info(names, "feature").collect()}
    assert found == kinds


def test_unknown_entity():
    assert parse_feature("year") is None
    assert feature_info(["year"]) == []
    with pytest.raises(ValueError):
        feature_info(["year"], strict=True)


def test_snake_case_splits_every_capital():
    assert snake_case("clinicalPhase1Reached") == "clinical_phase1_reached"
    assert snake_case("mouseKOScore") == "mouse_k_o_score"
    assert snake_case("Score") == "score"


def test_sweep_has_the_published_configurations():
    configs = sweep_configs(list(VERSIONS))
    keys = {(c.version, c.last_training_year, c.window) for c in configs}
    assert keys == {
        (v, y, w) for v in ("23.06", "23.09", "23.12") for y in (2013, 2015, 2017) for w in (2, 4)
    }
    assert len(configs) == 18


def test_derived_years():
    config = StudyConfig("23.12", 2015, 2)
    assert (config.training.min_transition_year, config.training.max_advancement_year) == (1990, 2017)
    assert (config.evaluation.min_transition_year, config.evaluation.max_transition_year) == (2016, 2022)
    assert config.evaluation.max_advancement_year == 2024


def test_registry_paths():
    registry = Registry("/data")
    assert registry.path("23.06", "targetPrioritisation").endswith("/23.06/targetsPriorisation")
    assert registry.path("23.12", "targetPrioritisation").endswith("/23.12/targetPrioritisation")
    with pytest.raises(NotImplementedError):
        registry.path("22.01", "evidence")


def test_scalar_helpers_keep_null(spark):
    rows = spark.createDataFrame([(1980, "abcdef", 2.0), (None, "abc", None), (2030, "abcde", -1.0)], "y int, t string, v double")
    found = rows.select(
        clamp_year(F.col("y"), YearBounds()).alias("y"), shorten_text(F.col("t"), 5).alias("t"),
        clip(F.col("v"), 0, 1).alias("v"),
    ).collect()
    assert [tuple(r) for r in found] == [(1989, "ab...", 1.0), (None, "abc", None), (2025, "abcde", 0.0)]
