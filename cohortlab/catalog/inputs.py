"""Spark side of the shared inputs: the domain tables and what the export job derives from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.config import CohortSpec, StudyConfig
from cohortlab.functions.frames import dimension_join, materialize, partitions_for
from cohortlab.functions.naming import DISEASE_PHASE, PAIR_KEY, TARGET_PHASE, TRANSITION_TIME
from cohortlab.operators import evidence as ev
from cohortlab.operators import features as ft
from cohortlab.operators import ontology
from cohortlab.operators import ranking as rk
from cohortlab.operators.contracts import checked, statistics_contracts
from cohortlab.operators.cohort import cohort_base, cohort_base_of_evidence, cohort_sweep, select_cohort
from cohortlab.operators.linear import LinearModel, weighted_composite
from cohortlab.operators.opportunity import (
    Threshold,
    collect_thresholds,
    opportunity_statistics,
    opportunity_table,
)
from cohortlab.operators.ordering import unpivot
from cohortlab.sources import fixtures as fx
from cohortlab.sources.registry import load_targets


class Dated(NamedTuple):
    """Written tables that every feature plan starts from."""

    temporal: DataFrame
    stages: DataFrame


def dated(spark: SparkSession, sf: str) -> Dated:
    """Evidence is joined and written once; its dated form and the stages both come from that."""
    evidence = materialize(fx.evidence(spark, sf))
    temporal = ev.temporalize_evidence(ev.augment_evidence(evidence), fx.publication_years(spark, sf), fx.BOUNDS)
    return Dated(materialize(temporal), materialize(ev.clinical_stages(ev.clinical_evidence(evidence), fx.BOUNDS)))


def stages(spark: SparkSession, sf: str) -> DataFrame:
    return ev.clinical_stages(ev.clinical_evidence(fx.evidence(spark, sf)), fx.BOUNDS)


def temporalized(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence is read twice, so it is written once, with the columns that dating needs."""
    needed = [*ev.SOURCE_KEY, "score", "literature", "publicationYear"]
    augmented = ev.augment_evidence(materialize(fx.evidence(spark, sf).select(*needed)))
    return ev.temporalize_evidence(augmented, fx.publication_years(spark, sf), fx.BOUNDS)


def target_features(spark: SparkSession, sf: str) -> DataFrame:
    return ev.target_features(load_targets(fx.targets(spark, sf), fx.prioritisation(spark, sf)))


class Known(NamedTuple):
    """Evidence and stages, written once for several feature plans."""

    evidence: DataFrame
    stages: DataFrame


def known_evidence(spark: SparkSession, sf: str) -> Known:
    evidence = materialize(fx.evidence(spark, sf))
    return Known(evidence, materialize(ev.clinical_stages(ev.clinical_evidence(evidence), fx.BOUNDS)))


class Dealt(NamedTuple):
    """Dated evidence and stages, and whether both can be dealt by target or to how many partitions (see
    ``partitions_for``)."""

    rows: DataFrame
    stages: DataFrame
    by_target: bool | int
    wanted: DataFrame | None = None


def dealt(spark: SparkSession, sf: str, known: Known | None = None, entry: ft.Entry | None = None) -> Dealt:
    """The rows of evidence are dated as they are read: features are maxima, so best scores need not be found
    and written first. With an entry, only those of its pairs are dated, and their stages are the wanted ones."""
    evidence, stages = known or known_evidence(spark, sf)
    wanted = None
    if entry is not None:
        wanted = materialize(ft.stages_entering(stages, entry))
        needed = [*ev.SOURCE_KEY, "score", "literature", "publicationYear"]
        evidence = materialize(ev.of_pairs(evidence.select(*needed), wanted))
    by_target = partitions_for(evidence, stages, on="targetId")
    date = ev.dated_rows if by_target else ev.temporalize_evidence
    rows = date(ev.augment_evidence(evidence), fx.publication_years(spark, sf), fx.BOUNDS)
    return Dealt(rows, stages, by_target, wanted)


def temporal(spark: SparkSession, sf: str) -> DataFrame:
    """Temporal features of pairs in trials."""
    rows, stages, by_target, _ = dealt(spark, sf)
    return ft.temporal_features(rows, stages, fx.SOURCES, by_target=by_target)


def inherited(spark: SparkSession, sf: str) -> DataFrame:
    """Temporal features of pairs in trials with the evidence of their diseases' ancestors.

    Where every ancestor has stages in all years, its narrow evidence is added before it is accumulated. Otherwise
    the accumulated rows of ancestors are looked up by year."""
    known = known_evidence(spark, sf)
    rows, stages, by_target, _ = dealt(spark, sf, known)
    diseases, published = fx.diseases(spark, sf), fx.publication_years(spark, sf)
    lineage = materialize(ontology.proper_lineage(diseases))
    phases = materialize(ft.yearly_phases(stages, "disease"))
    years = ev.years_of(known.evidence, stages, published, fx.BOUNDS)
    if not by_target or not ontology.always_staged(lineage, phases, years):
        plain = ft.temporal_features(rows, stages, fx.SOURCES, phases, by_target=by_target)
        return ontology.aggregated_features(materialize(plain), diseases)
    ancestors = lineage.select(F.col("ancestor_id").alias("diseaseId")).distinct()
    above = dimension_join(known.evidence, ancestors, ["diseaseId"], "left_semi", spread_by=["targetId"])
    heritage = ft.Heritage(lineage, ev.dated_rows(ev.augment_evidence(above), published, fx.BOUNDS))
    return ft.temporal_features(rows, stages, fx.SOURCES, phases, by_target=by_target, heritage=heritage)


def features(spark: SparkSession, sf: str, known: Known | None = None, entry: ft.Entry | None = None) -> DataFrame:
    """Temporal features of pairs in trials, or of the pairs of an entry, with target properties."""
    rows, stages, by_target, wanted = dealt(spark, sf, known, entry)
    temporal = ft.temporal_features(rows, stages, fx.SOURCES, by_target=by_target, wanted=wanted)
    return ft.add_target_features(temporal, target_features(spark, sf), bool(by_target))


def present_features(spark: SparkSession, sf: str, known: Known | None = None) -> DataFrame:
    """All-time features of every pair, with target properties. Maxima over all time need no dates."""
    evidence, stages = known or known_evidence(spark, sf)
    by_target = partitions_for(evidence, stages, on="targetId")
    rows = ev.augment_evidence(evidence).withColumn("year", F.lit(None).cast("int"))
    static = ft.static_features(rows, stages, fx.SOURCES, by_target)
    return ft.add_target_features(static, target_features(spark, sf), bool(by_target))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.therapeutic_areas(fx.diseases(spark, sf))


TRAINING = CohortSpec(2, 1996, 1998, 1999)
EVALUATION = CohortSpec(2, 1999, 1999, 2001)


def entry_of(*specs: CohortSpec) -> ft.Entry:
    """What cohorts of one phase need: pairs with a transition in any of their windows."""
    first, last = min(s.min_transition_year for s in specs), max(s.max_transition_year for s in specs)
    return ft.Entry(specs[0].phase, first, last)


def entered(spark: SparkSession, sf: str, entry: ft.Entry, known: Known | None = None) -> DataFrame:
    """One row per pair of an entry, with its features as of the transition (see ``cohort_base``). Only the evidence of
    these pairs is dated, and it is aggregated by pair."""
    evidence = known.evidence if known else materialize(fx.evidence(spark, sf))
    stages = known.stages if known else ev.clinical_stages(ev.clinical_evidence(evidence), fx.BOUNDS)
    marked = materialize(ft.with_transitions(stages, entry.phase))
    pairs = materialize(ft.entering_pairs(ft.entering(marked, entry)))
    years = pairs.select(F.col("target_id").alias("targetId"), F.col("disease_id").alias("diseaseId"), "transition_year")
    needed = [*ev.SOURCE_KEY, "score", "literature", "publicationYear"]
    # Pairs are hashed, so the evidence is not sorted.
    own = materialize(evidence.select(*needed).join(years.hint("shuffle_hash"), ev.PAIR))
    dated = ev.dated_rows(ev.augment_evidence(own), fx.publication_years(spark, sf), fx.BOUNDS, ["transition_year"])
    return cohort_base_of_evidence(pairs, dated, marked, target_features(spark, sf), fx.SOURCES)


def cohort(spark: SparkSession, sf: str, spec: CohortSpec = TRAINING, known: Known | None = None) -> DataFrame:
    return select_cohort(entered(spark, sf, entry_of(spec), known), spec)


def split_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """Both cohorts from one table of pairs."""
    base = materialize(entered(spark, sf, entry_of(TRAINING, EVALUATION)))
    train = select_cohort(base, TRAINING).withColumn("split", F.lit("training"))
    later = select_cohort(base, EVALUATION).withColumn("split", F.lit("evaluation"))
    return materialize(train.unionByName(later))


# Fixed coefficients, so that reference SQL can repeat the scores.
_NO_TIME = {
    **{f"target_disease__{t}__{s}": 0.01 * (i + 1) for i, (t, s) in enumerate(fx.SOURCES)},
    TARGET_PHASE: 0.05,
    DISEASE_PHASE: 0.01,
    "target__tissue_specificity": 0.1,
    "target__genetic_constraint": 0.05,
}
MODELS = [
    LinearModel("rdg__no_time__positive", _NO_TIME),
    LinearModel("rdg__all__positive", {**_NO_TIME, TRANSITION_TIME: 0.03}),
]
MODEL_NAMES = ["rdg__no_time__positive", "rdg__all__positive", "ots__all"]
COMPOSITE_FEATURES = [f"target_disease__{t}__{s}" for t, s in fx.SOURCES]


def with_scores(rows: DataFrame) -> DataFrame:
    """Add one score column per model, rounded so that ties are ties in every engine."""
    scores = {m.slug: m.score(m.fills(rows)) for m in MODELS}
    scores["ots__all"] = weighted_composite(COMPOSITE_FEATURES)
    return rows.withColumns({name: F.round(score, 6) for name, score in scores.items()})


def scored_cohort(spark: SparkSession, sf: str, known: Known | None = None) -> DataFrame:
    """Written down, because every cutoff of a ranking reads it again."""
    return materialize(with_scores(cohort(spark, sf, known=known)))


def long_predictions(scored: DataFrame, keep: list[str]) -> DataFrame:
    return unpivot(scored.select(*keep, *MODEL_NAMES), keep, MODEL_NAMES, "model", "prediction")


def opportunities(spark: SparkSession, sf: str, known: Known | None = None) -> DataFrame:
    table = opportunity_table(materialize(present_features(spark, sf, known)), MODELS[0])
    return table.withColumn("prediction", F.round("prediction", 6))


def thresholds(spark: SparkSession, sf: str, known: Known | None = None) -> list[Threshold]:
    """Calibrated on the training cohort."""
    scored = scored_cohort(spark, sf, known)
    risk = rk.relative_risk_by_method(scored, [], COMPOSITE_FEATURES, [MODELS[0].slug])
    found = rk.relative_risk_thresholds(materialize(rk.enrich_relative_risk(risk)), long_predictions(scored, PAIR_KEY))
    return collect_thresholds(found, MODELS[0].slug)


def statistics(spark: SparkSession, sf: str) -> tuple[DataFrame, list[Threshold]]:
    """Statistics per grouping, written once, and the thresholds; both from the same written evidence."""
    known = known_evidence(spark, sf)
    limits = thresholds(spark, sf, known)
    tractability = ev.tractability(fx.targets(spark, sf))
    table = opportunity_statistics(opportunities(spark, sf, known), tractability, areas(spark, sf), limits)
    return checked(table, statistics_contracts()), limits


SWEEP = [
    StudyConfig(version, year, window, 2, fx.BOUNDS)
    for version in ("23.09", "23.12") for year in (1996, 1997, 1998) for window in (1, 2)
]
# The earlier release ends with this year of evidence.
EARLY_RELEASE, EARLY_LAST_YEAR = "23.09", 1999


def swept_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    late = materialize(features(spark, sf, entry=ft.Entry(2)))
    early = late.filter(F.col("year").isNull() | (F.col("year") <= EARLY_LAST_YEAR))
    bases = {EARLY_RELEASE: early, "23.12": late}
    base = None
    for version, known in bases.items():
        part = cohort_base(known, 2).withColumn("version", F.lit(version))
        base = part if base is None else base.unionByName(part)
    return cohort_sweep(base, SWEEP)
