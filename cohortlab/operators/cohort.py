"""Cohorts of pairs at the moment they enter a trial phase, without looking ahead.

The transition, the latest features before it and the later advancement of a pair do not depend on
the study window. They are computed once per pair in a single shuffle; a study window only selects
among them, and so does every window of a sweep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.config import CohortSpec, StudyConfig
from cohortlab.functions.frames import dimension_join
from cohortlab.functions.naming import (
    DISEASE_PHASE,
    FEATURE_KEY,
    OUTCOME,
    PAIR_KEY,
    PAIR_PHASE,
    TARGET_PHASE,
    TRANSITION_TIME,
    features_of_kind,
)
from cohortlab.operators import features as ft


def _enters(phase: int) -> Column:
    reached = F.col(f"target_disease__clinical__phase{phase}__reached") > 0
    return F.col("year").isNotNull() & reached & (F.col(PAIR_PHASE) <= phase)


def transition_years(features: DataFrame, phase: int, first: int, last: int) -> DataFrame:
    """First year in which a phase was reached and none beyond it, if within the range."""
    return (
        features.filter(_enters(phase))
        .groupBy(*PAIR_KEY)
        .agg(F.min("year").alias("transition_year"))
        .filter(F.col("transition_year").between(first, last))
    )


def cohort_base(features: DataFrame, phase: int, first: int | None = None,
                last: int | None = None) -> DataFrame:
    """One row per pair with a transition: features, as-of year and year of advancement.

    Static features are the maximum over all rows, as they are not taken to depend on time.
    Temporal ones are those of the latest year strictly before the transition, NULL if there is
    none. The window and the aggregate share the shuffle by pair.
    """
    names = [c for c in features.columns if c not in FEATURE_KEY]
    static = features_of_kind(names, "static")
    temporal = features_of_kind(names, "temporal")
    pair = Window.partitionBy(*PAIR_KEY)
    marked = features.withColumn(
        "transition_year", F.min(F.when(_enters(phase), F.col("year"))).over(pair)
    ).filter(F.col("transition_year").isNotNull())
    if first is not None:
        marked = marked.filter(F.col("transition_year") >= first)
    if last is not None:
        marked = marked.filter(F.col("transition_year") <= last)
    year_before = F.when(F.col("year") < F.col("transition_year"), F.col("year"))
    packed = marked.groupBy(*PAIR_KEY, "transition_year").agg(
        *[F.max(c).alias(c) for c in static],
        F.max(year_before).alias("feature_year"),
        F.max_by(F.struct(*temporal), year_before).alias("_latest"),
        F.min(F.when(F.col(PAIR_PHASE) > phase, F.col("year"))).alias("year_first_advanced"),
    )
    return packed.select(
        *PAIR_KEY, "transition_year", *static, "feature_year", "_latest.*", "year_first_advanced"
    )


def cohort_base_of_evidence(pairs: DataFrame, dated: DataFrame, stages: DataFrame, target_features: DataFrame,
                            sources: Sequence[ft.Source]) -> DataFrame:
    """``cohort_base`` of the features of some pairs, straight from their evidence.

    Of the features of a pair, a cohort takes those of one year only, which are the maxima over what came before the
    transition. So rows are aggregated by pair, and no table of all years is made. ``pairs`` (see
    ``features.entering_pairs``) should be a written table; ``dated`` (see ``evidence.dated_rows``) holds their evidence, each row with
    the ``transition_year`` of its pair, and ``stages`` those of all pairs. A target has no more pairs than there are
    diseases, so that pairs are joined to targets plainly.
    """
    before = F.col("year") < F.col("transition_year")
    scores, aggregates = [], []
    for i, source in enumerate(sources):
        name = ft.source_feature(source)
        counted = F.col("_source") == i
        aggregates.append(F.max(F.when(counted if features_of_kind([name], "static") else counted & before, F.col("score"))).alias(name))
        scores.append(name)
    scored = ft.numbered_scores(dated, sources, ["transition_year"])
    base = pairs.join(scored.groupBy(*PAIR_KEY).agg(*aggregates, F.max(F.when(before, F.col("year"))).alias("_scored_year")), PAIR_KEY, "left")
    years = [F.col("_own_year"), F.col("_scored_year")]
    surroundings = {}
    for entity, name in (("target", TARGET_PHASE), ("disease", DISEASE_PHASE)):
        key = f"{entity}_id"
        history = ft.yearly_phases(stages, entity).groupBy(key).agg(F.collect_list(F.struct("year", "phase")).alias(f"_{entity}"))
        base = base.join(history, key, "left") if entity == "target" else dimension_join(base, history, [key], "left", spread_by=PAIR_KEY)
        known = F.filter(f"_{entity}", lambda s: s["year"] < F.col("transition_year"))
        # A pair lacking a key has no surroundings.
        whole = F.col("target_id").isNotNull() & F.col("disease_id").isNotNull()
        surroundings[name] = F.when(whole, F.array_max(F.transform(known, lambda s: s["phase"])))
        years.append(F.when(whole, F.array_max(F.transform(known, lambda s: s["year"]))))
    properties = [c for c in target_features.columns if c != "target_id"]
    best = target_features.groupBy("target_id").agg(*[F.max(c).alias(c) for c in properties])
    base = base.join(best, "target_id", "left").withColumns({**surroundings, "feature_year": F.greatest(*years)})
    phases = [c for c in pairs.columns if c.startswith("target_disease__")]
    names = [*phases, *scores, TARGET_PHASE, DISEASE_PHASE, *properties]
    return base.select(
        *PAIR_KEY, "transition_year", *features_of_kind(names, "static"), "feature_year",
        *features_of_kind(names, "temporal"), "year_first_advanced",
    )


def asof_features(features: DataFrame, phase: int, first: int, last: int) -> DataFrame:
    """Temporal features as last known before the transition; pairs without such a year drop."""
    names = [c for c in features.columns if c not in FEATURE_KEY]
    temporal = features_of_kind(names, "temporal")
    return (
        cohort_base(features, phase, first, last)
        .filter(F.col("feature_year").isNotNull())
        .select(*PAIR_KEY, "transition_year", "feature_year", *temporal)
    )


def _advanced(max_year: Column) -> Column:
    advanced = F.col("year_first_advanced")
    return advanced.isNotNull() & F.coalesce(advanced <= max_year, F.lit(True))


def select_cohort(base: DataFrame, spec: CohortSpec) -> DataFrame:
    """Cohort of one study window with outcome and time since transition.

    Without a last advancement year any advancement counts and the time is NULL.
    """
    limit = F.lit(spec.max_advancement_year).cast("int")
    return (
        base.filter(F.col("transition_year").between(spec.min_transition_year, spec.max_transition_year))
        .withColumn(OUTCOME, _advanced(limit))
        .withColumn(TRANSITION_TIME, limit - F.col("transition_year"))
        .drop("year_first_advanced")
    )


def modeling_cohort(features: DataFrame, spec: CohortSpec) -> DataFrame:
    """``select_cohort`` straight from features, for one window only."""
    first, last = spec.min_transition_year, spec.max_transition_year
    return select_cohort(cohort_base(features, spec.phase, first, last), spec)


def cohort_sweep(base: DataFrame, configs: list[StudyConfig]) -> DataFrame:
    """The cohorts of all configurations in one frame, keyed by version, year and window.

    ``base`` names its data version in a column ``version``, unless all configurations share one.
    The configurations are a literal array; each row keeps those of its version whose window holds
    its transition. One base has one phase, so configurations of several phases are refused.
    """
    versions = {config.version for config in configs}
    if len({config.phase for config in configs}) > 1:
        raise ValueError("the configurations of a sweep need the same phase")
    if "version" not in base.columns:
        if len(versions) > 1:
            raise ValueError("a base without versions serves configurations of one version only")
        base = base.withColumn("version", F.lit(configs[0].version))
    columns = ("_version", "last_training_year", "window", "split", "_first", "_last", "max_advancement_year")
    entries = []
    for config in configs:
        for split in ("training", "evaluation"):
            spec: CohortSpec = getattr(config, split)
            values = (
                config.version, config.last_training_year, config.window, split,
                spec.min_transition_year, spec.max_transition_year, spec.max_advancement_year,
            )
            entries.append(F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, values)]))
    year = F.col("transition_year")
    holding = F.filter(F.array(*entries), lambda s: (s["_version"] == F.col("version")) & year.between(s["_first"], s["_last"]))
    limit = F.col("max_advancement_year")
    return (
        base.select("*", F.inline(holding))
        .withColumn(OUTCOME, _advanced(limit))
        .withColumn(TRANSITION_TIME, limit - year)
        .drop("_version", "_first", "_last", "max_advancement_year", "year_first_advanced")
    )


def present_day(static_features: DataFrame, years_since_transition: int) -> DataFrame:
    """All pairs as they stand now, shaped like a cohort so that fitted models apply."""
    return (
        static_features.withColumnRenamed("year", "feature_year")
        .withColumn(OUTCOME, F.lit(True))
        .withColumn(TRANSITION_TIME, F.lit(years_since_transition))
    )
