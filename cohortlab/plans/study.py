"""A study: fit on past transitions, evaluate on later ones, apply to the present day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.config import StudyConfig
from cohortlab.functions.frames import materialize
from cohortlab.functions.naming import OUTCOME, PAIR_KEY
from cohortlab.operators import contracts as ct
from cohortlab.operators import linear as ln
from cohortlab.operators import metrics as mt
from cohortlab.operators import models as md
from cohortlab.operators import opportunity as op
from cohortlab.operators import ranking as rk
from cohortlab.operators import report as rp
from cohortlab.operators.cohort import cohort_base, cohort_sweep, select_cohort
from cohortlab.operators.dataset import create_modeling_dataset
from cohortlab.operators.ontology import join_areas
from cohortlab.operators.ordering import unpivot
from cohortlab.operators.quality import validate_cohort

AREA = ["therapeutic_area_id", "therapeutic_area_name"]


@dataclass(frozen=True)
class StudyResult:
    models: dict[str, md.FittedModel]
    evaluation: DataFrame
    relative_risk: DataFrame
    thresholds: DataFrame
    area_risk: DataFrame
    area_metrics: DataFrame


def ranked_models(models: Sequence[str]) -> list[str]:
    return [m for m in models if not m.startswith("baseline")]


def area_classification(scored: DataFrame, areas: DataFrame, models: Sequence[str]) -> DataFrame:
    """Classifier metrics per area and model; areas with one class are left out."""
    long = unpivot(
        scored.withColumn("_y", F.col(OUTCOME).cast("double")).select(*PAIR_KEY, "_y", *models),
        [*PAIR_KEY, "_y"], list(models), "model", "prediction",
    )
    rows = materialize(join_areas(long, areas))
    found = mt.classification_metrics(rows, [*AREA, "model"], PAIR_KEY, "_y", "prediction", mt.AREA_RANKS)
    return found.filter((F.col("n_positives") > 0) & (F.col("n_positives") < F.col("n_samples")))


def run_study(features: DataFrame, areas: DataFrame, config: StudyConfig, boosting: bool = True,
              logistic: bool = True, model_limits: Sequence[int] = rk.MODEL_LIMITS) -> StudyResult:
    """Both cohorts come from one table of pairs; everything after reads written tables."""
    base = materialize(cohort_base(features, config.phase))
    contracts = ct.cohort_contracts() if config.validate else []
    training = ct.checked(select_cohort(base, config.training), contracts)
    evaluation = ct.checked(select_cohort(base, config.evaluation), contracts)
    if config.validate:
        for cohort in (training, evaluation):
            validate_cohort(cohort)
    names = create_modeling_dataset(training).features
    core = md.feature_sets(names)["all"]
    models = md.fit_models(training, md.model_grid(names, boosting, logistic), OUTCOME, core)
    scored = materialize(md.score_models(evaluation, models))
    ranked = ranked_models(list(models))
    risk = ct.checked(
        rk.enrich_relative_risk(rk.relative_risk_by_method(scored, [], names, ranked, model_limits)),
        ct.method_contracts(),
    )
    predictions = unpivot(scored.select(*PAIR_KEY, *ranked), PAIR_KEY, ranked, "model", "prediction")
    in_areas = ct.checked(join_areas(scored, areas, "left"), ct.area_contracts(()))
    by_area = rk.relative_risk_by_method(in_areas, AREA, names, ranked, model_limits, min_rows=2)
    return StudyResult(
        models=models,
        evaluation=scored,
        relative_risk=risk,
        thresholds=rk.relative_risk_thresholds(risk, predictions),
        area_risk=ct.checked(rk.enrich_relative_risk(by_area), ct.method_contracts()),
        area_metrics=area_classification(scored, areas, ranked),
    )


def opportunities(result: StudyResult, static_features: DataFrame, tractability: DataFrame,
                  areas: DataFrame, model: str, output: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Present-day scores of one model and their statistics per grouping."""
    table = op.opportunity_table(static_features, result.models[model])
    if output is None:
        table = materialize(table)
    else:
        table.write.mode("overwrite").parquet(output)
        table = table.sparkSession.read.parquet(output)
    limits = op.collect_thresholds(result.thresholds, model)
    statistics = op.opportunity_statistics(table, tractability, areas, limits)
    return table, ct.checked(statistics, ct.statistics_contracts())


def reports(result: StudyResult, area_names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of relative risk by kind of method, and the risk of models and benchmarks per area."""
    by_kind = {"core": rp.core_risk_table, "model": rp.model_risk_table, "static": rp.static_risk_table}
    tables = {name: ct.checked(table(result.relative_risk), ct.report_contracts()) for name, table in by_kind.items()}
    by_area = rp.risk_by_area(result.area_risk, area_names)
    return tables | {"area": ct.checked(by_area, ct.area_report_contracts(area_names))}


def sweep_area_risk(features: Mapping[str, DataFrame], areas: DataFrame, configs: Sequence[StudyConfig],
                    area_names: Sequence[str], model_limits: Sequence[int] = rk.MODEL_LIMITS) -> DataFrame:
    """Area risks of the ridge models and the composite for every (version, year, window).

    ``features`` has one table per data version. The cohorts of all configurations come from one
    job, their models from one pass of moments by configuration, and they are scored and evaluated
    together; the driver only solves a small system per configuration.
    """
    absent = sorted({c.version for c in configs} - set(features))
    if absent:
        raise ValueError(f"no features of versions {absent}")
    if len({c.phase for c in configs}) > 1:
        raise ValueError("the configurations of a sweep need the same phase")
    base = None
    for version in sorted({c.version for c in configs}):
        part = cohort_base(features[version], configs[0].phase).withColumn("version", F.lit(version))
        base = part if base is None else base.unionByName(part)
    keys = ["version", "last_training_year", "window"]
    cohorts = materialize(
        cohort_sweep(materialize(base), list(configs)).withColumn("_config", F.concat_ws("|", *keys))
    )
    described = [*keys, "split", "transition_year", "feature_year"]
    names = create_modeling_dataset(cohorts.drop(*described, "_config")).features
    specs = [
        s for s in md.model_grid(names, boosting=False, logistic=False) if s.slug in rk.PRIMARY_MODELS
    ]
    core = md.feature_sets(names)["all"]
    groups = ["|".join(map(str, (c.version, c.last_training_year, c.window))) for c in configs]
    later, earlier = (cohorts.filter(F.col("split") == split) for split in ("evaluation", "training"))
    ridge = {s.slug: (s.positive, s.features) for s in specs if s.algorithm == "rdg"}
    unions = {g: [g] for g in groups}
    found = ln.group_statistics(earlier, "_config", core, OUTCOME, unions)
    models = {g: found.fit(g, [g], ridge) for g in groups}
    fills = ln.union_fills(later, "_config", core, unions)
    config = F.col("_config")
    scores = {slug: ln.grouped_score(config, {g: models[g][slug] for g in groups}, fills) for slug in ridge}
    scores |= {s.slug: ln.weighted_composite(s.features) for s in specs if s.algorithm == "ots"}
    scored = later.withColumns(scores).drop("_config")
    rows = join_areas(materialize(scored), areas)
    slugs = [s.slug for s in specs]
    risk = rk.relative_risk_by_method(rows, [*keys, *AREA], [], slugs, model_limits, min_rows=2)
    return rp.risk_by_area(rk.enrich_relative_risk(risk), area_names, keys)


SWEEP_KEYS = ["version", "last_training_year", "window"]
_SWEEP_COLUMNS = (
    "method string, `limit` int, therapeutic_area_name string, n_total bigint, relative_risk double, "
    "relative_risk_low double, relative_risk_high double, model_name string, model_slug string, "
    "benchmark_name string, benchmark_slug string, benchmark_disp string, is_model_feature boolean, "
    "is_primary_model_feature boolean, is_primary_benchmark_feature boolean, n_therapeutic_areas bigint, p_value double"
)
_KEY_COLUMNS = "version string, last_training_year int, window int"


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def finished_configs(spark: SparkSession, output: str) -> set[tuple[str, int, int]]:
    """(version, year, window) of the configurations whose results are stored."""
    path = f"{output}/finished"
    if not _exists(spark, path):
        return set()
    return {tuple(r) for r in spark.read.schema(_KEY_COLUMNS).parquet(path).distinct().collect()}


def resume_sweep(spark: SparkSession, output: str, features: Mapping[str, DataFrame], areas: DataFrame,
                 configs: Sequence[StudyConfig], area_names: Sequence[str],
                 model_limits: Sequence[int] = rk.MODEL_LIMITS, redo: bool = False) -> DataFrame:
    """Area risks of ``configs`` from a table with one partition per configuration.

    Only configurations without a stored result are computed, all together, and each overwrites its
    own partition; those of others keep their files. A configuration is listed as finished after
    its partition is written, so what a lost job left behind is written again. ``redo`` computes all.
    """
    def key(config: StudyConfig) -> tuple[str, int, int]:
        return (config.version, config.last_training_year, config.window)

    done = set() if redo else finished_configs(spark, output)
    missing = [c for c in configs if key(c) not in done]
    path = f"{output}/area_risk"
    if missing:
        needed = {c.version for c in missing}
        known = {version: table for version, table in features.items() if version in needed}
        risk = sweep_area_risk(known, areas, missing, area_names, model_limits)
        names = [c.split()[0].strip("`") for c in _SWEEP_COLUMNS.split(", ")]
        contract = [ct.unique(*SWEEP_KEYS, "therapeutic_area_name", "method"), *ct.not_null(*SWEEP_KEYS)]

        def write(table: DataFrame) -> DataFrame:
            # One task per partition folder, so a configuration is one file.
            dealt = table.select(*names, *SWEEP_KEYS).repartition(*SWEEP_KEYS)
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SWEEP_KEYS).parquet(path)
            return table

        ct.write_checked(risk, contract, write)
        rows = [key(c) for c in missing]
        spark.createDataFrame(rows, _KEY_COLUMNS).coalesce(1).write.mode("append").parquet(f"{output}/finished")
    stored = spark.read.schema(f"{_SWEEP_COLUMNS}, {_KEY_COLUMNS}").parquet(path)
    wanted = [F.struct(*[F.lit(v) for v in key(c)]) for c in configs]
    return stored.where(F.struct(*SWEEP_KEYS).isin(wanted))
