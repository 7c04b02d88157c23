"""Queries: opportunities, result tables and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.catalog import inputs
from cohortlab.catalog.q_metrics import area_metrics
from cohortlab.catalog.q_ranking import AREA, area_risk
from cohortlab.catalog.registry import query, rounded
from cohortlab.catalog.views import AREAS, CONFIDENCE, MODEL_NAMES, OPPORTUNITY_COLUMNS, RANKED_FEATURES, RISK_VALUES, r6
from cohortlab.config import sweep_configs
from cohortlab.functions.frames import materialize
from cohortlab.functions.naming import PAIR_KEY
from cohortlab.operators import evidence as ev
from cohortlab.operators import opportunity as op
from cohortlab.operators import ranking as rk
from cohortlab.operators import report as rp
from cohortlab.operators.features import Entry
from cohortlab.operators.ontology import join_areas
from cohortlab.plans.study import sweep_area_risk
from cohortlab.sources import fixtures as fx

_COLUMNS = ", ".join(OPPORTUNITY_COLUMNS)


@query("opportunities", f"SELECT target_id, disease_id, {_COLUMNS}, prediction FROM v_opps")
def _opportunities(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.opportunities(spark, sf)


@query("tractability_buckets", f"""
SELECT DISTINCT evidence, modality, {CONFIDENCE} AS confidence, CAST(list_position(['OC','AB','PR','SM'], modality) AS INT) AS modality_order,
  CAST(list_position(['LOW','MED','HIGH'], {CONFIDENCE}) AS INT) AS confidence_order FROM v_targets WHERE value""")
def _tractability_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return op.tractability_buckets(ev.tractability(fx.targets(spark, sf)))


@query("opportunity_groupings", """
SELECT target_id, disease_id, prediction, target_disease__stage, target__tractability__modality, target__tractability__evidence,
  disease__therapeutic_area FROM v_groupings""")
def _opportunity_groupings(spark: SparkSession, sf: str) -> DataFrame:
    grouped = op.opportunity_groupings(
        inputs.opportunities(spark, sf), ev.tractability(fx.targets(spark, sf)), inputs.areas(spark, sf)
    )
    return grouped.select(*PAIR_KEY, "prediction", *op.GROUPING)


@query("opportunity_stats", "SELECT * FROM v_opp_stats")
def _opportunity_stats(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.statistics(spark, sf)[0]


_MODALITY = ["ALL__ALL"] + [f"{m}__{e}" for m in ("OC", "AB", "SM", "PR") for e in ("ALL", "HIGH", "MED", "LOW")]


def _pivot_sql(source: str, columns: list[str]) -> str:
    cells = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE label='{c}'),0) AS BIGINT) AS \"{c}\"" for c in columns)
    known = ", ".join(f"'{c}'" for c in columns)
    return (
        f"SELECT therapeutic_area, {cells}, CAST(coalesce(sum(n) FILTER (WHERE label IN ({known})),0) AS BIGINT) AS total "
        f"FROM ({source}) GROUP BY 1 HAVING total>0"
    )


@query("opps_by_modality", _pivot_sql("""
SELECT disease__therapeutic_area AS therapeutic_area, target__tractability__modality||'__'||target__tractability__evidence AS label,
  model__n_pairs__over_threshold AS n FROM v_opp_stats WHERE target_disease__stage='NONE' AND benchmark_name='eva'
  AND target__tractability__evidence IN ('ALL','HIGH','MED','LOW')""", _MODALITY))
def _opps_by_modality(spark: SparkSession, sf: str) -> DataFrame:
    return rp.opportunities_by_modality(inputs.statistics(spark, sf)[0], "eva")


_STATS_OVER = "SELECT disease__therapeutic_area AS therapeutic_area, model__n_pairs__over_threshold AS n, {} AS label FROM v_opp_stats WHERE {}"
_OVERALL = "target__tractability__modality='ALL' AND target__tractability__evidence='ALL'"
_CATEGORY = [f"stage__{s}" for s in ("NONE", "Phase 1", "Phase 2", "Phase 3", "Phase 4", "ALL")]
_CATEGORY += ["threshold__OMIM", "threshold__EVA", "threshold__OTG", "tractability__OC", "tractability__AB", "tractability__PR", "tractability__SM"]


@query("opps_by_category", _pivot_sql(" UNION ALL ".join([
    _STATS_OVER.format("'stage__'||target_disease__stage", f"benchmark_name='eva' AND {_OVERALL}"),
    _STATS_OVER.format("'threshold__'||benchmark_slug", f"benchmark_name<>'NONE' AND target_disease__stage='NONE' AND {_OVERALL}"),
    _STATS_OVER.format("'tractability__'||target__tractability__modality", "benchmark_name='eva' AND target_disease__stage='NONE' AND target__tractability__evidence='HIGH'"),
]), _CATEGORY))
def _opps_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return rp.opportunities_by_category(inputs.statistics(spark, sf)[0], "eva")


@query("opportunity_funnel", """
WITH s AS (SELECT *, model__n_pairs__over_threshold AS n FROM v_opp_stats WHERE disease__therapeutic_area='ALL' AND target__tractability__evidence IN ('ALL','HIGH','MED','LOW')),
o AS (SELECT * FROM s WHERE target__tractability__modality='ALL' AND target__tractability__evidence='ALL')
SELECT 'stage' AS facet, 'Stage' AS tick, CASE target_disease__stage WHEN 'NONE' THEN 'Undeveloped' ELSE target_disease__stage END AS label,
  CAST(CASE target_disease__stage WHEN 'NONE' THEN 0 ELSE right(target_disease__stage,1)::INT END AS INT) AS level, n AS n_pairs, round(n/sum(n) OVER ()::DOUBLE,6)+0.0 AS size
FROM o WHERE target_disease__stage<>'ALL' AND benchmark_slug='NONE'
UNION ALL
SELECT 'threshold', 'Threshold', CASE o.benchmark_slug WHEN 'OTG' THEN 'Medium' WHEN 'EVA' THEN 'High' ELSE 'Highest' END||' RR='||printf('%.2f', t.benchmark_relative_risk),
  CAST(CASE o.benchmark_slug WHEN 'OTG' THEN 0 WHEN 'EVA' THEN 1 ELSE 2 END AS INT), n, round(n/nullif(sum(n) OVER (),0)::DOUBLE,6)+0.0
FROM o JOIN v_opp_thresholds t ON t.benchmark_slug=o.benchmark_slug WHERE target_disease__stage='NONE'
UNION ALL
SELECT 'tractability', CASE target__tractability__modality WHEN 'PR' THEN 'PROTAC' WHEN 'SM' THEN 'Small molecule' WHEN 'AB' THEN 'Antibody' ELSE 'Other' END,
  CASE target__tractability__evidence WHEN 'LOW' THEN 'Low' WHEN 'MED' THEN 'Medium' ELSE 'High' END,
  CAST(CASE target__tractability__evidence WHEN 'LOW' THEN 0 WHEN 'MED' THEN 1 ELSE 2 END AS INT), n, round(n/nullif(sum(n) OVER (PARTITION BY target__tractability__modality),0)::DOUBLE,6)+0.0
FROM s WHERE target__tractability__evidence<>'ALL' AND target__tractability__modality<>'ALL' AND benchmark_slug='EVA' AND target_disease__stage='NONE'""")
def _opportunity_funnel(spark: SparkSession, sf: str) -> DataFrame:
    table, limits = inputs.statistics(spark, sf)
    return rounded(rp.opportunity_funnel(table, limits))


_CORE_GROUP = """CASE WHEN is_model_feature THEN '1. model' WHEN contains(method,'__genetic_association__') THEN '2. genetic'
  WHEN contains(method,'__literature__') THEN '4. literature' WHEN contains(method,'__time__') THEN '3. time' ELSE '5. other' END"""
_STATIC_GROUP = """CASE WHEN contains(method,'__clinical__') THEN '4. clinical evidence' WHEN contains(method,'__genetic_constraint__') THEN '1. target constraint'
  WHEN contains(method,'__tissue_') THEN '2. target expression' WHEN contains(method,'__mouse_ko_score__') THEN '3. target essentiality' ELSE '5. other' END"""


@query("rr_core_table", f"""
SELECT report, method, method_group, label, position, relative_risk FROM (
SELECT 'core' AS report, *, CAST(row_number() OVER (ORDER BY method_group DESC, CASE WHEN method_group IN ('2. genetic','5. other') THEN relative_risk_low
    WHEN method_group='3. time' THEN TRY_CAST(nullif(regexp_extract(method,'_([0-9]+)$',1),'') AS DOUBLE) END ASC NULLS LAST, label DESC) AS INT) AS position
FROM (SELECT *, {_CORE_GROUP} AS method_group,
        CASE WHEN is_model_feature THEN 'rdg@'||lpad("limit"::VARCHAR,3,'0') ELSE replace(replace(method,'target_disease__',''),'__limit_','@') END AS label
      FROM v_enriched WHERE (NOT is_model_feature OR model_name='rdg__no_time__positive') AND method LIKE 'target_disease%' AND method NOT LIKE 'target_disease\\_\\_clinical%' ESCAPE '\\')
UNION ALL BY NAME
SELECT 'model' AS report, *, CAST(row_number() OVER (ORDER BY method_group DESC, model_name DESC, "limit" DESC) AS INT) AS position
FROM (SELECT *, CASE WHEN contains(method,'__all__') THEN '1. all features' WHEN contains(method,'__no_time__') THEN '2. no time' WHEN contains(method,'__no_tgc__') THEN '3. no time/genetics/clinical' END AS method_group,
        substr(model_name,6)||'@'||lpad("limit"::VARCHAR,3,'0') AS label
      FROM v_enriched WHERE is_model_feature AND "limit"<=100) WHERE method_group IS NOT NULL AND (model_name LIKE 'rdg%' OR model_name LIKE 'gbm%')
UNION ALL BY NAME
SELECT 'static' AS report, *, CAST(row_number() OVER (ORDER BY method_group DESC, method DESC) AS INT) AS position
FROM (SELECT *, {_STATIC_GROUP} AS method_group, method AS label FROM v_enriched WHERE method LIKE 'target\\_\\_%' ESCAPE '\\' OR method LIKE 'disease\\_\\_%' ESCAPE '\\'))""")
def _rr_core_table(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.scored_cohort(spark, sf)
    risk = rk.relative_risk_by_method(scored, [], RANKED_FEATURES, MODEL_NAMES)
    enriched = materialize(rounded(rk.enrich_relative_risk(risk)))
    tables = [rp.core_risk_table(enriched), rp.model_risk_table(enriched), rp.static_risk_table(enriched)]
    columns = ["report", "method", "method_group", "label", "position", "relative_risk"]
    return tables[0].select(*columns).unionByName(tables[1].select(*columns)).unionByName(tables[2].select(*columns))


def _area_report(spark: SparkSession, sf: str) -> DataFrame:
    return rp.risk_by_area(materialize(rk.enrich_relative_risk(area_risk(spark, sf))), AREAS)


@query("rr_area_summary", f"""
SELECT * REPLACE ({', '.join(r6(c, c) for c in [*RISK_VALUES[2:], 'p_value'])}) FROM v_area_report""")
def _rr_area_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_area_report(spark, sf))


_MATRIX = ["OMIM", "EVA/ClinVar", "OTG/GWAS", "RDG@010", "RDG@025", "RDG@050", "OTS@010", "OTS@025", "OTS@050"]


@query("rr_area_matrix", "SELECT therapeutic_area, n_pairs, " + ", ".join(
    f"round(max(v) FILTER (WHERE label='{m}'),6)+0.0 AS \"{m}\"" for m in _MATRIX) + """ FROM (
  SELECT therapeutic_area_name AS therapeutic_area, n_total AS n_pairs, relative_risk AS v,
    CASE WHEN is_primary_benchmark_feature THEN benchmark_disp ELSE model_slug||'@'||lpad("limit"::VARCHAR,3,'0') END AS label
  FROM v_area_report WHERE is_primary_benchmark_feature OR model_slug IN ('RDG','OTS')) GROUP BY 1,2""")
def _rr_area_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rp.risk_area_matrix(_area_report(spark, sf), _MATRIX))


@query("metrics_area_long", f"""
SELECT model_slug, therapeutic_area_name, metric, {r6("CASE WHEN metric='average precision' THEN least(0.3,value) ELSE value END", 'value')}, model_group,
  metric='average precision' AND value>0.3 AS clipped
FROM (SELECT replace(metric,'_',' ') AS metric, value, therapeutic_area_name, s AS model_slug, CASE s WHEN 'RDG-T' THEN 'secondary' ELSE 'primary' END AS model_group
  FROM (SELECT therapeutic_area_name, CASE model WHEN 'ots__all' THEN 'OTS' WHEN 'rdg__no_time__positive' THEN 'RDG' ELSE 'RDG-T' END AS s, roc_auc, average_precision
        FROM v_area_metrics WHERE therapeutic_area_name<>'all') UNPIVOT (value FOR metric IN (roc_auc, average_precision)))""")
def _metrics_area_long(spark: SparkSession, sf: str) -> DataFrame:
    metrics = rounded(area_metrics(inputs.scored_cohort(spark, sf), inputs.areas(spark, sf)))
    return rounded(rp.metrics_by_area_long(metrics, AREAS, rk.PRIMARY_MODELS))


@query("avg_area_metrics", """
WITH a AS (
  SELECT model AS model_name, metric, CAST(NULL AS INT) AS "limit", count(*) AS n, avg(value) AS value FROM (
    SELECT model, therapeutic_area_name, roc_auc, average_precision FROM v_area_metrics WHERE therapeutic_area_name<>'all')
  UNPIVOT (value FOR metric IN (roc_auc, average_precision)) GROUP BY 1,2
  UNION ALL SELECT model_name, 'rr@'||lpad("limit"::VARCHAR,3,'0'), "limit", n_therapeutic_areas, relative_risk FROM v_area_report
  WHERE is_model_feature AND therapeutic_area_name='average'),
k AS (SELECT * FROM a WHERE n=5 AND metric IN ('rr@010','rr@020','rr@030','rr@040','rr@050','rr@100','average_precision','roc_auc')),
g AS (SELECT *, 'feature ablations' AS "group", CASE model_name WHEN 'ots__all' THEN 'OTS' WHEN 'rdg__all__positive' THEN 'RDG-T' ELSE 'RDG' END AS label FROM k
  UNION ALL SELECT *, 'model algorithms', CASE model_name WHEN 'ots__all' THEN 'OTS' ELSE 'RDG[+]' END FROM k WHERE model_name IN ('ots__all','rdg__no_time__positive'))
SELECT model_name, "limit", n AS n_therapeutic_areas, "group", label, round(value,6)+0.0 AS value,
  round((value-min(value) OVER w)/nullif(max(value) OVER w-min(value) OVER w,0),6)+0.0 AS norm_value,
  replace(replace(replace(metric,'rr@','RR@'),'average_precision','AP'),'roc_auc','ROC') AS metric
FROM g WINDOW w AS (PARTITION BY "group", metric)""")
def _avg_area_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = rounded(area_metrics(inputs.scored_cohort(spark, sf), inputs.areas(spark, sf)))
    averages = rp.average_metrics(_area_report(spark, sf), metrics, AREAS)
    return rounded(rp.compared_metrics(averages)).select(
        "model_name", "limit", "n_therapeutic_areas", "group", "label", "value", "norm_value", "metric"
    )


CONFIG = ["version", "last_training_year", "window"]


@query("sweep_summary", """
WITH p AS (SELECT * FROM v_sweep_report WHERE therapeutic_area_name='average' AND is_primary_model_feature),
v AS (
  SELECT 'relative_risk' AS statistic, "limit", model_slug, relative_risk AS value FROM p
  UNION ALL SELECT 'neg_log10_p_value', "limit", model_slug, CASE WHEN p_value>0 THEN -log10(p_value)+0.0 END FROM p
  UNION ALL SELECT 'relative_risk_ratio', "limit", 'RDG', (max(relative_risk) FILTER (WHERE model_slug='RDG'))/nullif(max(relative_risk) FILTER (WHERE model_slug='OTS'),0)
    FROM p GROUP BY version, last_training_year, "window", "limit"),
f AS (SELECT statistic, "limit", model_slug, isinf(value) AS endless, CASE WHEN NOT isinf(value) AND NOT isnan(value) THEN value END AS value FROM v)
SELECT statistic, "limit", model_slug, count(value) AS "count", count(*) FILTER (WHERE endless) AS n_infinite, round(avg(value),5)+0.0 AS mean, round(stddev_samp(value),5)+0.0 AS std, round(min(value),5)+0.0 AS min,
  round(quantile_cont(value,0.25),5)+0.0 AS p25, round(quantile_cont(value,0.5),5)+0.0 AS p50, round(quantile_cont(value,0.75),5)+0.0 AS p75, round(max(value),5)+0.0 AS max
FROM f GROUP BY 1,2,3""")
def _sweep_summary(spark: SparkSession, sf: str) -> DataFrame:
    swept = inputs.with_scores(inputs.swept_cohorts(spark, sf).filter(F.col("split") == "evaluation"))
    rows = join_areas(materialize(swept), inputs.areas(spark, sf))
    risk = rk.relative_risk_by_method(rows, [*CONFIG, *AREA], [], MODEL_NAMES, min_rows=2)
    report = rp.risk_by_area(rk.enrich_relative_risk(risk), AREAS, CONFIG)
    return rounded(rp.sweep_summary(materialize(report), CONFIG), 5)


@query("sweep_fitted")
def _sweep_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Cohorts, ridge models and area risks of 18 configurations: three versions, years and windows."""
    late = materialize(inputs.features(spark, sf, entry=Entry(2)))
    known = {"23.06": 1998, "23.09": 1999, "23.12": 2000}
    versions = {v: late.filter(F.col("year").isNull() | (F.col("year") <= last)) for v, last in known.items()}
    configs = sweep_configs(list(versions), 1997, (-1, 0, 1), (1, 2), 2, fx.BOUNDS)
    return rounded(sweep_area_risk(versions, inputs.areas(spark, sf), configs, AREAS))
