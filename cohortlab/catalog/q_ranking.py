"""Queries: cutoffs, relative risk by method and its calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.catalog import inputs
from cohortlab.catalog.registry import query, rounded
from cohortlab.catalog.views import LIMITS, MODEL_NAMES, RANKED_FEATURES, RISK_VALUES, SCORES, listing, r6
from cohortlab.functions.naming import PAIR_KEY
from cohortlab.operators import ranking as rk
from cohortlab.operators.ontology import join_areas
from cohortlab.operators.ordering import exact_quantiles, topk_cutoffs, unpivot
from cohortlab.sources import fixtures as fx

AREA = ["therapeutic_area_id", "therapeutic_area_name"]


@query("topk_threshold", """
SELECT l_returnflag, "limit", min(l_extendedprice) AS cutoff FROM (
  SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS rn FROM lineitem)
JOIN (SELECT unnest([10,100,1000]) AS "limit") ON rn<="limit" GROUP BY 1,2""")
def _topk_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "lineitem")
    return topk_cutoffs(
        rows, ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"], [10, 100, 1000]
    )


@query("exact_quantiles", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT l_returnflag, {q}::DOUBLE AS quantile, {r6(f'quantile_cont(l_extendedprice, {q})', 'cutoff')} FROM lineitem GROUP BY 1"
    for q in rk.QUANTILES) + ")")
def _exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        exact_quantiles(fx.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", list(rk.QUANTILES))
    )


@query("unpivot_scores", f"""
SELECT target_id, disease_id, year, feature, score FROM v_pivot UNPIVOT (score FOR feature IN ({listing(SCORES)}))""")
def _unpivot_scores(spark: SparkSession, sf: str) -> DataFrame:
    from cohortlab.operators.features import pivot_features

    wide = pivot_features(inputs.temporalized(spark, sf), fx.SOURCES)
    return unpivot(wide, [*PAIR_KEY, "year"], SCORES, "feature", "score", keep_nulls=False)


@query("binarize_features", f"""
SELECT method, src AS "column", CASE test WHEN 'pos' THEN 'positive' ELSE test END AS test, {r6('cutoff', 'cutoff')} FROM v_methods""")
def _binarize_features(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.scored_cohort(spark, sf)
    return rounded(rk.method_cutoffs(scored, [], RANKED_FEATURES, MODEL_NAMES))


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    return rk.relative_risk_by_method(inputs.scored_cohort(spark, sf), [], RANKED_FEATURES, MODEL_NAMES)


def area_risk(spark: SparkSession, sf: str) -> DataFrame:
    rows = join_areas(inputs.scored_cohort(spark, sf), inputs.areas(spark, sf))
    return rk.relative_risk_by_method(rows, AREA, RANKED_FEATURES, MODEL_NAMES, min_rows=2)


@query("rr_by_method", "SELECT * FROM v_risk")
def _rr_by_method(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_risk(spark, sf))


@query("rr_at_limit", "SELECT * FROM v_risk WHERE method LIKE '%\\_\\_model\\_\\_%' ESCAPE '\\'")
def _rr_at_limit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rk.relative_risk_by_method(inputs.scored_cohort(spark, sf), [], [], MODEL_NAMES, LIMITS))


@query("rr_enriched", "SELECT * FROM v_enriched")
def _rr_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rk.enrich_relative_risk(_risk(spark, sf)))


@query("rr_thresholds", f"""
SELECT * REPLACE ({r6('benchmark_relative_risk', 'benchmark_relative_risk')}) FROM v_thresholds""")
def _rr_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.scored_cohort(spark, sf)
    risk = rk.relative_risk_by_method(scored, [], RANKED_FEATURES, MODEL_NAMES)
    predictions = inputs.long_predictions(scored, PAIR_KEY)
    return rounded(rk.relative_risk_thresholds(rk.enrich_relative_risk(risk), predictions))


@query("rr_by_area", f"""
SELECT * REPLACE ({', '.join(r6(c, c) for c in RISK_VALUES)}) FROM v_risk_area WHERE n_total>=2""")
def _rr_by_area(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(area_risk(spark, sf))
