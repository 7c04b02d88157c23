"""Queries: sources, projections and evidence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.catalog import inputs
from cohortlab.catalog.registry import query, rounded
from cohortlab.catalog.views import SCORES, TARGET_STATIC, clamp, listing, r6
from cohortlab.functions.expressions import clamp_year, shorten_text
from cohortlab.functions.naming import method_parts, with_feature_info
from cohortlab.operators import evidence as ev
from cohortlab.operators import features as ft
from cohortlab.operators import ontology
from cohortlab.sources import fixtures as fx
from cohortlab.sources.registry import association_scores, load_targets

_PROPERTIES = ["tissueSpecificity", "tissueDistribution", "geneticConstraint", "mouseKOScore"]


@query("load_targets", f"""
SELECT id, "approvedSymbol", {', '.join(r6(f'"{c}"', f'"{c}"') for c in _PROPERTIES)}
FROM v_targets LEFT JOIN v_prioritisation ON "targetId"=id""")
def _load_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        load_targets(fx.targets(spark, sf), fx.prioritisation(spark, sf)).drop("tractability")
    )


@query("association_scores", """
SELECT coalesce(d.t, i.t) AS target_id, coalesce(d.d, i.d) AS disease_id,
  d.score AS direct_score, i.score AS indirect_score
FROM (SELECT "targetId" AS t, "diseaseId" AS d, max(score) AS score FROM v_evidence
      WHERE "diseaseId" LIKE 'D%' GROUP BY 1,2) d
FULL JOIN (SELECT "targetId" AS t, areas[1] AS d, max(score) AS score
      FROM v_evidence JOIN v_diseases ON id="diseaseId" GROUP BY 1,2) i ON d.t=i.t AND d.d=i.d""")
def _association_scores(spark: SparkSession, sf: str) -> DataFrame:
    return association_scores(*fx.associations(spark, sf))


@query("target_features", f"SELECT target_id, {', '.join(r6(c, c) for c in TARGET_STATIC)} FROM v_target_features")
def _target_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inputs.target_features(spark, sf))


@query("clamped_year", f"""
SELECT l_orderkey, l_linenumber, CAST({clamp('year(l_shipdate)')} AS INT) AS year FROM lineitem""")
def _clamped_year(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", clamp_year(F.year("l_shipdate"), fx.BOUNDS).alias("year")
    )


@query("identifiers", """
SELECT DISTINCT coalesce(e.d, d.id) AS disease_id, coalesce(e.t, t.id) AS target_id, e.in_evidence,
  t."approvedSymbol" AS target_symbol, CASE WHEN t.id IS NOT NULL THEN TRUE END AS in_targets,
  d.name AS disease_name, CASE WHEN d.id IS NOT NULL THEN TRUE END AS in_diseases
FROM (SELECT DISTINCT "targetId" AS t, "diseaseId" AS d, TRUE AS in_evidence FROM v_temporalized) e
FULL JOIN v_targets t ON t.id=e.t FULL JOIN v_diseases d ON d.id=e.d""")
def _identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return ev.identifiers(fx.targets(spark, sf), fx.diseases(spark, sf), inputs.temporalized(spark, sf))


@query("id_to_name", """
SELECT 'target' AS entity, id, "approvedSymbol" AS name FROM v_targets
UNION SELECT 'disease', id, name FROM v_diseases
UNION SELECT 'target', "targetId", coalesce(t."approvedSymbol", "targetId") FROM v_evidence LEFT JOIN v_targets t ON t.id="targetId"
UNION SELECT 'disease', "diseaseId", coalesce(d.name, "diseaseId") FROM v_evidence LEFT JOIN v_diseases d ON d.id="diseaseId"
""")
def _id_to_name(spark: SparkSession, sf: str) -> DataFrame:
    ids = ev.identifiers(fx.targets(spark, sf), fx.diseases(spark, sf), fx.evidence(spark, sf))
    names = [
        ev.display_names(ids, entity, label).toDF("id", "name").withColumn("entity", F.lit(entity))
        for entity, label in (("target", "symbol"), ("disease", "name"))
    ]
    return names[0].unionByName(names[1])


@query("parse_method_name", """
SELECT method, count(*) AS n, CASE WHEN kind=0 THEN 'm__'||"datasourceId" END AS model_name,
  CASE WHEN kind<2 THEN lim END AS "limit"
FROM (SELECT *, CASE kind WHEN 0 THEN 'target_disease__model__m__'||"datasourceId"||'__limit_'||lpad(lim::VARCHAR,4,'0')
        WHEN 1 THEN 'target_disease__'||"datatypeId"||'__limit_'||lpad(lim::VARCHAR,4,'0')
        ELSE 'target_disease__'||"datatypeId" END AS method
      FROM (SELECT *, CAST(round(10+10*score) AS INT) AS lim, CAST(floor(score) AS INT) % 3 AS kind FROM v_evidence))
GROUP BY ALL""")
def _parse_method_name(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.round(10 + 10 * F.col("score")).cast("int")
    padded = F.concat(F.lit("__limit_"), F.lpad(limit.cast("string"), 4, "0"))
    kind = F.col("score").cast("int") % 3
    method = (
        F.when(kind == 0, F.concat(F.lit("target_disease__model__m__"), "datasourceId", padded))
        .when(kind == 1, F.concat(F.lit("target_disease__"), "datatypeId", padded))
        .otherwise(F.concat(F.lit("target_disease__"), "datatypeId"))
    )
    counted = fx.evidence(spark, sf).groupBy(method.alias("method")).agg(F.count("*").alias("n"))
    return counted.withColumns(method_parts(F.col("method")))


@query("shorten_text", """
SELECT doc_id, CASE WHEN length(text)<=40 THEN text ELSE substr(text,1,37)||'...' END AS short FROM documents""")
def _shorten_text(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", shorten_text(F.col("text"), 40).alias("short"))


_INFO_NAME = """CASE "datatypeId" WHEN 'animal_model' THEN 'target__'||"datasourceId"
  WHEN 'literature' THEN 'disease__clinical__'||"datasourceId"
  WHEN 'known_drug' THEN 'other__'||"datasourceId"
  ELSE 'target_disease__'||"datatypeId"||'__'||"datasourceId" END"""


@query("feature_info", f"""
SELECT feature, n, CASE WHEN feature LIKE 'target_disease%' THEN 'target_disease' WHEN feature LIKE 'target%' THEN 'target'
  ELSE 'disease' END AS entity,
  CASE WHEN feature LIKE 'disease%' THEN 'temporal' ELSE 'static' END AS kind
FROM (SELECT {_INFO_NAME} AS feature, count(*) AS n FROM v_augmented GROUP BY 1) WHERE feature NOT LIKE 'other%'""")
def _feature_info(spark: SparkSession, sf: str) -> DataFrame:
    kind, source = F.col("datatypeId"), F.col("datasourceId")
    name = (
        F.when(kind == "animal_model", F.concat(F.lit("target__"), source))
        .when(kind == "literature", F.concat(F.lit("disease__clinical__"), source))
        .when(kind == "known_drug", F.concat(F.lit("other__"), source))
        .otherwise(F.concat_ws("__", F.lit("target_disease"), kind, source))
    )
    counted = (
        ev.augment_evidence(fx.evidence(spark, sf))
        .groupBy(name.alias("feature"))
        .agg(F.count("*").alias("n"))
    )
    return with_feature_info(counted, "feature")


@query("clinical_evidence", """
SELECT "targetId","diseaseId","studyStartDate","clinicalPhase" FROM v_evidence
WHERE "datasourceId"='chembl' AND "clinicalPhase" IS NOT NULL""")
def _clinical_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return ev.clinical_evidence(fx.evidence(spark, sf))


@query("clinical_stages", "SELECT * FROM v_stages")
def _clinical_stages(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.stages(spark, sf)


@query("augment_evidence", """
SELECT "targetId","diseaseId","datatypeId","datasourceId",score,array_to_string(literature, '|') AS papers,
  "publicationYear","clinicalPhase","studyStartDate" FROM v_augmented""")
def _augment_evidence(spark: SparkSession, sf: str) -> DataFrame:
    augmented = ev.augment_evidence(fx.evidence(spark, sf))
    return augmented.withColumn("papers", F.array_join("literature", "|")).drop("literature")


@query("temporalize_evidence", "SELECT * FROM v_temporalized")
def _temporalize_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.temporalized(spark, sf)


@query("pivot_features", f"SELECT target_id, disease_id, year, {listing(SCORES)} FROM v_pivot")
def _pivot_features(spark: SparkSession, sf: str) -> DataFrame:
    return ft.pivot_features(inputs.temporalized(spark, sf), fx.SOURCES)


@query("tractability", """
SELECT id AS target_id, evidence AS tractability_id, value AS tractability_value, modality AS tractability_modality
FROM v_targets""")
def _tractability(spark: SparkSession, sf: str) -> DataFrame:
    return ev.tractability(fx.targets(spark, sf))


@query("therapeutic_areas", "SELECT * FROM v_areas")
def _therapeutic_areas(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.therapeutic_areas(fx.diseases(spark, sf))
