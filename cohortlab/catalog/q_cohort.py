"""Queries: cohorts, quality checks and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.catalog import inputs
from cohortlab.catalog.registry import query, rounded
from cohortlab.catalog.views import (
    ALL_FEATURES, ENTITY, OUTCOME, PHASES, SCORES, STATIC, TARGET_STATIC, TEMPORAL, TIME, Z90, Z99,
    fisher_sql, listing, r6, rr_sql, signed_rank_sql,
)
from cohortlab.functions.frames import materialize, scratch_path
from cohortlab.functions.naming import PAIR_KEY
from cohortlab.operators import cohort as ch
from cohortlab.operators import contracts as ct
from cohortlab.operators import quality, stats
from cohortlab.operators.dataset import outcome_type
from cohortlab.operators.features import Entry
from cohortlab.plans.layout import TargetLayout, cohort_in_place
from cohortlab.sources import fixtures as fx

_PAIR = "target_id, disease_id"
_ROUNDED_FEATURES = ", ".join(r6(c, c) if c in [*SCORES, *TARGET_STATIC] else c for c in [*STATIC, *TEMPORAL])


@query("transition_years", "SELECT * FROM v_transitions WHERE transition_year BETWEEN 1996 AND 1998")
def _transition_years(spark: SparkSession, sf: str) -> DataFrame:
    return ch.transition_years(inputs.features(spark, sf, entry=Entry(2, 1996, 1998)), 2, 1996, 1998)


@query("asof_features", f"""
SELECT {_PAIR}, transition_year, feature_year, {listing(TEMPORAL)} FROM v_base
WHERE transition_year BETWEEN 1996 AND 1998 AND feature_year IS NOT NULL""")
def _asof_features(spark: SparkSession, sf: str) -> DataFrame:
    return ch.asof_features(inputs.features(spark, sf, entry=Entry(2, 1996, 1998)), 2, 1996, 1998)


_COHORT = f"SELECT {_PAIR}, transition_year, feature_year, {_ROUNDED_FEATURES}, {OUTCOME}, {TIME} FROM v_cohort"


@query("modeling_cohort", _COHORT)
def _modeling_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inputs.cohort(spark, sf))


@query("bucketed_cohort", _COHORT)
def _bucketed_cohort(spark: SparkSession, sf: str) -> DataFrame:
    """The same cohort from features bucketed by target, those of all pairs that enter its phase in any year."""
    entering = inputs.features(spark, sf, entry=Entry(inputs.TRAINING.phase))
    features = TargetLayout(scratch_path(spark), buckets=16).write_features(entering)
    return rounded(cohort_in_place(features, inputs.TRAINING))


@query("cohort_sweep", f"""
SELECT {_PAIR}, version, transition_year, feature_year, last_training_year, "window", split, {TIME}, {OUTCOME} FROM v_sweep""")
def _cohort_sweep(spark: SparkSession, sf: str) -> DataFrame:
    swept = inputs.swept_cohorts(spark, sf)
    return swept.select(
        *PAIR_KEY, "version", "transition_year", "feature_year", "last_training_year", "window", "split", TIME, OUTCOME
    )


@query("outcome_type", """
SELECT 'l_discount' AS name, CASE WHEN bool_or(l_discount<>floor(l_discount)) THEN 'regression:continuous' END AS outcome_type FROM lineitem
UNION ALL SELECT 'quality', CASE WHEN count(DISTINCT quality)<=2 THEN 'classification:binary' END FROM labels
UNION ALL SELECT 'both', CASE WHEN count(DISTINCT quality)<=2 AND count(DISTINCT toxic)<=2 THEN 'classification:multilabel-indicator' END FROM labels
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber)<=2 THEN 'classification:binary' END FROM lineitem""")
def _outcome_type(spark: SparkSession, sf: str) -> DataFrame:
    items, labels = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "labels")
    wanted = {
        "l_discount": (items, ["l_discount"]),
        "quality": (labels, ["quality"]),
        "both": (labels, ["quality", "toxic"]),
        "l_linenumber": (items, ["l_linenumber"]),
    }
    result = None
    for name, (rows, columns) in wanted.items():
        row = outcome_type(rows, columns).withColumn("name", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result


def _varying_sql(columns: list[str], by: str, source: str) -> str:
    flags = listing(columns, "count(DISTINCT {0}) + max(CASE WHEN {0} IS NULL THEN 1 ELSE 0 END) > 1 AS {0}")
    parts = [
        f"SELECT '{c}' AS feature, count(*) AS n_groups, count(*) FILTER (WHERE {c}) AS n_varying FROM g" for c in columns
    ]
    return f"SELECT * FROM (WITH g AS (SELECT {by}, {flags} FROM {source} GROUP BY {by}) {' UNION ALL '.join(parts)})"


@query("check_static", _varying_sql(TARGET_STATIC, "target_id", "v_features"))
def _check_static(spark: SparkSession, sf: str) -> DataFrame:
    return quality.varying_groups(inputs.features(spark, sf), TARGET_STATIC, ["target_id"])


@query("check_varies", _varying_sql([*PHASES, *ENTITY, *SCORES], "year", "v_features"))
def _check_varies(spark: SparkSession, sf: str) -> DataFrame:
    return quality.varying_groups(inputs.features(spark, sf), [*PHASES, *ENTITY, *SCORES], ["year"])


@query("check_monotonic", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c}<p) AS n_decreasing FROM (SELECT {c}, lag({c}) OVER "
    f"(PARTITION BY target_id, disease_id ORDER BY year NULLS LAST) AS p FROM v_features)" for c in ALL_FEATURES) + ")")
def _check_monotonic(spark: SparkSession, sf: str) -> DataFrame:
    return quality.decreasing_steps(inputs.features(spark, sf), ALL_FEATURES, PAIR_KEY)


@query("check_unique", _varying_sql([ENTITY[0]], "target_id, year", "v_features")
       + " UNION ALL " + _varying_sql([ENTITY[1]], "disease_id, year", "v_features"))
def _check_unique(spark: SparkSession, sf: str) -> DataFrame:
    features = inputs.features(spark, sf)
    return quality.varying_groups(features, [ENTITY[0]], ["target_id", "year"]).unionByName(
        quality.varying_groups(features, [ENTITY[1]], ["disease_id", "year"])
    )


@query("check_keys", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n>1) AS n_repeated_keys, CAST(sum(a) AS BIGINT) AS "n_null__publicationYear",
  CAST(sum(b) AS BIGINT) AS "n_null__literature", CAST(sum(c) AS BIGINT) AS "n_other__datatypeId"
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE "publicationYear" IS NULL) AS a, count(*) FILTER (WHERE literature IS NULL) AS b,
        count(*) FILTER (WHERE "datatypeId" NOT IN ('known_drug','literature')) AS c
      FROM v_evidence GROUP BY "targetId","diseaseId")""")
def _check_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.key_violations(
        fx.evidence(spark, sf), ["targetId", "diseaseId"], ["publicationYear", "literature"],
        {"datatypeId": ["known_drug", "literature"]},
    )


@query("observed_contracts", """
SELECT 'l_orderkey, l_linenumber is unique' AS contract, count(*)-count(DISTINCT (l_orderkey, l_linenumber)) AS n_broken FROM lineitem
UNION ALL SELECT 'l_orderkey is unique', count(*)-count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'l_returnflag is one of [''A'', ''N'']', count(*) FILTER (WHERE l_returnflag NOT IN ('A','N')) FROM lineitem
UNION ALL SELECT 'discounts are below 0.08', count(*) FILTER (WHERE NOT coalesce(l_discount<0.08,FALSE)) FROM lineitem""")
def _observed_contracts(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount")
    wanted = [
        ct.unique("l_orderkey", "l_linenumber"), ct.unique("l_orderkey"), ct.one_of("l_returnflag", ["A", "N"]),
        ct.every_row("discounts are below 0.08", F.col("l_discount") < 0.08),
    ]
    _, counts = ct.write_observed(rows, wanted, materialize)
    return spark.createDataFrame(list(counts.items()), "contract string, n_broken bigint")


@query("advancement_stats", "SELECT * FROM v_advancement")
def _advancement_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.advancement_stats(inputs.features(spark, sf), [1, 2], 1996, 1999)


_E = [f"{e}_{p}" for e in ("none", "before", "after") for p in ("stalled", "advanced")]
_INFLATION_COUNTS = "SELECT feature_name, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN emerged='{n.split('_')[0]}' AND progress='{n.split('_')[1]}' THEN n_pairs END),0) AS BIGINT) AS {n}" for n in _E
) + " FROM v_advancement GROUP BY 1"
_FISHER = fisher_sql("after_advanced", "after_stalled", "before_advanced", "before_stalled")
_RR99 = rr_sql("after_advanced", "after_advanced+before_advanced", "after_stalled", "after_stalled+before_stalled", Z99)


@query("inflation_stats", f"""
SELECT feature_name, {listing(_E)},
  {', '.join(r6(f'{e}_advanced/nullif({e}_advanced+{e}_stalled,0)::DOUBLE', f'{e}_fraction') for e in ('none', 'before', 'after'))},
  {r6('p', 'p_value')}, {r6('-log10(p)+0.0', 'p_value_neg_log10')},
  {', '.join(r6(f'CASE WHEN after_advanced+before_advanced>0 AND after_stalled+before_stalled>0 THEN {v} END', k) for k, v in _RR99.items())}
FROM (SELECT *, {_FISHER} AS p FROM ({_INFLATION_COUNTS}))""")
def _inflation_stats(spark: SparkSession, sf: str) -> DataFrame:
    table = stats.advancement_stats(inputs.features(spark, sf), [1, 2], 1996, 1999)
    return rounded(stats.inflation_stats(table))


@query("fisher_exact", f"""
SELECT l_linenumber, a, b, c, d, {r6(fisher_sql('a', 'b', 'c', 'd'), 'p_value')} FROM (
  SELECT l_linenumber,
    count(*) FILTER (WHERE l_returnflag='R' AND l_discount>0.05) AS a, count(*) FILTER (WHERE l_returnflag='R' AND l_discount<=0.05) AS b,
    count(*) FILTER (WHERE l_returnflag<>'R' AND l_discount>0.05) AS c, count(*) FILTER (WHERE l_returnflag<>'R' AND l_discount<=0.05) AS d
  FROM lineitem GROUP BY 1)""")
def _fisher_exact(spark: SparkSession, sf: str) -> DataFrame:
    returned, high = F.col("l_returnflag") == "R", F.col("l_discount") > 0.05
    tables = fx.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.count(F.when(returned & high, 1)).alias("a"),
        F.count(F.when(returned & ~high, 1)).alias("b"),
        F.count(F.when(~returned & high, 1)).alias("c"),
        F.count(F.when(~returned & ~high, 1)).alias("d"),
    )
    return rounded(stats.fisher_greater(tables, ["l_linenumber"], ["a", "b", "c", "d"]))


_RR90 = rr_sql("a", "n1", "c", "n0", Z90)


@query("relative_risk", f"""
SELECT l_linestatus, n1 AS n_exposed, a AS n_exposed_true, n0 AS n_control, n1+n0 AS n_total,
  {r6('a/n1::DOUBLE', 'fraction_exposed')}, {r6('c/n0::DOUBLE', 'fraction_control')}, {', '.join(r6(v, k) for k, v in _RR90.items())}
FROM (SELECT l_linestatus, count(*) FILTER (WHERE l_discount>0.05) AS n1, count(*) FILTER (WHERE l_discount>0.05 AND l_returnflag='R') AS a,
        count(*) FILTER (WHERE l_discount<=0.05) AS n0, count(*) FILTER (WHERE l_discount<=0.05 AND l_returnflag='R') AS c
      FROM lineitem GROUP BY 1) WHERE n1>0 AND n0>0""")
def _relative_risk(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "lineitem")
    return rounded(
        stats.relative_risk(rows, ["l_linestatus"], F.col("l_discount") > 0.05, F.col("l_returnflag") == "R")
    )


@query("wilcoxon_by_limit", f"""
SELECT l_linenumber, l_returnflag, n_used, {r6('statistic', 'statistic')}, {r6('z', 'z')}, {r6('p_value', 'p_value')}
FROM ({signed_rank_sql('v_wx', 'l_linenumber', 'nation', 'l_returnflag', 'v', 'A')})""")
def _wilcoxon_by_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = (
        fx.table(spark, sf, "lineitem")
        .groupBy("l_linenumber", "l_returnflag", (F.col("l_suppkey") % 25).alias("nation"))
        .agg(F.max("l_quantity").alias("v"))
    )
    return rounded(stats.signed_rank(rows, ["l_linenumber"], "nation", "l_returnflag", "v", "A"))


_HAS = "greatest(FALSE, " + listing(SCORES, "coalesce({0}>0,FALSE)") + ")"


@query("cohort_stats", f"""
SELECT therapeutic_area_name, split, count(DISTINCT target_id) AS n_targets, count(DISTINCT disease_id) AS n_diseases,
  count(*) AS n_pairs, min(transition_year) AS min_year, max(transition_year) AS max_year,
  {r6(f'avg({OUTCOME}::INT)', 'balance')}, count(*) FILTER (WHERE {_HAS}) AS n_pairs_with_evidence,
  {r6(f'avg(({_HAS})::INT)', 'fraction_pairs_with_evidence')}
FROM v_splits JOIN v_areas USING (disease_id) GROUP BY 1,2""")
def _cohort_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.cohort_stats(inputs.split_cohorts(spark, sf), inputs.areas(spark, sf)))


def _present(names: list[str]) -> str:
    return "greatest(FALSE, " + listing(names, "coalesce({0}>0,FALSE)") + ")"


_GROUPS = {g: [s for s in SCORES if s.startswith(g)] for g in dict.fromkeys("__".join(s.split("__")[:2]) for s in SCORES)}
_FLAGS = {
    **{g: (_present(n), f"pair has {g.split('__')[1].replace('_', ' ')} evidence") for g, n in _GROUPS.items()},
    "target__phase_2": (f"coalesce({ENTITY[0]}>2,FALSE)", "target has prior phase 2+ trials"),
    "disease__phase_2": (f"coalesce({ENTITY[1]}>2,FALSE)", "disease has prior phase 2+ trials"),
    "target_disease__outcome": (OUTCOME, "pair has advanced beyond phase 2"),
    "target_disease__no_data": (f"NOT {_present(SCORES)}", "pair has no evidence"),
}


@query("feature_presence", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{g}' AS feature_group, count(*) AS n_pairs, '{label}' AS feature_group_label FROM v_cohort WHERE {flag}"
    for g, (flag, label) in _FLAGS.items()) + ") WHERE n_pairs>0")
def _feature_presence(spark: SparkSession, sf: str) -> DataFrame:
    return stats.feature_presence(inputs.cohort(spark, sf))


@query("presence_combinations", f"""
SELECT combination, count(*) AS n_pairs FROM (
  SELECT array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {flag} THEN '{g}' END" for g, (flag, _) in _FLAGS.items())}], lambda x: x IS NOT NULL)), ',') AS combination
  FROM v_cohort) GROUP BY 1""")
def _presence_combinations(spark: SparkSession, sf: str) -> DataFrame:
    sizes = stats.presence_combinations(inputs.cohort(spark, sf))
    return sizes.select(F.array_join("feature_groups", ",").alias("combination"), "n_pairs")
