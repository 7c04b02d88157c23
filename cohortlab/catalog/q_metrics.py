"""Queries: classification, regression and ranker metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.catalog import inputs
from cohortlab.catalog.registry import query, rounded
from cohortlab.catalog.views import (
    QUERY_RANKS, at_ranks_sql, calibration_sql, cell_metrics_sql, r6, threshold_metrics_sql,
)
from cohortlab.functions.frames import materialize
from cohortlab.functions.naming import OUTCOME, PAIR_KEY
from cohortlab.operators import metrics as mt
from cohortlab.operators.ontology import join_areas
from cohortlab.sources import fixtures as fx

AREA = ["therapeutic_area_id", "therapeutic_area_name"]
_BY, _KEY = ["l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Return flag as truth (-1 for no), discount as score."""
    rows = fx.table(spark, sf, "lineitem").select(
        *_BY, *_KEY,
        F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("truth"),
        F.round(F.col("l_discount") * 10, 1).alias("score"),
    )
    return mt.scored_rows(mt.check_truth(rows, "truth"), _BY, _KEY, "truth", "score")


@query("cls_threshold_metrics", threshold_metrics_sql("v_items", "l_linestatus"))
def _cls_threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mt.threshold_metrics(_items(spark, sf), _BY))


@query("roc_auc", f"SELECT l_linestatus, roc_auc FROM ({cell_metrics_sql('v_items', 'l_linestatus')})")
def _roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mt.rank_metrics(_items(spark, sf), _BY).select(*_BY, "roc_auc"))


_DOCS = "(SELECT lang, doc_id, quality::DOUBLE AS y, n_chars::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


@query("average_precision", f"SELECT * FROM ({cell_metrics_sql(_DOCS, 'lang')})")
def _average_precision(spark: SparkSession, sf: str) -> DataFrame:
    documents = fx.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = documents.join(fx.table(spark, sf, "labels"), "doc_id")
    return rounded(mt.rank_metrics(mt.scored_rows(rows, ["lang"], ["doc_id"], "quality", "n_chars"), ["lang"]))


@query("calibration_metrics", calibration_sql(
    "(SELECT l_linestatus, y, score/10 AS score FROM v_items)", "l_linestatus"))
def _calibration_metrics(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf).withColumn("score", F.col("score") / 10)
    return rounded(mt.calibration_metrics(items, _BY))


@query("rank_metrics_at_k", at_ranks_sql("v_items", "l_linestatus", "l_orderkey, l_linenumber, l_partkey, l_extendedprice", mt.DEFAULT_RANKS))
def _rank_metrics_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mt.metrics_at_ranks(_items(spark, sf), _BY, _KEY))


@query("regression_metrics", f"""
SELECT l_linenumber, count(*) AS n_samples, {r6('1-var_pop(y-p)/var_pop(y)', 'explained_variance')}, {r6('avg((y-p)*(y-p))', 'mean_squared_error')},
  {r6('avg(abs(y-p))', 'mean_absolute_error')}, {r6('1-avg((y-p)*(y-p))/var_pop(y)', 'r2')}
FROM (SELECT l_linenumber, l_extendedprice/1000 AS y, l_quantity*1.5 AS p FROM lineitem) GROUP BY 1""")
def _regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "lineitem").select(
        "l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("p")
    )
    return rounded(mt.regression_metrics(rows, ["l_linenumber"], "y", "p"))


@query("metrics_by_area", "SELECT * FROM v_area_metrics")
def _metrics_by_area(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(area_metrics(inputs.scored_cohort(spark, sf), inputs.areas(spark, sf)))


def area_metrics(scored: DataFrame, areas: DataFrame) -> DataFrame:
    """Classifier metrics per area and model; areas with a single class are left out."""
    long = inputs.long_predictions(scored, [*PAIR_KEY, OUTCOME])
    rows = materialize(join_areas(long.withColumn(OUTCOME, F.col(OUTCOME).cast("double")), areas))
    by = [*AREA, "model"]
    found = mt.classification_metrics(rows, by, PAIR_KEY, OUTCOME, "prediction", mt.AREA_RANKS)
    return found.filter((F.col("n_positives") > 0) & (F.col("n_positives") < F.col("n_samples")))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """One query per user; relevance is a value bucket, the score is arbitrary but has ties."""
    return fx.table(spark, sf, "events").select(
        "user_id", "event_id", F.floor(F.col("value") / 20).cast("double").alias("y"),
        (F.col("event_id") % 97).cast("double").alias("score"),
    )


@query("ndcg_at_k", "SELECT user_id, " + ", ".join(r6(f'"ndcg@{k}"', f'"ndcg@{k}"') for k in QUERY_RANKS) + " FROM v_ndcg")
def _ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mt.ndcg_at_ranks(_events(spark, sf).filter("y IS NOT NULL"), ["user_id"]))


@query("kendall_tau", f"SELECT user_id, {r6('kendalls_tau', 'kendalls_tau')} FROM v_kendall")
def _kendall_tau(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mt.kendall_tau(_events(spark, sf).filter("y IS NOT NULL"), ["user_id"]))


_MEANS = ["kendalls_tau", *[f"ndcg@{k}" for k in QUERY_RANKS], "balance", "precision", "recall", "f1", "mcc",
          "roc_auc", "average_precision", "brier", "balanced_mae", "log_loss",
          *[f"{m}@{k}" for m in ("precision", "average_precision", "recall") for k in QUERY_RANKS]]


@query("ranker_metrics", "SELECT 'all' AS model, CAST(sum(n_relevant) AS BIGINT) AS n_relevant, CAST(sum(n_samples) AS BIGINT) AS n_samples, "
       "CAST(sum(n_positives) AS BIGINT) AS n_positives, " + ", ".join(f'round(avg("{c}"), 4) + 0.0 AS "{c}"' for c in _MEANS) + " FROM v_query_metrics")
def _ranker_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).withColumn("model", F.lit("all"))
    per_query = mt.query_metrics(rows, ["model"], "user_id", ["event_id"], "y", "score")
    return rounded(mt.ranker_metrics(per_query, ["model"], "user_id"), 4)
