"""Queries: folds, models and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.catalog import inputs
from cohortlab.catalog.registry import query, rounded
from cohortlab.catalog.views import ENTITY, MODEL_NAMES, OUTCOME, SCORES, TARGET_STATIC, TIME, listing, r6, scored_sql
from cohortlab.functions.frames import materialize, scratch_path
from cohortlab.functions.naming import PAIR_KEY
from cohortlab.operators import explain as ex
from cohortlab.operators import folds as fd
from cohortlab.operators import linear as ln
from cohortlab.operators import logistic as lg
from cohortlab.operators import metrics as mt
from cohortlab.operators import models as md
from cohortlab.operators.dataset import create_modeling_dataset
from cohortlab.operators.boosting import Boosting, Member, grouped_probability, grow
from cohortlab.sources import fixtures as fx
from cohortlab.sources.sinks import load_dataset, save_dataset

CORE = [*SCORES, *ENTITY, *TARGET_STATIC, TIME]
_PAIR = "target_id, disease_id"


def _training(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(inputs.cohort(spark, sf))


@query("group_kfold", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(CASE WHEN (pos//5)%2=0 THEN pos%5 ELSE 4-pos%5 END AS INT) AS fold
FROM lineitem JOIN (SELECT l_suppkey, row_number() OVER (ORDER BY count(*) DESC, l_suppkey)-1 AS pos FROM lineitem GROUP BY 1) USING (l_suppkey)""")
def _group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"
    )
    return fd.group_kfold(rows, 5, "l_suppkey").drop("l_suppkey")


@query("stratified_kfold", """
SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY substr(md5('0|'||o_orderkey),1,8), o_orderkey)-1)%5 AS INT) AS fold
FROM orders""")
def _stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return fd.stratified_kfold(rows, 5, "o_orderstatus", ["o_orderkey"])


@query("stratified_group_kfold", """
SELECT target_id, disease_id, CAST(CASE WHEN (pos//5)%2=0 THEN pos%5 ELSE 4-pos%5 END AS INT) AS fold
FROM v_cohort JOIN (SELECT target_id, row_number() OVER (ORDER BY avg(target_disease__outcome__advanced::INT) DESC, count(*) DESC, target_id)-1 AS pos
  FROM v_cohort GROUP BY 1) USING (target_id)""")
def _stratified_group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    # Read for the groups and again for the rows.
    rows = materialize(inputs.cohort(spark, sf).select(*PAIR_KEY, OUTCOME))
    return fd.stratified_kfold(rows, 5, OUTCOME, PAIR_KEY, group="target_id").drop(OUTCOME)


@query("add_unlabeled", f"""
SELECT {_PAIR}, {OUTCOME}, 'train' AS fold FROM v_cohort
UNION ALL SELECT {_PAIR}, CAST(NULL AS BOOLEAN), 'oos' FROM v_evaluation""")
def _add_unlabeled(spark: SparkSession, sf: str) -> DataFrame:
    both = inputs.split_cohorts(spark, sf)
    train = both.filter(F.col("split") == "training").select(*PAIR_KEY, OUTCOME)
    rows = fd.single_split(train, "train", "fold")
    extra = both.filter(F.col("split") == "evaluation").select(
        *PAIR_KEY, F.lit(None).cast("boolean").alias(OUTCOME)
    )
    return fd.add_unlabeled(rows, extra, [OUTCOME], "oos")


_MEANS = "SELECT " + listing(TARGET_STATIC, "avg({0}) AS {0}") + " FROM (SELECT target_id, " + listing(
    TARGET_STATIC, "max({0}) AS {0}") + " FROM v_cohort GROUP BY 1)"


@query("impute_features", f"SELECT {_PAIR}, " + ", ".join(
    r6(f"coalesce(c.{c}, m.{c})" if c in TARGET_STATIC else f"coalesce({c}::DOUBLE,0)", c) for c in CORE)
    + f" FROM v_cohort c CROSS JOIN ({_MEANS}) m")
def _impute_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ln.impute(_training(spark, sf).select(*PAIR_KEY, *CORE), CORE))


@query("minmax_scale", """
SELECT l_orderkey, l_linenumber, l_partkey, """ + ", ".join(r6(f"(({c}-lo_{c})/nullif(hi_{c}-lo_{c},0))", c) for c in ("l_quantity", "l_extendedprice", "l_tax"))
    + """ FROM lineitem CROSS JOIN (SELECT """ + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in ("l_quantity", "l_extendedprice", "l_tax")) + " FROM lineitem)")
def _minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *names)
    return rounded(ln.scale(rows, ln.feature_ranges(rows, names)))


# Two features have a closed form: Cramer's rule on the centred moments, with the penalty added.
_RIDGE = """
SELECT x1, x2, (c1*(s22+a)-c2*s12)/((s11+a)*(s22+a)-s12*s12) AS w1,
  (c2*(s11+a)-c1*s12)/((s11+a)*(s22+a)-s12*s12) AS w2, y
FROM (SELECT 1e-6::DOUBLE AS a, avg(x1) AS x1, avg(x2) AS x2, avg(y) AS y, count(*)*var_pop(x1) AS s11, count(*)*var_pop(x2) AS s22,
        count(*)*covar_pop(x1,x2) AS s12, count(*)*covar_pop(x1,y) AS c1, count(*)*covar_pop(x2,y) AS c2
      FROM (SELECT l_quantity/50 AS x1, l_discount*10 AS x2, l_extendedprice/100000 AS y FROM lineitem))"""


def _ridge_rows(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("x1"),
        (F.col("l_discount") * 10).alias("x2"), (F.col("l_extendedprice") / 100000).alias("y"),
    )


@query("ridge_fit", f"""
SELECT 'x1' AS feature, {r6('w1', 'coefficient')}, {r6('y-w1*x1-w2*x2', 'intercept')} FROM ({_RIDGE})
UNION ALL SELECT 'x2', {r6('w2', 'coefficient')}, {r6('y-w1*x1-w2*x2', 'intercept')} FROM ({_RIDGE})""")
def _ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    model = ln.fit_ridge(_ridge_rows(spark, sf), ["x1", "x2"], "y", scaling=False, imputing=False)
    rows = [(c, w, model.intercept) for c, w in model.coefficients.items()]
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double, intercept double"))


@query("ridge_predict", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {r6('greatest(0.0,least(1.0,f.y-w1*x1-w2*x2+w1*l_quantity/50+w2*l_discount*10))', 'prediction')}
FROM lineitem CROSS JOIN ({_RIDGE}) f""")
def _ridge_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ridge_rows(spark, sf)
    model = ln.fit_ridge(rows, ["x1", "x2"], "y", scaling=False, imputing=False)
    return rounded(model.predict(rows, "prediction").drop("x1", "x2", "y"))


@query("weighted_composite", f"SELECT {_PAIR}, ots__all AS prediction FROM v_scored")
def _weighted_composite(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.cohort(spark, sf).select(
        *PAIR_KEY, F.round(ln.weighted_composite(inputs.COMPOSITE_FEATURES), 6).alias("prediction")
    )


_SHARE = f"(SELECT avg({OUTCOME}::INT) FROM v_cohort)"
_DRAW = "('0x'||substr(md5('{0}|'||target_id||'|'||disease_id),1,8))::BIGINT/4294967296.0::DOUBLE"


@query("baseline_prior", " UNION ALL ".join(
    [f"SELECT {_PAIR}, 'baseline__most_frequent' AS model, CASE WHEN {_SHARE}>0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction FROM v_cohort"]
    + [f"SELECT {_PAIR}, 'baseline__random_seed_{s}', CASE WHEN {_DRAW.format(s)}<{_SHARE} THEN 1.0::DOUBLE ELSE 0.0 END FROM v_cohort" for s in range(3)]))
def _baseline_prior(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training(spark, sf)
    specs = [s for s in md.model_grid(CORE) if s.algorithm == "baseline"]
    return md.predict_long(rows, md.fit_models(rows, specs, OUTCOME, CORE), PAIR_KEY)


@query("logreg_cv")
def _logreg_cv(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training(spark, sf)
    model = md.fit_logistic(rows, CORE, OUTCOME)
    return md.predict_long(rows, {"lrg__all__unconstrained": model}, PAIR_KEY)


@query("gbt_fit")
def _gbt_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training(spark, sf)
    model = md.fit_boosting(rows, CORE, OUTCOME)
    return md.predict_long(rows, {"gbm__all__unconstrained": model}, PAIR_KEY)


@query("predict_long")
def _predict_long(spark: SparkSession, sf: str) -> DataFrame:
    """Every ridge model, the composite and the baselines, fitted on one cohort, applied to the next."""
    both = inputs.split_cohorts(spark, sf)
    rows, later = (both.filter(F.col("split") == s) for s in ("training", "evaluation"))
    models = md.fit_models(rows, md.model_grid(CORE, boosting=False, logistic=False), OUTCOME, CORE)
    return rounded(md.predict_long(later, models, PAIR_KEY))


_TWO = [TIME, ENTITY[0]]
# Ridge on two features of one cohort, applied to the next: ranges and moments of the first alone.
_RIDGE_TWO = f"""
SELECT lo1, d1, lo2, d2, (c1*(s22+a)-c2*s12)/((s11+a)*(s22+a)-s12*s12) AS w1, (c2*(s11+a)-c1*s12)/((s11+a)*(s22+a)-s12*s12) AS w2, x1, x2, y
FROM (SELECT 1e-6::DOUBLE AS a, any_value(lo1) AS lo1, any_value(d1) AS d1, any_value(lo2) AS lo2, any_value(d2) AS d2, avg(s1) AS x1, avg(s2) AS x2, avg(y) AS y,
    count(*)*var_pop(s1) AS s11, count(*)*var_pop(s2) AS s22, count(*)*covar_pop(s1,s2) AS s12, count(*)*covar_pop(s1,y) AS c1, count(*)*covar_pop(s2,y) AS c2
  FROM (SELECT lo1, d1, lo2, d2, (x1-lo1)/d1 AS s1, (x2-lo2)/d2 AS s2, y
    FROM (SELECT coalesce({_TWO[0]},0)::DOUBLE AS x1, coalesce({_TWO[1]},0)::DOUBLE AS x2, {OUTCOME}::INT::DOUBLE AS y FROM v_cohort)
    CROSS JOIN (SELECT min(coalesce({_TWO[0]},0))::DOUBLE AS lo1, coalesce(nullif(max(coalesce({_TWO[0]},0))-min(coalesce({_TWO[0]},0)),0),1)::DOUBLE AS d1,
        min(coalesce({_TWO[1]},0))::DOUBLE AS lo2, coalesce(nullif(max(coalesce({_TWO[1]},0))-min(coalesce({_TWO[1]},0)),0),1)::DOUBLE AS d2 FROM v_cohort)))"""


@query("predict_two", " UNION ALL ".join([
    f"SELECT {_PAIR}, 'rdg__two__unconstrained' AS model, {r6(f'greatest(0.0,least(1.0,y-w1*x1-w2*x2+w1*greatest(0.0,least(1.0,(coalesce({_TWO[0]},0)-lo1)/d1))+w2*greatest(0.0,least(1.0,(coalesce({_TWO[1]},0)-lo2)/d2))))', 'prediction')} FROM v_evaluation CROSS JOIN ({_RIDGE_TWO})",
    f"SELECT {_PAIR}, 'ots__all', ots__all FROM ({scored_sql('v_evaluation')})",
    f"SELECT {_PAIR}, 'baseline__most_frequent', CASE WHEN {_SHARE}>0.5 THEN 1.0::DOUBLE ELSE 0.0 END FROM v_evaluation",
    *[f"SELECT {_PAIR}, 'baseline__random_seed_{s}', CASE WHEN {_DRAW.format(s)}<{_SHARE} THEN 1.0::DOUBLE ELSE 0.0 END FROM v_evaluation" for s in range(3)]]))
def _predict_two(spark: SparkSession, sf: str) -> DataFrame:
    """The part of ``predict_long`` that SQL can repeat: ridge with two features, composite, baselines."""
    both = inputs.split_cohorts(spark, sf)
    rows, later = (both.filter(F.col("split") == s) for s in ("training", "evaluation"))
    specs = [s for s in md.model_grid(CORE, False, False) if s.algorithm == "baseline"]
    specs += [md.ModelSpec("rdg__two__unconstrained", "rdg", _TWO), md.ModelSpec("ots__all", "ots", inputs.COMPOSITE_FEATURES)]
    return rounded(md.predict_long(later, md.fit_models(rows, specs, OUTCOME, _TWO), PAIR_KEY))


_PENALTIES = (0.01, 1.0, 100.0)


# Newton's steps as a recursive query: 3 x 3 systems by Cramer's rule, one row per (excluded fold, penalty).
@query("logistic_newton", f"""
WITH RECURSIVE raw AS (SELECT l_linenumber % 3 AS fold, l_quantity/50 AS x1, l_discount*10 AS x2, (l_returnflag='R')::INT::DOUBLE AS y FROM lineitem),
r AS (SELECT fold, (x1-m1)/d1 AS x1, (x2-m2)/d2 AS x2, y FROM raw
  CROSS JOIN (SELECT avg(x1) AS m1, stddev_pop(x1) AS d1, avg(x2) AS m2, stddev_pop(x2) AS d2 FROM raw)),
w AS (
  SELECT 0 AS i, f, c, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
  FROM (VALUES (-1),(0),(1),(2)) a(f) CROSS JOIN (VALUES {', '.join(f'({c}::DOUBLE)' for c in _PENALTIES)}) p(c)
  UNION ALL
  SELECT i+1, f, c, b0-(g0*(h11*h22-h12*h12)-h01*(g1*h22-h12*g2)+h02*(g1*h12-h11*g2))/det,
    b1-(h00*(g1*h22-g2*h12)-g0*(h01*h22-h12*h02)+h02*(h01*g2-g1*h02))/det,
    b2-(h00*(h11*g2-h12*g1)-h01*(h01*g2-g1*h02)+g0*(h01*h12-h11*h02))/det
  FROM (SELECT *, h00*(h11*h22-h12*h12)-h01*(h01*h22-h12*h02)+h02*(h01*h12-h11*h02) AS det FROM (
    SELECT i, f, c, b0, b1, b2, sum(p-y) AS g0, sum((p-y)*x1)+b1/c AS g1, sum((p-y)*x2)+b2/c AS g2, sum(p*(1-p)) AS h00, sum(p*(1-p)*x1) AS h01,
      sum(p*(1-p)*x2) AS h02, sum(p*(1-p)*x1*x1)+1/c AS h11, sum(p*(1-p)*x1*x2) AS h12, sum(p*(1-p)*x2*x2)+1/c AS h22
    FROM (SELECT w.*, r.x1, r.x2, r.y, 1/(1+exp(-(b0+b1*r.x1+b2*r.x2))) AS p FROM w JOIN r ON r.fold<>w.f)
    GROUP BY i, f, c, b0, b1, b2))
  WHERE i<9)
SELECT f AS excluded, c AS inverse_penalty, round(b0,5)+0.0 AS intercept, round(b1,5)+0.0 AS w1, round(b2,5)+0.0 AS w2 FROM w WHERE i=9""")
def _logistic_newton(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic models for all penalties and excluded folds from one scan per Newton step."""
    rows = fx.table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("fold"), (F.col("l_quantity") / 50).alias("x1"),
        (F.col("l_discount") * 10).alias("x2"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    prepared = materialize(lg.prepared(rows, ["x1", "x2"], "y", None, "fold"))
    scales = lg.standards(rows, ["x1", "x2"], None)
    tasks = [lg.Task((f, c), c, None, None if f < 0 else str(f)) for f in (-1, 0, 1, 2) for c in _PENALTIES]
    weights = lg.fit_tasks(prepared, ["x1", "x2"], tasks, scales)
    found = [(f, c, *map(float, w)) for (f, c), w in weights.items()]
    schema = "excluded int, inverse_penalty double, intercept double, w1 double, w2 double"
    return rounded(spark.createDataFrame(found, schema), 5)


@query("fit_properties", """
SELECT m AS model, (SELECT count(*) FROM v_cohort) AS n_pairs, 0::BIGINT AS n_outside, TRUE AS ranks_better_than_chance
FROM (VALUES ('gbm__no_tgc__positive'),('gbm__no_tgc__unconstrained'),('lrg__no_tgc__unconstrained')) t(m)""")
def _fit_properties(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for fits that SQL cannot repeat: every pair has one probability, and they rank better
    than chance on the rows of the fit."""
    rows = _training(spark, sf)
    specs = [s for s in md.model_grid(CORE) if s.algorithm in ("gbm", "lrg") and "__no_tgc__" in s.slug]
    models = md.fit_models(rows, specs, OUTCOME, CORE, Boosting(rounds=10))
    long = materialize(md.predict_long(rows, models, [*PAIR_KEY, OUTCOME]))
    ranks = mt.rank_metrics(mt.scored_rows(long, ["model"], PAIR_KEY, OUTCOME, "prediction"), ["model"])
    sizes = long.groupBy("model").agg(
        F.count_distinct(*PAIR_KEY).alias("n_pairs"),
        F.count_if(~F.coalesce(F.col("prediction").between(0, 1), F.lit(False))).alias("n_outside"),
    )
    return sizes.join(ranks, "model").select("model", "n_pairs", "n_outside", (F.col("roc_auc") > 0.5).alias("ranks_better_than_chance"))


_CV_ROWS = "SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS fold, l_quantity/50 AS x1, l_discount*10 AS x2, (l_returnflag='R')::INT::DOUBLE AS y FROM lineitem"


@query("run_cv_two", f"""
WITH r AS ({_CV_ROWS}),
lim AS (SELECT f.fold, min(x1) AS lo1, max(x1)-min(x1) AS d1, min(x2) AS lo2, max(x2)-min(x2) AS d2
  FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold<>f.fold GROUP BY 1),
m AS (SELECT fold, 1e-6::DOUBLE AS a, avg(s1) AS x1, avg(s2) AS x2, avg(y) AS y, count(*)*var_pop(s1) AS s11, count(*)*var_pop(s2) AS s22,
    count(*)*covar_pop(s1,s2) AS s12, count(*)*covar_pop(s1,y) AS c1, count(*)*covar_pop(s2,y) AS c2
  FROM (SELECT lim.fold, (x1-lo1)/d1 AS s1, (x2-lo2)/d2 AS s2, y FROM lim JOIN r ON r.fold<>lim.fold) GROUP BY 1),
w AS (SELECT *, (c1*(s22+a)-c2*s12)/((s11+a)*(s22+a)-s12*s12) AS w1, (c2*(s11+a)-c1*s12)/((s11+a)*(s22+a)-s12*s12) AS w2 FROM m),
p AS (
  SELECT r.fold, 'rdg__two__unconstrained' AS model, r.y, greatest(0.0,least(1.0,w.y-w1*w.x1-w2*w.x2+w1*greatest(0.0,least(1.0,(r.x1-lo1)/d1))+w2*greatest(0.0,least(1.0,(r.x2-lo2)/d2)))) AS p
  FROM r JOIN w ON w.fold=r.fold JOIN lim ON lim.fold=r.fold
  UNION ALL SELECT r.fold, 'baseline__most_frequent', r.y, CASE WHEN w.y>0.5 THEN 1.0 ELSE 0.0 END FROM r JOIN w ON w.fold=r.fold)
SELECT fold::VARCHAR AS fold, model, count(*) AS n, {r6('avg(p)', 'mean_prediction')}, {r6('avg((p-y)*(p-y))', 'brier')} FROM p GROUP BY 1, 2""")
def _run_cv_two(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("fold"), (F.col("l_quantity") / 50).alias("x1"),
        (F.col("l_discount") * 10).alias("x2"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    specs = [md.ModelSpec("rdg__two__unconstrained", "rdg", ["x1", "x2"]), md.ModelSpec("baseline__most_frequent", "baseline", [])]
    error = F.pow(F.col("prediction") - F.col("y"), F.lit(2))

    def score(predictions: DataFrame) -> DataFrame:
        return predictions.groupBy("fold", "model").agg(
            F.count("*").alias("n"), F.avg("prediction").alias("mean_prediction"), F.avg(error).alias("brier")
        )

    _, scores = md.run_cv(materialize(rows), "fold", 3, specs, "y", ["x1", "x2"], score, ["l_orderkey", "l_linenumber", "y"])
    return rounded(scores)


@query("run_cv")
def _run_cv(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(fd.group_kfold(materialize(inputs.cohort(spark, sf)), 3, "target_id"))
    specs = [s for s in md.model_grid(CORE, False, False) if s.slug in (*MODEL_NAMES, "baseline__random_seed_0")]

    def score(predictions: DataFrame) -> DataFrame:
        by = ["fold", "model"]
        return mt.long_scores(mt.classification_metrics(predictions, by, PAIR_KEY, OUTCOME, "prediction"), by)

    _, scores = md.run_cv(rows, "fold", 3, specs, OUTCOME, CORE, score, [*PAIR_KEY, OUTCOME])
    return rounded(scores)


# Each fold is scaled by the ranges and fitted on the moments of the other folds alone.
@query("ridge_cv_closed", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 3 AS fold, l_quantity/50 AS x1, l_discount*10 AS x2,
    l_extendedprice/100000 AS y FROM lineitem),
lim AS (SELECT f.fold, min(x1) AS lo1, max(x1)-min(x1) AS d1, min(x2) AS lo2, max(x2)-min(x2) AS d2
  FROM (SELECT DISTINCT fold FROM r) f JOIN r ON r.fold<>f.fold GROUP BY 1),
m AS (SELECT fold, 1e-6::DOUBLE AS a, avg(s1) AS x1, avg(s2) AS x2, avg(y) AS y, count(*)*var_pop(s1) AS s11, count(*)*var_pop(s2) AS s22,
    count(*)*covar_pop(s1,s2) AS s12, count(*)*covar_pop(s1,y) AS c1, count(*)*covar_pop(s2,y) AS c2
  FROM (SELECT lim.fold, (x1-lo1)/d1 AS s1, (x2-lo2)/d2 AS s2, y FROM lim JOIN r ON r.fold<>lim.fold) GROUP BY 1),
w AS (SELECT *, (c1*(s22+a)-c2*s12)/((s11+a)*(s22+a)-s12*s12) AS w1, (c2*(s11+a)-c1*s12)/((s11+a)*(s22+a)-s12*s12) AS w2 FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, r.fold, {r6('greatest(0.0,least(1.0,w.y-w1*w.x1-w2*w.x2+w1*greatest(0.0,least(1.0,(r.x1-lo1)/d1))'
    '+w2*greatest(0.0,least(1.0,(r.x2-lo2)/d2))))', 'prediction')}
FROM r JOIN w ON w.fold=r.fold JOIN lim ON lim.fold=r.fold""")
def _ridge_cv_closed(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(_ridge_rows(spark, sf).withColumn("fold", F.col("l_linenumber") % 3))
    return rounded(md.ridge_cv(rows, "fold", ["x1", "x2"], "y", ["l_orderkey", "l_linenumber", "l_partkey"]))


@query("ridge_cv")
def _ridge_cv(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(fd.group_kfold(materialize(inputs.cohort(spark, sf)), 5, "target_id"))
    return rounded(md.ridge_cv(rows, "fold", CORE, OUTCOME, PAIR_KEY, positive=True))


@query("dataset_round_trip", f"SELECT {_PAIR}, {listing(SCORES, r6('{0}', '{0}'))}, {OUTCOME} FROM v_cohort")
def _dataset_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A modelling dataset stored with its roles and a model, and read back."""
    path = scratch_path(spark)
    dataset = create_modeling_dataset(_training(spark, sf).drop("transition_year", "feature_year"))
    save_dataset(dataset, path, {"fixed": inputs.MODELS[0]})
    again, models = load_dataset(spark, path)
    if again.roles() != dataset.roles() or models != {"fixed": inputs.MODELS[0]}:
        raise ValueError("roles or models changed")
    return rounded(again.rows.select(*PAIR_KEY, *SCORES, OUTCOME))


_MODEL = inputs.MODELS[1]
_WEIGHTS = _MODEL.coefficients


@query("linear_contributions", " UNION ALL ".join(
    f"SELECT {_PAIR}, '{c}' AS feature, {r6(f'{round(w, 6)}::DOUBLE*coalesce({c},0)', 'contribution')} FROM v_cohort" for c, w in _WEIGHTS.items()))
def _linear_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ex.linear_contributions(inputs.cohort(spark, sf), _MODEL, PAIR_KEY))


@query("linear_shap", " UNION ALL ".join(
    f"SELECT {_PAIR}, '{c}' AS feature, "
    + (r6(f"{round(_WEIGHTS[c], 6)}::DOUBLE*(coalesce({c},0)-avg(coalesce({c},0)) OVER ())", "shap_value") if c in _WEIGHTS else "CAST(NULL AS DOUBLE) AS shap_value")
    + ", " + r6(" + ".join(f"{round(w, 6)}::DOUBLE*avg(coalesce({n},0)) OVER ()" for n, w in _WEIGHTS.items()), "base_value")
    + " FROM v_cohort" for c in CORE))
def _linear_shap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ex.linear_shap(_training(spark, sf), _MODEL, PAIR_KEY, CORE))


_FOLDED = """
SELECT v_cohort.*, CASE WHEN (pos//3)%2=0 THEN pos%3 ELSE 2-pos%3 END AS fold FROM v_cohort
JOIN (SELECT target_id, row_number() OVER (ORDER BY count(*) DESC, target_id)-1 AS pos FROM v_cohort GROUP BY 1) USING (target_id)"""
# Fixed coefficients per fold, the third model missing: its rows are explained by the first.
_FOLD_MODELS = {f: ln.LinearModel(f"m{f}", {c: round(w * (1 + f), 6) for c, w in _WEIGHTS.items()}, 0.1, False) for f in (0, 1)}


def _by_fold(value) -> str:
    return f"(CASE WHEN fold=1 THEN {value(1)} ELSE {value(0)} END)"


@query("explain_held_out", " UNION ALL ".join(
    f"SELECT {_PAIR}, fold, '{c}' AS feature, "
    + (r6(f"{_by_fold(lambda f, c=c: f'{_FOLD_MODELS[f].coefficients[c]}::DOUBLE')}*(coalesce({c},0)-avg(coalesce({c},0)) OVER (PARTITION BY fold=1))", "shap_value")
       if c in _WEIGHTS else "CAST(NULL AS DOUBLE) AS shap_value")
    + ", " + r6("0.1::DOUBLE + " + " + ".join(
        f"{_by_fold(lambda f, n=n: f'{_FOLD_MODELS[f].coefficients[n]}::DOUBLE')}*avg(coalesce({n},0)) OVER (PARTITION BY fold=1)" for n in _WEIGHTS), "base_value")
    + f" FROM ({_FOLDED})" for c in CORE))
def _explain_held_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(fd.group_kfold(_training(spark, sf), 3, "target_id"))
    return rounded(ex.explain_held_out(rows, "fold", _FOLD_MODELS, PAIR_KEY, CORE))


@query("explain_trees", f"SELECT {_PAIR}, {len(CORE)}::BIGINT AS n_features, 0.0::DOUBLE AS gap FROM v_cohort")
def _explain_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Path-dependent shares of boosted trees of every fold add up to the margin of the held-out row."""
    rows = materialize(fd.group_kfold(_training(spark, sf), 3, "target_id").withColumn("fold", F.col("fold").cast("string")))
    members = [Member(f, tuple(CORE), False, f) for f in ("0", "1", "2")]
    models = grow(rows, OUTCOME, members, "fold", Boosting(rounds=10))
    shares = ex.explain_held_out(rows, "fold", models, PAIR_KEY, CORE)
    sums = shares.groupBy(*PAIR_KEY).agg(
        F.count("shap_value").alias("n_features"), (F.sum("shap_value") + F.max("base_value")).alias("total")
    )
    p = grouped_probability(F.col("fold"), models)
    margins = rows.select(*PAIR_KEY, F.log(p / (1 - p)).alias("margin"))
    return rounded(sums.join(margins, PAIR_KEY).select(*PAIR_KEY, "n_features", F.abs(F.col("total") - F.col("margin")).alias("gap")))


def _type_sql(c: str) -> str:
    for marker, name in ex.EVIDENCE_TYPES:
        if marker in c:
            return name
    return "5. target properties" if c.startswith("target__") else "6. other"


@query("effect_summary", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6('min(v)', 'min')}, {r6('max(v)', 'max')}, {r6('avg(v)', 'mean')}, {r6('median(v)', 'median')}, "
    f"{round(w, 6)}::DOUBLE AS coefficient, '{_type_sql(c)}' AS evidence_type, count(*) AS n "
    f"FROM (SELECT {round(w, 6)}::DOUBLE*{c} AS v FROM v_cohort WHERE {c}>0)" for c, w in _WEIGHTS.items()).replace(", count(*) AS n ", " ")
    + ") WHERE mean>0")
def _effect_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ex.effect_summary(_training(spark, sf), _MODEL, PAIR_KEY))
