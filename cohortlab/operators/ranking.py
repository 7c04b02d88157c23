"""How much more often do the best-ranked pairs advance? Relative risk by ranking method.

A *method* is an exposure: a feature or model score at or above some cutoff. Each value of a row is
placed once among the cutoffs of its column in its group (all rows, or one therapeutic area); counts
per place are a small table from which every method's counts follow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.frames import dimension_join, materialize
from cohortlab.functions.naming import OUTCOME, PAIR_KEY, method_parts
from cohortlab.operators.ordering import exact_quantiles, top_rows, topk_cutoffs, unpivot
from cohortlab.operators.stats import with_relative_risk

MODEL_PREFIX = "target_disease__model__"
# Default cutoffs, benchmark features and the models reported by name.
QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
LITERATURE_LIMITS = (100, 250, 500)
MODEL_LIMITS = (10, 25, 50, 75, 100, 250, 500)
#: Entity features with up to this many distinct values have each of them as a cutoff, others quantiles.
MOST_LISTED_VALUES = 10
BENCHMARKS = (
    ("omim", "OMIM", "OMIM", "target_disease__genetic_association__omim"),
    ("eva", "EVA", "EVA/ClinVar", "target_disease__genetic_association__eva"),
    ("ot_genetics_portal", "OTG", "OTG/GWAS", "target_disease__genetic_association__ot_genetics_portal"),
)
PRIMARY_MODELS = {
    "rdg__no_time__positive": "RDG",
    "rdg__all__positive": "RDG-T",
    "rdg__no_tgc__positive": "RDG-X",
    "gbm__all__unconstrained": "GBM-T",
    "ots__all": "OTS",
}

POSITIVE, EQUAL, AT_LEAST = "positive", "eq", "gte"


def _method_rows(df: DataFrame, by: Sequence[str], method: Column, column: Column, test: str,
                 cutoff: Column) -> DataFrame:
    return df.select(
        *by, method.alias("method"), column.alias("column"), F.lit(test).alias("test"),
        cutoff.cast("double").alias("cutoff"),
    )


def _limit_name(column: Column) -> Column:
    return F.concat(column, F.lit("__limit_"), F.lpad(F.col("limit").cast("string"), 4, "0"))


def entity_cutoffs(rows: DataFrame, by: Sequence[str], entity: str, features: Sequence[str],
                   most_listed: int | None = MOST_LISTED_VALUES) -> DataFrame:
    """Cutoffs of target or disease features, taken from one value per entity (its maximum).

    The rule of the ranking methods: with at most ``most_listed`` distinct values each of them is a
    cutoff, with more the quantiles are. ``None`` lists the values of every feature and 0 takes
    quantiles of every feature, so that methods keep their names whatever the data.
    """
    group = [*by, "column"]
    best = rows.groupBy(*by, f"{entity}_id").agg(*[F.max(c).cast("double").alias(c) for c in features])
    values = unpivot(
        best.select(*by, *features), list(by), list(features), "column", "value", keep_nulls=False
    )
    distinct = values.groupBy(*group, "value").count()
    sizes = distinct.groupBy(*group).agg(
        F.count("*").alias("n_values"), F.min(F.col("value") == F.floor("value")).alias("whole")
    )
    few_values = F.lit(True) if most_listed is None else F.col("n_values") <= most_listed
    listed = distinct.join(sizes.filter(few_values), group)
    number = F.when(F.col("whole"), F.col("value").cast("long").cast("string")).otherwise(
        F.col("value").cast("string")
    )
    few = _method_rows(
        listed, by, F.concat("column", F.lit("__gte_"), number), F.col("column"), AT_LEAST, F.col("value")
    )
    spread = dimension_join(values, sizes.filter(~few_values), group, "left_semi")
    quantiles = exact_quantiles(spread, group, "value", list(QUANTILES))
    percent = F.lpad(F.floor(F.col("quantile") * 100 + 1e-9).cast("string"), 3, "0")
    many = _method_rows(
        quantiles, by, F.concat("column", F.lit("__qtl_"), percent), F.col("column"), AT_LEAST, F.col("cutoff")
    )
    return few.unionByName(many)


def method_cutoffs(rows: DataFrame, by: Sequence[str], features: Sequence[str],
                   models: Sequence[str], model_limits: Sequence[int] = MODEL_LIMITS,
                   most_listed: int | None = MOST_LISTED_VALUES) -> DataFrame:
    """All methods of every group as rows (by, method, column, test, cutoff). ``most_listed``: see
    ``entity_cutoffs``."""
    by = list(by)
    pair = [c for c in features if c.startswith("target_disease__")]
    fixed = F.array(
        *[
            F.struct(
                F.lit(c).alias("method"), F.lit(c).alias("column"),
                F.lit(POSITIVE).alias("test"), F.lit(0.0).alias("cutoff"),
            )
            for c in pair
        ]
    )
    parts = [rows.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.inline(fixed))] if pair else []
    for c in [c for c in pair if c.startswith("target_disease__time__")]:
        values = rows.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("n"))
        name = F.concat(F.lit(f"{c}__eq_"), F.col(c).cast("long").cast("string"))
        parts.append(_method_rows(values, by, name, F.lit(c), EQUAL, F.col(c)))
    ranked = [(c, c, LITERATURE_LIMITS) for c in pair if c.startswith("target_disease__literature__")]
    ranked += [(m, MODEL_PREFIX + m, tuple(model_limits)) for m in models]
    for limits in dict.fromkeys(entry[2] for entry in ranked):
        names = {c: label for c, label, own in ranked if own == limits}
        long = unpivot(
            rows.select(*by, *PAIR_KEY, *[F.col(c).cast("double").alias(c) for c in names]),
            [*by, *PAIR_KEY], list(names), "column", "value", keep_nulls=False,
        )
        cutoffs = topk_cutoffs(long, [*by, "column"], "value", PAIR_KEY, list(limits))
        label = F.create_map(*[F.lit(x) for x in chain(*names.items())])[F.col("column")]
        parts.append(_method_rows(cutoffs, by, _limit_name(label), F.col("column"), AT_LEAST, F.col("cutoff")))
    for entity in ("target", "disease"):
        own = [c for c in features if c.startswith(f"{entity}__")]
        if own:
            parts.append(entity_cutoffs(rows, by, entity, own, most_listed))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def exposure_counts(rows: DataFrame, by: Sequence[str], cutoffs: DataFrame, columns: Sequence[str],
                    outcome: str = OUTCOME) -> DataFrame:
    """Rows and outcomes per group and method, exposed and not.

    The cutoffs of a column are nested, so each value is placed once among them: place 2k lies above
    cutoff k and below the next, place 2k - 1 on cutoff k. Counts per (column, place) are a small table,
    and the counts of a method are sums over its range of places. Without ``by`` the cutoffs are
    literals; with it each group brings its own as a map.
    """
    by = list(by)
    key = [*by, "column"]
    cutoffs = materialize(cutoffs)
    points = materialize(cutoffs.groupBy(*key).agg(F.sort_array(F.collect_set("cutoff")).alias("_points")))
    wanted = rows.select(*by, *PAIR_KEY, F.col(outcome).alias("_outcome"), *[F.col(c).cast("double").alias(c) for c in columns])
    if by:
        packed = points.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "_points"))).alias("_of"))
        ready = dimension_join(wanted, packed, by, spread_by=PAIR_KEY)
        places = {c: _place_in(F.col(c), F.col("_of")[c]) for c in columns}
    else:
        ready = wanted
        places = {row["column"]: _place_among(F.col(row["column"]), row["_points"]) for row in points.collect()}
    cells = [F.when(place.isNotNull(), F.struct(F.lit(c).alias("column"), place.alias("place"))) for c, place in places.items()]
    everyone = F.struct(F.lit("").alias("column"), F.lit(0).alias("place"))
    counted = materialize(
        ready.select(*by, "_outcome", F.inline(F.array_compact(F.array(everyone, *cells))))
        .groupBy(*key, "place")
        .agg(F.count("*").alias("_n"), F.count(F.when(F.col("_outcome"), 1)).alias("_hits"))
    )
    at = (2 * F.array_position("_points", F.col("cutoff"))).cast("int")
    first = F.when(F.col("test") == POSITIVE, at).otherwise(at - 1)
    ranges = cutoffs.join(points, key).select(
        *key, "method", first.alias("_first"), F.when(F.col("test") == EQUAL, at - 1).alias("_last")
    )
    held = F.col("place").between(F.col("_first"), F.coalesce("_last", "place"))
    exposed = (
        ranges.join(counted, key)
        .where(held)
        .groupBy(*by, "method")
        .agg(F.sum("_n").alias("n_exposed"), F.sum("_hits").alias("n_exposed_true"))
    )
    whole = counted.where("column = ''").select(*by, F.col("_n").alias("_all"), F.col("_hits").alias("_all_true"))
    both = exposed.join(whole, by) if by else exposed.join(F.broadcast(whole))
    return both.select(
        *by, "method", "n_exposed", "n_exposed_true",
        (F.col("_all") - F.col("n_exposed")).alias("n_control"),
        (F.col("_all_true") - F.col("n_exposed_true")).alias("n_control_true"),
    )


def _place_among(value: Column, points: Sequence[float]) -> Column:
    """Place of a value among literal cutoffs, as plain comparisons."""
    steps = [(value > p).cast("int") + (value >= p).cast("int") for p in points]
    return reduce(lambda a, b: a + b, steps, F.lit(0))


def _place_in(value: Column, points: Column) -> Column:
    below = F.size(F.filter(points, lambda p: p < value))
    return F.when(value.isNotNull() & points.isNotNull(), below + F.size(F.filter(points, lambda p: p <= value)))


def relative_risk_by_method(rows: DataFrame, by: Sequence[str], features: Sequence[str],
                            models: Sequence[str], model_limits: Sequence[int] = MODEL_LIMITS,
                            confidence: float = 0.9, min_rows: int = 0) -> DataFrame:
    """Relative risk of every method per group; groups below ``min_rows`` are left out.

    ``rows`` is read once per kind of cutoff and should be a written table.
    """
    cutoffs = method_cutoffs(rows, by, features, models, model_limits)
    counts = exposure_counts(rows, by, cutoffs, [*features, *models])
    large = counts.filter(F.col("n_exposed") + F.col("n_control") >= min_rows)
    return with_relative_risk(large, confidence)


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*mapping.items())])[key]


def enrich_relative_risk(risk: DataFrame, models: Mapping[str, str] = PRIMARY_MODELS,
                         benchmarks: Sequence[tuple[str, str, str, str]] = BENCHMARKS) -> DataFrame:
    """Model and benchmark properties encoded in the method names."""
    parts = method_parts(F.col("method"))
    benchmark = {
        name: _lookup({b[3]: b[i] for b in benchmarks}, F.col("method"))
        for i, name in enumerate(("benchmark_name", "benchmark_slug", "benchmark_disp"))
    }
    named = risk.withColumns({**parts, **benchmark})
    return named.withColumns(
        {
            "model_slug": _lookup(models, F.col("model_name")),
            "is_model_feature": F.col("model_name").isNotNull(),
            "is_primary_model_feature": F.coalesce(F.col("model_name").isin(*models), F.lit(False)),
            "is_primary_benchmark_feature": F.col("benchmark_name").isNotNull(),
        }
    )


def calibrate_limits(enriched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per model and benchmark, the limits between which the model's risk falls to the benchmark's.

    Lower: largest limit with a higher risk; upper: smallest limit with one no higher; ``limit`` is
    their mean, NULL if either is missing. Groups (``by``) are calibrated apart, and a group's two
    sides are a handful of rows: each benchmark and each (model, limit) once, which is checked.
    """
    by = list(by)
    repeated = (
        enriched.filter("is_primary_benchmark_feature OR is_primary_model_feature")
        .groupBy(*by, "benchmark_name", "model_name", "limit")
        .count()
        .filter("count > 1")
    )
    if not repeated.isEmpty():
        raise ValueError("a benchmark or a (model, limit) occurs twice in a group")
    key = ["benchmark_name", "benchmark_slug", "benchmark_relative_risk", "benchmark_n_pairs"]
    benchmark = F.struct(
        "benchmark_name", "benchmark_slug", F.col("relative_risk").alias("benchmark_relative_risk"),
        F.col("n_exposed").alias("benchmark_n_pairs"),
    )
    model = F.struct(
        F.col("model_name").alias("model"), "limit", F.col("relative_risk").alias("_risk")
    )
    sides = enriched.groupBy(*by).agg(
        F.collect_list(F.when(F.col("is_primary_benchmark_feature"), benchmark)).alias("_benchmarks"),
        F.collect_list(F.when(F.col("is_primary_model_feature"), model)).alias("_models"),
    )
    compared = sides.select(*by, "_models", F.inline("_benchmarks")).select(*by, *key, F.inline("_models"))
    above = F.col("_risk") > F.col("benchmark_relative_risk")
    below = F.col("_risk") <= F.col("benchmark_relative_risk")
    return (
        compared.groupBy(*by, "model", *key)
        .agg(
            F.max(F.when(above, F.col("limit"))).alias("limit_lower_bound"),
            F.min(F.when(below, F.col("limit"))).alias("limit_upper_bound"),
        )
        .filter(F.coalesce("limit_lower_bound", "limit_upper_bound").isNotNull())
        .withColumn("limit", (F.col("limit_lower_bound") + F.col("limit_upper_bound")) / 2)
    )


def relative_risk_thresholds(enriched: DataFrame, predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calibrated limits with the model score at that rank; NULL if the ranking is shorter.

    ``predictions`` has rows (group, pair, model, prediction). As many rows per group and model are
    ranked as the largest calibrated limit asks for. ``enriched`` should be a written table.
    """
    by = list(by)
    limits = materialize(calibrate_limits(enriched, by).withColumn("rn", F.floor("limit").cast("int")))
    deepest = limits.agg(F.max("rn")).first()[0] or 1
    ranked = top_rows(predictions, [*by, "model"], [F.col("prediction").desc()], PAIR_KEY, deepest)
    scores = ranked.select(*by, "model", "rn", F.col("prediction").alias("model_prediction_threshold"))
    return limits.join(scores, [*by, "model", "rn"], "left").drop("rn")
