"""Data-quality checks. Each returns counts of violations; ``enforce`` turns them into errors.

No check counts distinct values: whether a group holds one value follows from its minimum, maximum
and NULL count, which combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.naming import FEATURE_KEY, PAIR_KEY, feature_info, features_of_kind


class QualityError(ValueError):
    pass


def _open_counts(df: DataFrame, columns: list[str], counts: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate row, opened to one row per feature."""
    entries = [
        F.struct(F.lit(c).alias("feature"), *[col.alias(name) for name, col in counts[c].items()])
        for c in columns
    ]
    return df.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows"))


def varying_groups(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Per feature: how many groups there are and how many hold more than one value.

    NULL counts as a value. A static feature must vary in no entity, a feature with one value per
    (entity, year) in no such group, and a feature that depends on time within at least one year.
    """
    grouped = df.groupBy(*by).agg(
        *[
            (
                (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
            ).alias(c)
            for c in columns
        ]
    )
    counts = {
        c: {"n_groups": F.count("*"), "n_varying": F.count(F.when(F.col(c), 1))} for c in columns
    }
    return _open_counts(grouped, columns, counts)


def decreasing_steps(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Per feature: how often a value is below that of the preceding year.

    Rows are first reduced to one per (group, year), so the window sees no more rows per group
    than there are years. A NULL on either side passes.
    """
    yearly = df.groupBy(*by, "year").agg(
        *[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns]
    )
    in_time = Window.partitionBy(*by).orderBy(F.asc_nulls_last("year"))
    steps = yearly.select(
        *[(F.col(f"{c}_lo") < F.lag(f"{c}_hi").over(in_time)).alias(c) for c in columns]
    )
    return _open_counts(steps, columns, {c: {"n_decreasing": F.count(F.when(F.col(c), 1))} for c in columns})


def key_violations(df: DataFrame, key: list[str], not_null: list[str],
                   allowed: dict[str, list] | None = None) -> DataFrame:
    """One row: row count, repeated keys, NULLs and values outside the allowed ones."""
    allowed = allowed or {}
    counted = df.groupBy(*key).agg(
        F.count("*").alias("n"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__null") for c in not_null],
        *[
            F.count(F.when(~F.col(c).isin(values), 1)).alias(f"{c}__other")
            for c, values in allowed.items()
        ],
    )
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated_keys"),
        *[F.coalesce(F.sum(f"{c}__null"), F.lit(0)).alias(f"n_null__{c}") for c in not_null],
        *[F.coalesce(F.sum(f"{c}__other"), F.lit(0)).alias(f"n_other__{c}") for c in allowed],
    )


def enforce_keys(df: DataFrame, key: list[str], not_null: list[str] | None = None,
                 allowed: dict[str, list] | None = None, expected_rows: int | None = None) -> DataFrame:
    found = key_violations(df, key, not_null or [], allowed).first().asDict()
    n_rows = found.pop("n_rows")
    broken = {name: n for name, n in found.items() if n}
    if broken or (expected_rows is not None and n_rows != expected_rows):
        raise QualityError(f"{broken or ''} rows={n_rows} expected={expected_rows}")
    return df


def _entity_key(entity: str) -> list[str]:
    return PAIR_KEY if entity == "target_disease" else [f"{entity}_id"]


def validate_features(features: DataFrame, has_timeseries: bool = True) -> DataFrame:
    """Raise if a static feature changes, a temporal one never changes or ever decreases, or a
    target or disease feature differs between pairs in the same year. Returns the input."""
    names = [f.feature for f in feature_info([c for c in features.columns if c not in FEATURE_KEY])]

    def failing(report: DataFrame, condition: str) -> list[str]:
        return [r["feature"] for r in report.filter(condition).collect()]

    problems: dict[str, list[str]] = {}
    for entity in ("target", "disease", "target_disease"):
        key = _entity_key(entity)
        static = features_of_kind(names, "static", entity)
        temporal = features_of_kind(names, "temporal", entity)
        if static and entity != "target_disease":
            problems[f"{entity}: static features change"] = failing(
                varying_groups(features, static, key), "n_varying > 0"
            )
        if temporal and has_timeseries:
            problems[f"{entity}: temporal features never vary"] = failing(
                varying_groups(features, temporal, ["year"]), "n_varying = 0"
            )
            problems[f"{entity}: temporal features decrease"] = failing(
                decreasing_steps(features, temporal, key), "n_decreasing > 0"
            )
        if temporal and entity != "target_disease":
            problems[f"{entity}: several values in one year"] = failing(
                varying_groups(features, temporal, [*key, "year"]), "n_varying > 0"
            )
    broken = {what: which for what, which in problems.items() if which}
    if broken:
        raise QualityError(str(broken))
    return features


def validate_cohort(cohort: DataFrame) -> DataFrame:
    """The checks that make sense for one row per pair, with the transition as its year."""
    names = [f.feature for f in feature_info(cohort.columns)]
    validate_features(
        cohort.withColumnRenamed("transition_year", "year").select(*FEATURE_KEY, *names),
        has_timeseries=False,
    )
    return cohort
