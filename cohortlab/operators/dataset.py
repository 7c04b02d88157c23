"""A modelling dataset: rows plus the role each column plays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortlab.functions.naming import OUTCOME, PAIR_KEY


@dataclass(frozen=True)
class Dataset:
    rows: DataFrame
    key: list[str]
    features: list[str]
    outcomes: list[str]
    descriptors: list[str] = field(default_factory=list)
    outcome_type: str | None = None

    def roles(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "rows"}

    def with_rows(self, rows: DataFrame) -> Dataset:
        return Dataset(rows, **self.roles())


def create_dataset(df: DataFrame, key: Sequence[str], outcomes: Sequence[str],
                   descriptors: Sequence[str] = (), outcome_type: str | None = None) -> Dataset:
    """Assign roles: numeric columns without another role are features, the rest descriptors."""
    if not key or not outcomes:
        raise ValueError("a dataset needs a key and an outcome")
    taken = [*key, *outcomes, *descriptors]
    features = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in taken
    ]
    named = [c for c in df.columns if c in descriptors or c not in [*features, *outcomes, *key]]
    columns = [*key, *features, *outcomes, *named]
    repeated = sorted({c for c in columns if columns.count(c) > 1})
    if repeated:
        raise ValueError(f"columns with more than one role: {repeated}")
    if not features:
        raise ValueError("no feature columns")
    rows = df.select(
        *key, *[F.col(c).cast("double").alias(c) for c in features], *outcomes, *named
    )
    kind = outcome_type or checked_outcome_type(rows, list(outcomes))
    return Dataset(rows, list(key), features, list(outcomes), named, kind)


def create_modeling_dataset(cohort: DataFrame) -> Dataset:
    """Roles of a cohort: names outside the feature grammar describe, one outcome is expected."""
    found = [c for c in cohort.columns if "__outcome__" in c]
    if found != [OUTCOME]:
        raise ValueError(f"expected the outcome {OUTCOME}, found {found}")
    descriptors = [c for c in cohort.columns if "__" not in c and c not in PAIR_KEY]
    return create_dataset(cohort, PAIR_KEY, [OUTCOME], descriptors)


def outcome_type(rows: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """One row: the type of the outcome columns, NULL where it is not supported.

    At most two distinct whole values are binary (several such columns: multilabel when all values
    are 0 or 1), fractions are continuous. More than two whole values are classes, not supported.
    """
    def facts(c: str) -> list:
        value = F.col(c).cast("double")
        return [
            F.min(value).alias(f"{c}__lo"),
            F.max(value).alias(f"{c}__hi"),
            F.coalesce(F.max(value != F.floor(value)), F.lit(False)).alias(f"{c}__fraction"),
        ]

    extent = rows.agg(*[f for c in outcomes for f in facts(c)]).first().asDict()
    between = [
        F.coalesce(
            F.max(
                (F.col(c).cast("double") > F.lit(extent[f"{c}__lo"]))
                & (F.col(c).cast("double") < F.lit(extent[f"{c}__hi"]))
            ),
            F.lit(False),
        )
        for c in outcomes
    ]
    fraction = any(extent[f"{c}__fraction"] for c in outcomes)
    unit = all(extent[f"{c}__lo"] in (None, 0.0) or extent[f"{c}__lo"] == 1.0 for c in outcomes) and all(
        extent[f"{c}__hi"] in (None, 0.0, 1.0) for c in outcomes
    )
    many = len(outcomes) > 1
    if fraction:
        label = F.lit("regression:continuous" + ("-multioutput" if many else ""))
    elif many:
        more = F.greatest(*between)
        label = F.when(~more & F.lit(unit), "classification:multilabel-indicator")
    else:
        label = F.when(~between[0], "classification:binary")
    return rows.agg(label.alias("outcome_type"))


def checked_outcome_type(rows: DataFrame, outcomes: Sequence[str]) -> str:
    found = outcome_type(rows, outcomes).first()["outcome_type"]
    if found is None:
        raise ValueError(f"outcome type of {list(outcomes)} is not supported")
    return found
