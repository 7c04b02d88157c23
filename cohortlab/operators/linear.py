"""Linear scoring: ridge regression, the source-weighted composite, imputation and scaling.

Fitting needs only sums. Tasks turn their rows into a small moment matrix, Spark adds those up, and
the driver solves a system as large as the number of features. Scoring is one column expression.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.expressions import clip
from cohortlab.functions.naming import features_of_kind

RIDGE_ALPHA = 1e-6

# Evidence types the composite accepts and source weights other than 1.
COMPOSITE_TYPES = (
    "affected_pathway",
    "animal_model",
    "genetic_association",
    "known_drug",
    "literature",
    "rna_expression",
    "somatic_mutation",
)
COMPOSITE_WEIGHTS = {
    "europepmc": 0.2,
    "expression_atlas": 0.2,
    "impc": 0.2,
    "progeny": 0.5,
    "slapenrich": 0.5,
    "cancer_biomarkers": 0.5,
    "sysbio": 0.5,
}


def composite_weights(features: Sequence[str]) -> dict[str, float]:
    weights = {}
    for name in features:
        parts = name.split("__")
        if len(parts) != 3 or parts[1] not in COMPOSITE_TYPES:
            raise ValueError(f"no source weight for {name!r}")
        weights[name] = COMPOSITE_WEIGHTS.get(parts[2], 1.0)
    return weights


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def weighted_composite(features: Sequence[str]) -> Column:
    """Mean over the features of weight times score, a missing score counting as 0."""
    parts = [F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in composite_weights(features).items()]
    return total(parts) / len(parts)


def imputation_means(rows: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Fill values for a batch: static target features take the mean over targets, others 0."""
    static = features_of_kind(list(features), "static", "target")
    fills = dict.fromkeys(features, 0.0)
    if static:
        per_target = rows.groupBy("target_id").agg(*[F.max(c).alias(c) for c in static])
        means = per_target.agg(*[F.avg(c).alias(c) for c in static]).first().asDict()
        fills.update({c: 0.0 if m is None else float(m) for c, m in means.items()})
    return fills


def impute(rows: DataFrame, features: Sequence[str], fills: Mapping[str, float] | None = None) -> DataFrame:
    """Fill missing features. By default the fill values come from the batch itself, also when
    scoring; pass the ones of the training data to freeze them."""
    fills = imputation_means(rows, features) if fills is None else fills
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) for c in features})


def feature_ranges(rows: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    found = rows.agg(
        *[F.min(c).cast("double").alias(f"{c}__lo") for c in features],
        *[F.max(c).cast("double").alias(f"{c}__hi") for c in features],
    ).first()
    return {c: (found[f"{c}__lo"] or 0.0, found[f"{c}__hi"] or 0.0) for c in features}


def scaled(column: Column, low: float, high: float) -> Column:
    """To [0, 1] by the fitted range, clipped beyond it; a constant feature is only shifted."""
    return clip((column.cast("double") - F.lit(low)) / F.lit((high - low) or 1.0), 0, 1)


def scale(rows: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: scaled(F.col(c), *r) for c, r in ranges.items()})


@dataclass(frozen=True)
class LinearModel:
    """A fitted linear score, clipped to [0, 1].

    ``coefficients`` covers the features used for scoring, which may be fewer than those the model
    was fitted on. A non-negative model leaves its intercept out when scoring.
    """

    slug: str
    coefficients: dict[str, float]
    intercept: float = 0.0
    positive: bool = True
    ranges: dict[str, tuple[float, float]] | None = None
    imputes: bool = False
    fitted_on: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return list(self.coefficients)

    def fills(self, rows: DataFrame) -> dict[str, float]:
        return imputation_means(rows, self.features) if self.imputes else dict.fromkeys(self.features, 0.0)

    def inputs(self, fills: Mapping[str, float]) -> dict[str, Column]:
        prepared = {c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) for c in self.features}
        if self.ranges is None:
            return prepared
        return {c: scaled(x, *self.ranges[c]) for c, x in prepared.items()}

    def contributions(self, fills: Mapping[str, float]) -> dict[str, Column]:
        return {c: x * F.lit(self.coefficients[c]) for c, x in self.inputs(fills).items()}

    def score(self, fills: Mapping[str, float]) -> Column:
        base = 0.0 if self.positive else self.intercept
        return clip(F.lit(base) + total(list(self.contributions(fills).values())), 0, 1)

    def predict(self, rows: DataFrame, name: str | None = None,
                fills: Mapping[str, float] | None = None) -> DataFrame:
        return rows.withColumn(name or self.slug, self.score(self.fills(rows) if fills is None else fills))

    def to_json(self) -> dict:
        return json.loads(json.dumps(asdict(self)))

    @classmethod
    def from_json(cls, spec: dict) -> LinearModel:
        ranges = spec["ranges"] and {c: tuple(r) for c, r in spec["ranges"].items()}
        return cls(**{**spec, "ranges": ranges})


def moments(rows: DataFrame, features: Sequence[str], label: str,
            by: str | None = None) -> dict[object, np.ndarray]:
    """Per group, the matrix of sums of products of (1, features, label).

    Every task multiplies its Arrow batches into one small matrix per group; Spark sums the
    entries. What reaches the driver has (features + 2)^2 numbers per group.
    """
    columns = [F.col(c).cast("double").alias(c) for c in [*features, label]]
    group = F.lit(0).alias("_group") if by is None else F.col(by).alias("_group")
    selected = rows.select(group, *columns)
    kind = selected.schema["_group"].dataType.simpleString()
    width = len(columns) + 1

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby("_group"):
                values = part.drop(columns="_group").to_numpy(float)
                block = np.hstack([np.ones((len(values), 1)), values])
                sums[key] = sums.get(key, 0) + block.T @ block
        for key, matrix in sums.items():
            yield pd.DataFrame({"_group": key, "i": np.arange(width**2), "v": matrix.ravel()})

    entries = selected.mapInPandas(multiply, f"_group {kind}, i int, v double")
    found: dict[object, np.ndarray] = {}
    for row in entries.groupBy("_group", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault(row["_group"], np.zeros(width**2))[row["i"]] = row["v"]
    return {key: flat.reshape(width, width) for key, flat in found.items()}


def solve_ridge(matrix: np.ndarray, alpha: float = RIDGE_ALPHA,
                positive: bool = False) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from a moment matrix; the intercept is not penalised."""
    n, means = matrix[0, 0], matrix[0, 1:] / matrix[0, 0]
    centred = matrix[1:, 1:] - n * np.outer(means, means)
    gram, cross = centred[:-1, :-1] + alpha * np.eye(len(centred) - 1), centred[:-1, -1]
    weights = _nonnegative_solution(gram, cross) if positive else np.linalg.solve(gram, cross)
    return weights, float(means[-1] - means[:-1] @ weights)


def _nonnegative_solution(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Minimise w'Gw/2 - c'w over w >= 0 by the active-set method."""
    size = len(cross)
    weights, free = np.zeros(size), np.zeros(size, bool)
    tolerance = 1e-12 * max(1.0, np.abs(cross).max(initial=0.0))
    for _ in range(10 * size + 10):
        gradient = cross - gram @ weights
        if free.all() or gradient[~free].max() <= tolerance:
            break
        free[np.flatnonzero(~free)[gradient[~free].argmax()]] = True
        while True:
            trial = np.zeros(size)
            trial[free] = np.linalg.solve(gram[np.ix_(free, free)], cross[free])
            if trial[free].min(initial=0.0) >= 0:
                break
            falling = free & (trial < 0)
            step = (weights[falling] / (weights[falling] - trial[falling])).min()
            weights = weights + step * (trial - weights)
            free &= weights > tolerance * 1e-3
            weights[~free] = 0.0
        weights = trial
    return weights


@dataclass(frozen=True)
class GroupStatistics:
    """What ridge models of any union of groups need, from one pass over raw rows and one over
    entities: products of (1, features with 0 for missing, missing flags, label), extremes, and the
    maxima of static target features averaged over targets."""

    features: list[str]
    products: dict[object, np.ndarray]
    extremes: dict[object, dict[str, float | None]]
    fills: dict[str, dict[str, float]]

    def fit(self, name: str, groups: Sequence[object], members: Mapping[str, tuple[bool, Sequence[str] | None]],
            alpha: float = RIDGE_ALPHA) -> dict[str, LinearModel]:
        """Models of one named union of groups, as if fitted on its filled and scaled rows."""
        size, fills = len(self.features), self.fills[name]
        used = [g for g in groups if g in self.products]
        raw = sum((self.products[g] for g in used), np.zeros((2 * size + 2, 2 * size + 2)))
        if not raw[0, 0]:
            raise ValueError(f"{name}: no training rows")
        ranges = {}
        for i, c in enumerate(self.features):
            seen = [self.extremes[g][f"{c}__{end}"] for g in used for end in ("lo", "hi")]
            if raw[0, 1 + size + i] > 0:
                seen.append(fills[c])
            known = [v for v in seen if v is not None]
            ranges[c] = (min(known, default=0.0), max(known, default=0.0))
        # Scaling is affine on the training rows, so it acts on the products.
        turn = np.zeros((2 * size + 2, size + 2))
        turn[0, 0] = turn[-1, -1] = 1.0
        for i, c in enumerate(self.features):
            low, width = ranges[c][0], (ranges[c][1] - ranges[c][0]) or 1.0
            turn[0, 1 + i], turn[1 + i, 1 + i], turn[1 + size + i, 1 + i] = -low / width, 1 / width, fills[c] / width
        return ridge_models(turn.T @ raw @ turn, self.features, members, alpha, ranges, True)


def group_statistics(rows: DataFrame, by: str, features: Sequence[str], label: str,
                     unions: Mapping[str, Sequence[object]]) -> GroupStatistics:
    """``unions`` names sets of groups whose fill values are wanted, for training or for scoring."""
    names = list(features)
    flags = [F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in names]
    known = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]
    products = moments(rows.select(by, *known, *flags, label), [*names, *[f"{c}__missing" for c in names]], label, by)
    found = rows.groupBy(by).agg(
        *[F.min(F.col(c).cast("double")).alias(f"{c}__lo") for c in names],
        *[F.max(F.col(c).cast("double")).alias(f"{c}__hi") for c in names],
    )
    extremes = {row[by]: row.asDict() for row in found.collect()}
    return GroupStatistics(names, products, extremes, union_fills(rows, by, names, unions))


def union_fills(rows: DataFrame, by: str, features: Sequence[str],
                unions: Mapping[str, Sequence[object]]) -> dict[str, dict[str, float]]:
    """``imputation_means`` of several unions of groups at once."""
    fills = {name: dict.fromkeys(features, 0.0) for name in unions}
    static = features_of_kind(list(features), "static", "target")
    if not static:
        return fills
    per_target = rows.groupBy("target_id", by).agg(*[F.max(c).alias(c) for c in static])
    inside = {name: F.col(by).isin(list(groups)) for name, groups in unions.items()}
    wide = per_target.groupBy("target_id").agg(
        *[F.max(F.when(own, F.col(c))).alias(f"{k}__{j}") for k, own in enumerate(inside.values()) for j, c in enumerate(static)]
    )
    means = wide.agg(*[F.avg(c).alias(c) for c in wide.columns if c != "target_id"]).first().asDict()
    for k, name in enumerate(inside):
        fills[name].update({c: float(means[f"{k}__{j}"] or 0.0) for j, c in enumerate(static)})
    return fills


def grouped_score(by: Column, models: Mapping[object, LinearModel], fills: Mapping[object, Mapping[str, float]]) -> Column:
    """Score of each row by the model of its group, as one expression over literal maps."""
    first = next(iter(models.values()))
    names = list(models)

    def number(value) -> Column:
        return F.create_map(*[x for g in names for x in (F.lit(g), F.lit(float(value(g))))])[by]

    parts = []
    for c in first.features:
        low = {g: models[g].ranges[c][0] if models[g].ranges else 0.0 for g in names}
        width = {g: (models[g].ranges[c][1] - low[g]) or 1.0 if models[g].ranges else 1.0 for g in names}
        x = F.coalesce(F.col(c).cast("double"), number(lambda g, c=c: fills[g][c]))
        x = (x - number(low.get)) / number(width.get)
        x = clip(x, 0, 1) if first.ranges is not None else x
        parts.append(x * number(lambda g, c=c: models[g].coefficients[c]))
    base = F.lit(0.0) if first.positive else number(lambda g: models[g].intercept)
    return clip(base + total(parts), 0, 1)


def fit_ridge(rows: DataFrame, features: Sequence[str], label: str, slug: str = "ridge",
              positive: bool = False, scoring_features: Sequence[str] | None = None,
              alpha: float = RIDGE_ALPHA, scaling: bool = True, imputing: bool = True) -> LinearModel:
    """Fit on all ``features``; score with ``scoring_features`` only, if given."""
    return fit_ridge_family(
        rows, features, label, {slug: (positive, scoring_features)}, alpha, scaling, imputing
    )[slug]


def fit_ridge_family(rows: DataFrame, features: Sequence[str], label: str,
                     members: Mapping[str, tuple[bool, Sequence[str] | None]],
                     alpha: float = RIDGE_ALPHA, scaling: bool = True,
                     imputing: bool = True) -> dict[str, LinearModel]:
    """Several ridge models that share their training features, from one pass over the rows."""
    prepared, ranges = prepare_training(rows, features, scaling, imputing)
    matrix = moments(prepared, features, label)[0]
    return ridge_models(matrix, features, members, alpha, ranges, imputing)


def prepare_training(rows: DataFrame, features: Sequence[str], scaling: bool,
                     imputing: bool) -> tuple[DataFrame, dict[str, tuple[float, float]] | None]:
    prepared = impute(rows, features) if imputing else rows
    if not scaling:
        return prepared, None
    ranges = feature_ranges(prepared, features)
    return scale(prepared, ranges), ranges


def ridge_models(matrix: np.ndarray, features: Sequence[str],
                 members: Mapping[str, tuple[bool, Sequence[str] | None]], alpha: float,
                 ranges: dict[str, tuple[float, float]] | None, imputing: bool) -> dict[str, LinearModel]:
    solved = {p: solve_ridge(matrix, alpha, p) for p in {positive for positive, _ in members.values()}}
    models = {}
    for slug, (positive, scoring) in members.items():
        unknown = set(scoring or ()) - set(features)
        if unknown:
            raise ValueError(f"not among the training features: {sorted(unknown)}")
        weights, intercept = solved[positive]
        by_name = dict(zip(features, weights.tolist()))
        models[slug] = LinearModel(
            slug, {c: by_name[c] for c in scoring or features}, intercept, positive, ranges, imputing,
            list(features),
        )
    return models
