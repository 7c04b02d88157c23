"""Per-row and overall contributions of features to linear scores and boosted trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.boosting import BoostedModel, Tree
from cohortlab.operators.linear import LinearModel, union_fills
from cohortlab.operators.ordering import exact_quantiles, unpivot

# Evidence-type labels, first match wins.
EVIDENCE_TYPES = (
    ("__genetic_association__", "3. human genetic"),
    ("__somatic_mutation__", "3. human genetic"),
    ("__literature__", "4. literature"),
    ("__clinical__", "1. human clinical"),
    ("__animal_model__", "2. animal model"),
)


def linear_contributions(rows: DataFrame, model: LinearModel, keep: Sequence[str],
                         fills: Mapping[str, float] | None = None) -> DataFrame:
    """Rows (keep…, feature, contribution): prepared value times coefficient."""
    parts = model.contributions(model.fills(rows) if fills is None else fills)
    wide = rows.select(*keep, *[column.alias(name) for name, column in parts.items()])
    return unpivot(wide, list(keep), list(parts), "feature", "contribution")


def linear_shap(rows: DataFrame, model: LinearModel, keep: Sequence[str],
                all_features: Sequence[str] | None = None,
                background: DataFrame | None = None) -> DataFrame:
    """Rows (keep…, base_value, feature, shap_value) with independent features as background.

    The value is coefficient × (x − mean over the whole background). Features the model does not
    use are NULL.
    """
    background = rows if background is None else background
    inputs = model.inputs(model.fills(rows))
    means = background.select(
        *[c.alias(n) for n, c in model.inputs(model.fills(background)).items()]
    ).agg(*[F.avg(n).alias(n) for n in inputs]).first().asDict()
    base = model.intercept + sum(model.coefficients[c] * means[c] for c in inputs)

    def value(name: str) -> Column:
        if name not in inputs:
            return F.lit(None).cast("double").alias(name)
        return (F.lit(model.coefficients[name]) * (inputs[name] - F.lit(means[name]))).alias(name)

    names = list(all_features or model.features)
    wide = rows.select(*keep, F.lit(base).alias("base_value"), *[value(n) for n in names])
    return unpivot(wide, [*keep, "base_value"], names, "feature", "shap_value")


@dataclass(frozen=True)
class Leaf:
    """A leaf's path by feature: a row meets feature i's part if its bin is in ``(low, high]``. ``shares``
    holds the Shapley values of the path's features for every combination of parts met."""

    features: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]
    shares: np.ndarray


def _leaf_shares(value: float, ratios: np.ndarray) -> np.ndarray:
    """Shapley values of the game in which a known feature contributes 1 or 0, as its part is met or not,
    and an unknown one the share of training rows that meet it; a leaf multiplies these."""
    k = len(ratios)
    met = (np.arange(2**k)[:, None] >> np.arange(k)) & 1
    shares = np.zeros((2**k, k))
    for i in range(k):
        others = [j for j in range(k) if j != i]
        known = ((np.arange(2 ** (k - 1))[:, None] >> np.arange(k - 1)) & 1).astype(bool)
        weights = np.array([factorial(n) * factorial(k - n - 1) / factorial(k) for n in known.sum(axis=1)])
        parts = np.where(known[None], met[:, None, others], ratios[others])
        shares[:, i] = value * (met[:, i] - ratios[i]) * (parts.prod(axis=2) @ weights)
    return shares


def _leaves(tree: Tree) -> tuple[list[Leaf], float]:
    """Leaves of a tree with at least one split above them, and the tree's mean over its training rows."""
    leaves, mean = [], 0.0
    pending = [(0, {})]
    while pending:
        node, path = pending.pop()
        feature = int(tree.feature[node])
        if feature >= 0:
            for child in (2 * node + 1, 2 * node + 2):
                low, high, ratio = path.get(feature, (-1, 1 << 30, 1.0))
                part = (low, min(high, int(tree.cut[node]))) if child % 2 else (max(low, int(tree.cut[node])), high)
                pending.append((child, {**path, feature: (*part, ratio * tree.cover[child] / tree.cover[node])}))
            continue
        value = float(tree.value[node])
        mean += value * (tree.cover[node] / tree.cover[0] if tree.cover[0] else 1.0)
        if path:
            low, high, ratios = zip(*path.values())
            leaves.append(Leaf(tuple(path), low, high, _leaf_shares(value, np.array(ratios))))
    return leaves, mean


@dataclass(frozen=True)
class TreeExplainer:
    """Path-dependent Shapley values of a boosted model's margin. Tables are made once per model; a
    batch of rows then costs one comparison per feature of a leaf and one look-up."""

    model: BoostedModel
    leaves: list[Leaf]
    base: float

    @classmethod
    def of(cls, model: BoostedModel) -> TreeExplainer:
        leaves, base = [], model.base
        for tree in model.trees:
            own, mean = _leaves(tree)
            leaves += own
            base += mean
        return cls(model, leaves, base)

    def values(self, bins: np.ndarray) -> np.ndarray:
        result = np.zeros((len(bins), len(self.model.features)))
        for leaf in self.leaves:
            pattern = np.zeros(len(bins), np.int64)
            for i, (f, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
                pattern |= ((bins[:, f] > low) & (bins[:, f] <= high)).astype(np.int64) << i
            result[:, list(leaf.features)] += leaf.shares[pattern]
        return result


def _held_out_by(fold: str, names: Sequence[str]) -> Column:
    """The fold whose model explains a row: its own, or the first one where it has none."""
    own = F.col(fold).cast("string")
    return F.when(own.isin(list(names)), own).otherwise(F.lit(names[0]))


def tree_shap(rows: DataFrame, fold: str | None, models: Mapping[str, BoostedModel], keep: Sequence[str],
              all_features: Sequence[str] | None = None) -> DataFrame:
    """Rows (keep…, base_value, feature, shap_value) of the margin of boosted models, in one Arrow pass.

    Values depend on the tree paths: an unknown feature goes both ways in the shares of training
    rows. They add up to the margin of the row. A feature that the model does not know is NULL.
    """
    names = sorted(models)
    explainers = {name: TreeExplainer.of(models[name]) for name in names}
    features = models[names[0]].features

    @F.pandas_udf("array<double>")
    def shares(group: pd.Series, *columns: pd.Series) -> pd.Series:
        values = np.stack([c.to_numpy(float) for c in columns], axis=1)
        result = np.zeros((len(group), len(features) + 1))
        for name, explainer in explainers.items():
            own = (group == name).to_numpy()
            if own.any():
                result[own, 0] = explainer.base
                result[own, 1:] = explainer.values(explainer.model.binned(values[own]))
        return pd.Series(list(result))

    group = F.lit(names[0]) if fold is None else _held_out_by(fold, names)
    explained = rows.withColumn("_shares", shares(group, *models[names[0]].inputs()))
    place = {c: i + 1 for i, c in enumerate(features)}
    wanted = list(all_features or features)
    values = [F.get("_shares", F.lit(place[c])).alias(c) if c in place else F.lit(None).cast("double").alias(c) for c in wanted]
    wide = explained.select(*keep, F.get("_shares", F.lit(0)).alias("base_value"), *values)
    return unpivot(wide, [*keep, "base_value"], wanted, "feature", "shap_value")


def explain_held_out(rows: DataFrame, fold: str, models: Mapping[str, LinearModel | BoostedModel],
                     keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Shapley values of each row under the model of the fold in which it was held out.

    Rows under a label without a model, such as unlabelled ones, use the first fold's model. Linear
    models take the rows they explain as background; one aggregate by fold gives all their means.
    """
    models = {str(name): model for name, model in models.items()}
    names = sorted(models)
    if isinstance(models[names[0]], BoostedModel):
        return tree_shap(rows, fold, models, [*keep, fold], features)
    held = rows.withColumn("_held", _held_out_by(fold, names))
    used = sorted({c for m in models.values() for c in m.features}, key=list(features).index)
    fills = {n: dict.fromkeys(used, 0.0) for n in names}
    imputing = [n for n in names if models[n].imputes]
    if imputing:
        fills |= union_fills(held, "_held", used, {n: [n] for n in imputing})

    def by_model(value) -> Column:
        result = F.lit(None).cast("double")
        for name in names:
            result = F.when(F.col("_held") == name, value(name)).otherwise(result)
        return result

    prepared = {n: models[n].inputs(fills[n]) for n in names}
    inputs = held.select(*keep, fold, "_held", *[by_model(lambda n, c=c: prepared[n].get(c, F.lit(None))).alias(c) for c in used])
    averages = inputs.groupBy("_held").agg(*[F.avg(c).alias(c) for c in used]).collect()
    means = {r["_held"]: r.asDict() for r in averages}
    names = [n for n in names if n in means]

    def base(name: str) -> Column:
        return F.lit(models[name].intercept + sum(w * means[name][c] for c, w in models[name].coefficients.items()))

    def share(name: str, c: str) -> Column:
        weight = models[name].coefficients.get(c)
        return F.lit(None) if weight is None else F.lit(weight) * (F.col(c) - F.lit(means[name][c]))

    values = [
        by_model(lambda n, c=c: share(n, c)).alias(c) if c in used else F.lit(None).cast("double").alias(c) for c in features
    ]
    wide = inputs.select(*keep, fold, by_model(base).alias("base_value"), *values)
    return unpivot(wide, [*keep, fold, "base_value"], list(features), "feature", "shap_value")


def evidence_type(feature: Column) -> Column:
    label = F.when(feature.startswith("target__"), "5. target properties").otherwise("6. other")
    for marker, name in reversed(EVIDENCE_TYPES):
        label = F.when(feature.contains(marker), F.lit(name)).otherwise(label)
    return label


def effect_summary(rows: DataFrame, model: LinearModel, keep: Sequence[str]) -> DataFrame:
    """Positive contributions per feature: min, max, mean, median, next to the coefficient.

    Features without any positive contribution are left out.
    """
    positive = linear_contributions(rows, model, keep).filter(F.col("contribution") > 0)
    summary = positive.groupBy("feature").agg(
        F.min("contribution").alias("min"),
        F.max("contribution").alias("max"),
        F.avg("contribution").alias("mean"),
    )
    median = exact_quantiles(positive, ["feature"], "contribution", [0.5]).select(
        "feature", F.col("cutoff").alias("median")
    )
    coefficient = F.create_map(*[F.lit(x) for pair in model.coefficients.items() for x in pair])
    return (
        summary.join(median, "feature")
        .withColumn("coefficient", coefficient[F.col("feature")])
        .withColumn("evidence_type", evidence_type(F.col("feature")))
    )
