"""The model grid: fit every specification on a cohort and score rows with all of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.expressions import hash_unit
from cohortlab.functions.frames import materialize
from cohortlab.functions.naming import PAIR_KEY
from cohortlab.operators.boosting import BoostedModel, Boosting, Member, grouped_probability, grow
from cohortlab.operators.folds import stratified_kfold
from cohortlab.operators.linear import (
    RIDGE_ALPHA,
    LinearModel,
    fit_ridge_family,
    group_statistics,
    grouped_score,
    union_fills,
    weighted_composite,
)
from cohortlab.operators.logistic import INVERSE_PENALTIES, LogisticModel, penalty_search
from cohortlab.operators.ordering import unpivot

INNER_FOLDS = 5
RANDOM_BASELINES = 3


OWN_CLINICAL = "/target_disease__clinical__"
#: Parts of a feature's name that bar it from a set, and the part it needs.
FEATURE_SETS = {
    "all": ((), ""),
    "no_time": (("__time__",), ""),
    "no_tgc": (("__time__", "__genetic_association__", "__clinical__"), ""),
    "only_genetics": ((), "__genetic_association__"),
}


@dataclass(frozen=True)
class ModelSpec:
    """``algorithm`` is rdg, gbm, lrg, ots or baseline; ``features`` are those used for scoring."""

    slug: str
    algorithm: str
    features: list[str]
    positive: bool = False
    seed: int | None = None
    properties: dict = field(default_factory=dict)


def feature_sets(features: Sequence[str]) -> dict[str, list[str]]:
    """Features by set: those whose name matches none of the set's barred parts and, if the set names
    one, its needed part. A pair's own clinical features are in no set."""
    def holds(name: str, barred: Sequence[str], needed: str) -> bool:
        return needed in name and not any(part in name for part in (OWN_CLINICAL, *barred))

    return {
        chosen: [f for f in features if holds(f"/{f}", barred, needed)]
        for chosen, (barred, needed) in FEATURE_SETS.items()
    }


def model_grid(features: Sequence[str], boosting: bool = True, logistic: bool = True) -> list[ModelSpec]:
    """Constraints × feature sets × algorithms, the composite and the baselines. Logistic regression is
    unconstrained only."""
    specs = []
    for constraint in ("positive", "unconstrained"):
        for name, chosen in feature_sets(features).items():
            suffix = f"{name}__{constraint}"
            specs.append(ModelSpec(f"rdg__{suffix}", "rdg", chosen, constraint == "positive"))
            if boosting:
                specs.append(ModelSpec(f"gbm__{suffix}", "gbm", chosen, constraint == "positive"))
            if constraint == "unconstrained" and logistic:
                specs.append(ModelSpec(f"lrg__{suffix}", "lrg", chosen))
    scored = [
        f for f in features
        if f.startswith("target_disease__") and "__clinical__" not in f and "__time__" not in f
    ]
    specs.append(ModelSpec("ots__all", "ots", scored))
    specs.append(ModelSpec("baseline__most_frequent", "baseline", []))
    specs += [
        ModelSpec(f"baseline__random_seed_{s}", "baseline", [], seed=s) for s in range(RANDOM_BASELINES)
    ]
    return specs


@dataclass(frozen=True)
class BaselineModel:
    """Majority class (no seed), or a random class drawn with the training share of positives.

    The draw is a hash of the row key, so a retried task draws the same.
    """

    prior: float
    seed: int | None = None
    key: tuple[str, ...] = tuple(PAIR_KEY)

    def score(self) -> Column:
        if self.seed is None:
            return F.lit(1.0 if self.prior > 0.5 else 0.0)
        draw = hash_unit(*[F.col(c) for c in self.key], seed=self.seed)
        return F.when(draw < self.prior, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class CompositeModel:
    features: list[str]

    def score(self) -> Column:
        return weighted_composite(self.features)


FittedModel = LinearModel | LogisticModel | BoostedModel | BaselineModel | CompositeModel


def class_prior(rows: DataFrame, label: str) -> float:
    return float(rows.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"])


def fit_boosting(rows: DataFrame, features: Sequence[str], label: str, positive: bool = False,
                 boosting: Boosting = Boosting()) -> BoostedModel:
    return grow(rows, label, [Member("m", tuple(features), positive)], how=boosting)["m"]


def with_inner_folds(rows: DataFrame, label: str, key: Sequence[str], name: str = "_inner") -> DataFrame:
    """Labelled rows with stratified folds for the choice of a penalty, as a written table."""
    labelled = rows.where(F.col(label).isNotNull())
    return materialize(stratified_kfold(labelled, INNER_FOLDS, label, list(key), name=name))


def fit_logistic(rows: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = PAIR_KEY,
                 inverse_penalties: Sequence[float] = INVERSE_PENALTIES) -> LogisticModel:
    """Penalty chosen by cross-validated accuracy over stratified folds of the row key."""
    folded = with_inner_folds(rows, label, key)
    return penalty_search(folded, features, label, "_inner", inverse_penalties=inverse_penalties)[None]


def fit_models(rows: DataFrame, specs: Sequence[ModelSpec], label: str, core: Sequence[str],
               boosting: Boosting = Boosting()) -> dict[str, FittedModel]:
    """Fit every specification. All ridge models share one pass, all boosted ones a pass per level;
    ``core`` are the training features of ridge. ``rows`` is read several times and should be a written table."""
    of = {a: [s for s in specs if s.algorithm == a] for a in ("rdg", "gbm", "lrg", "ots", "baseline")}
    fitted: dict[str, FittedModel] = {}
    if of["rdg"]:
        fitted.update(fit_ridge_family(rows, core, label, {s.slug: (s.positive, s.features) for s in of["rdg"]}))
    if of["gbm"]:
        members = [Member(s.slug, tuple(s.features), s.positive) for s in of["gbm"]]
        fitted.update(grow(rows, label, members, how=boosting))
    if of["lrg"]:
        folded = with_inner_folds(rows, label, PAIR_KEY)
        fitted.update({s.slug: penalty_search(folded, s.features, label, "_inner")[None] for s in of["lrg"]})
    if of["baseline"]:
        prior = class_prior(rows, label)
        fitted.update({s.slug: BaselineModel(prior, s.seed) for s in of["baseline"]})
    for spec in of["ots"]:
        weighted_composite(spec.features)
        fitted[spec.slug] = CompositeModel(spec.features)
    return {s.slug: fitted[s.slug] for s in specs}


def score_models(rows: DataFrame, models: Mapping[str, FittedModel]) -> DataFrame:
    """Add one probability column per model, all in one projection."""
    expressions: dict[str, Column] = {}
    fills: dict[frozenset, dict[str, float]] = {}
    for slug, model in models.items():
        if isinstance(model, LinearModel):
            wanted = frozenset(model.features)
            fills.setdefault(wanted, model.fills(rows))
            expressions[slug] = model.score(fills[wanted])
        else:
            expressions[slug] = model.score()
    return rows.withColumns(expressions)


def predict_long(rows: DataFrame, models: Mapping[str, FittedModel], keep: Sequence[str]) -> DataFrame:
    """Rows (keep…, model, prediction)."""
    scored = score_models(rows, models).select(*keep, *models)
    return unpivot(scored, list(keep), list(models), "model", "prediction")


@dataclass(frozen=True)
class FoldModels:
    """One model per fold, fitted without it; ``fills`` are the fill values of the fold's own rows."""

    models: dict[str, FittedModel]
    fills: dict[str, Mapping[str, float]] = field(default_factory=dict)

    def score(self, fold: Column) -> Column:
        """Score of each row by the model that has not seen its fold, NULL in any other fold."""
        kinds = {type(m) for m in self.models.values()}
        if kinds == {LinearModel}:
            return grouped_score(fold, self.models, self.fills)
        if kinds == {BoostedModel}:
            return grouped_probability(fold, self.models)
        score = F.lit(None).cast("double")
        for name, model in self.models.items():
            score = F.when(fold == name, model.score()).otherwise(score)
        return score


def fit_fold_models(rows: DataFrame, fold: str, specs: Sequence[ModelSpec], label: str, core: Sequence[str],
                    boosting: Boosting = Boosting()) -> dict[str, FoldModels]:
    """Fit every specification once per fold, on all rows of other folds, folds being a dimension of the
    statistics that each pass collects: the number of jobs does not depend on how many there are.
    ``rows`` should be a written table whose rows all have a fold (as text)."""
    names = sorted(r[0] for r in rows.select(fold).distinct().collect())
    labelled = rows.where(F.col(label).isNotNull())
    of = {a: [s for s in specs if s.algorithm == a] for a in ("rdg", "gbm", "lrg", "ots", "baseline")}
    fitted: dict[str, FoldModels] = {}
    if of["rdg"]:
        unions = {f"without {f}": [g for g in names if g != f] for f in names}
        found = group_statistics(labelled, fold, core, label, unions)
        fills = union_fills(rows, fold, core, {f: [f] for f in names})
        members = {s.slug: (s.positive, s.features) for s in of["rdg"]}
        by_fold = {f: found.fit(f"without {f}", unions[f"without {f}"], members) for f in names}
        for slug in members:
            fitted[slug] = FoldModels({f: by_fold[f][slug] for f in names}, fills)
    if of["gbm"]:
        members = [Member((s.slug, f), tuple(s.features), s.positive, f) for s in of["gbm"] for f in names]
        grown = grow(labelled, label, members, fold, boosting)
        fitted.update({s.slug: FoldModels({f: grown[(s.slug, f)] for f in names}) for s in of["gbm"]})
    if of["lrg"]:
        folded = with_inner_folds(labelled, label, PAIR_KEY)
        for spec in of["lrg"]:
            models = penalty_search(folded, spec.features, label, "_inner", fold)
            fitted[spec.slug] = FoldModels({f: models[f] for f in names})
    if of["baseline"]:
        counted = labelled.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p"))
        counts = {r[fold]: (r["n"], r["p"]) for r in counted.collect()}
        for spec in of["baseline"]:
            priors = {}
            for f in names:
                rest = [c for g, c in counts.items() if g != f]
                priors[f] = BaselineModel(sum(p for _, p in rest) / sum(n for n, _ in rest), spec.seed)
            fitted[spec.slug] = FoldModels(priors)
    for spec in of["ots"]:
        fitted[spec.slug] = FoldModels({f: CompositeModel(spec.features) for f in names})
    return {s.slug: fitted[s.slug] for s in specs}


ScoreFn = Callable[[DataFrame], DataFrame]


def run_cv(rows: DataFrame, fold: str, n_folds: int, specs: Sequence[ModelSpec], label: str, core: Sequence[str],
           score: ScoreFn, keep: Sequence[str], boosting: Boosting = Boosting()) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions of every fold, and their scores per (fold, model) from one job.

    Rows with any other fold label are neither trained on nor predicted. ``rows`` should be a
    written table.
    """
    numbered = rows.withColumn(fold, F.col(fold).cast("string")).where(F.col(fold).isin([str(i) for i in range(n_folds)]))
    models = fit_fold_models(numbered, fold, specs, label, core, boosting)
    held_out = numbered.withColumns({slug: m.score(F.col(fold)) for slug, m in models.items()})
    predictions = unpivot(held_out.select(*keep, fold, *models), [*keep, fold], list(models), "model", "prediction")
    predictions = materialize(predictions)
    return predictions, score(predictions)


def ridge_cv(rows: DataFrame, fold: str, features: Sequence[str], label: str, keep: Sequence[str],
             positive: bool = False, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """Held-out ridge predictions with one pass to fit all folds.

    A fold's model takes its fill values, ranges and moments from the other folds only. As with any
    fitted model, missing values of the rows to score are filled from those rows. ``rows`` should be
    a written table; rows without a fold get no prediction.
    """
    folds = [r[0] for r in rows.select(fold).where(F.col(fold).isNotNull()).distinct().collect()]
    unions = {f"without {f}": [g for g in folds if g != f] for f in folds} | {f"only {f}": [f] for f in folds}
    found = group_statistics(rows, fold, features, label, unions)
    models, fills = {}, {}
    for f in folds:
        models[f] = found.fit(f"without {f}", unions[f"without {f}"], {"m": (positive, None)}, alpha)["m"]
        fills[f] = found.fills[f"only {f}"]
    return rows.select(*keep, fold, grouped_score(F.col(fold), models, fills).alias("prediction"))
