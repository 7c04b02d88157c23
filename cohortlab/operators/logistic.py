"""Penalised logistic regression by Newton steps, many models in one scan per step.

A model is a set of folds it must not see and a penalty. Tasks add up, per model, the gradient and
the matrix of second derivatives over their rows; Spark adds those, and the driver solves one small
system per model. All penalties, inner folds and outer folds step together, so the number of jobs is
that of the steps of the slowest model and does not depend on how many models there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.frames import materialize
from cohortlab.operators.linear import total

#: Inverse penalties tried: ten steps from 1e-4 to 1e4 on a log scale.
INVERSE_PENALTIES = tuple(10 ** (-4 + 8 * i / 9) for i in range(10))
TOLERANCE = 1e-6
STEPS = 50


@dataclass(frozen=True)
class LogisticModel:
    """Probability of the positive class; missing features count as 0 before they are standardised."""

    coefficients: dict[str, float]
    intercept: float
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    inverse_penalty: float = 1.0

    @property
    def features(self) -> list[str]:
        return list(self.coefficients)

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, spec: dict) -> LogisticModel:
        return cls(**spec)

    def margin(self) -> Column:
        parts = [
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(self.means[c])) * F.lit(w / self.deviations[c])
            for c, w in self.coefficients.items()
        ]
        return F.lit(self.intercept) + total(parts)

    def score(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))


@dataclass(frozen=True)
class Task:
    """One model to fit: rows whose outer or inner fold is excluded are not seen; NULL folds always are."""

    name: tuple
    inverse_penalty: float
    without_outer: str | None = None
    without_inner: str | None = None
    standards: object = None


def standards(rows: DataFrame, features: Sequence[str], outer: str | None) -> dict[object, tuple[np.ndarray, np.ndarray]]:
    """Means and deviations of the features over all rows (key None) and without each outer fold. A
    constant feature has deviation 1."""
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    sums = [F.count(F.lit(1)).alias("_n")]
    for i, x in enumerate(values.values()):
        sums += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    key = F.lit(None).cast("string") if outer is None else F.col(outer).cast("string")
    found = {}
    for row in rows.groupBy(key.alias("_fold")).agg(*sums).collect():
        mean = np.array([row[f"m{i}"] for i in range(len(features))])
        spread = np.array([row[f"v{i}"] for i in range(len(features))])
        found[row["_fold"]] = (row["_n"], mean, spread)

    def pooled(parts):
        n = sum(p[0] for p in parts)
        mean = sum(p[0] * p[1] for p in parts) / n
        variance = sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts) / n
        # Rounding leaves a trace of variance in a constant feature.
        constant = variance <= 1e-14 * np.maximum(1.0, mean**2)
        return mean, np.where(constant, 1.0, np.sqrt(variance))

    result = {None: pooled(list(found.values()))}
    if outer is not None:
        for fold in [f for f in found if f is not None]:
            rest = [p for f, p in found.items() if f != fold]
            if rest:
                result[fold] = pooled(rest)
    return result


def _margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x]) @ weights


def prepared(rows: DataFrame, features: Sequence[str], label: str, outer: str | None, inner: str | None) -> DataFrame:
    fold = lambda c: (F.lit(None) if c is None else F.col(c)).cast("string")
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    return rows.where(F.col(label).isNotNull()).select(
        fold(outer).alias("_outer"), fold(inner).alias("_inner"), F.col(label).cast("double").alias("_y"), *values
    )


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    outer, inner = (np.array(batch.column(c).to_pylist(), object) for c in ("_outer", "_inner"))
    y = batch.column("_y").to_numpy(zero_copy_only=False)
    width = batch.num_columns - 3
    columns = [batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(width)]
    x = np.stack(columns, axis=1) if width else np.zeros((len(y), 0))
    return outer, inner, y, x


def _seen(task: Task, outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    keep = np.ones(len(outer), bool)
    if task.without_outer is not None:
        keep &= outer != task.without_outer
    if task.without_inner is not None:
        keep &= inner != task.without_inner
    return keep


def _derivatives(rows: DataFrame, tasks: Sequence[Task], weights: Mapping[tuple, np.ndarray],
                 scales: Mapping[object, tuple[np.ndarray, np.ndarray]]) -> dict[tuple, np.ndarray]:
    """Per task: loss, gradient and second derivatives at its weights, as one vector, in one job."""
    order = [t.name for t in tasks]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            outer, inner, y, raw = _arrays(batch)
            scaled = {key: (raw - mean) / spread for key, (mean, spread) in scales.items()}
            for i, task in enumerate(tasks):
                keep = _seen(task, outer, inner)
                x = np.hstack([np.ones((int(keep.sum()), 1)), scaled[task.standards][keep]])
                truth, z = y[keep], x @ weights[task.name]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                loss = np.logaddexp(0, z).sum() - (truth * z).sum()
                gradient = x.T @ (p - truth)
                second = (x * (p * (1 - p))[:, None]).T @ x
                own = np.concatenate([[loss], gradient, second.ravel()])
                sums[i] = sums.get(i, 0) + own
        for i, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tolist()], pa.list_(pa.float64()))], ["task", "v"])

    def merge(table: pa.Table) -> pa.Table:
        summed = np.sum([np.array(v) for v in table.column("v").to_pylist()], axis=0)
        return pa.table({"task": table.column("task").slice(0, 1), "v": pa.array([summed.tolist()], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(add, "task int, v array<double>")
    merged = parts.groupBy("task").applyInArrow(merge, "task int, v array<double>")
    return {order[r["task"]]: np.array(r["v"]) for r in merged.collect()}


def fit_tasks(rows: DataFrame, features: Sequence[str], tasks: Sequence[Task],
              scales: Mapping[object, tuple[np.ndarray, np.ndarray]]) -> dict[tuple, np.ndarray]:
    """Weights (intercept first, not penalised) of every task. ``rows`` comes from ``prepared`` and
    should be a written table. The objective is the summed loss plus |w|^2 / (2 C); a step that does not
    lower it is halved, and a model whose gradient is small takes no further part."""
    width = len(features) + 1
    weights = {t.name: np.zeros(width) for t in tasks}
    step = {t.name: np.zeros(width) for t in tasks}
    best: dict[tuple, float] = {}
    active = list(tasks)
    for _ in range(STEPS):
        found = _derivatives(rows, active, {t.name: weights[t.name] + step[t.name] for t in active}, scales)
        remaining = []
        for task in active:
            flat = found.get(task.name)
            if flat is None:
                raise ValueError(f"{task.name}: no training rows")
            trial = weights[task.name] + step[task.name]
            penalty = np.full(width, 1 / task.inverse_penalty)
            penalty[0] = 0.0
            value = flat[0] + 0.5 * float(penalty @ trial**2)
            if task.name in best and value > best[task.name] + 1e-12 * abs(best[task.name]):
                step[task.name] = step[task.name] / 2
                if np.abs(step[task.name]).max() > 1e-12:
                    remaining.append(task)
                continue
            weights[task.name], best[task.name] = trial, value
            gradient = flat[1 : 1 + width] + penalty * trial
            second = flat[1 + width :].reshape(width, width) + np.diag(penalty)
            # A gradient is small against what the penalty and one row can move.
            if np.abs(gradient).max() <= TOLERANCE:
                continue
            step[task.name] = -np.linalg.lstsq(second, gradient, rcond=None)[0]
            remaining.append(task)
        active = remaining
        if not active:
            break
    return weights


def _accuracy(rows: DataFrame, tasks: Sequence[Task], weights: Mapping[tuple, np.ndarray],
              scales: Mapping[object, tuple[np.ndarray, np.ndarray]]) -> dict[tuple, tuple[int, int]]:
    """Per task: rows of its inner fold that it did not see, and how many it gets right, in one job."""
    order = [t.name for t in tasks]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(tasks), 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            outer, inner, y, raw = _arrays(batch)
            scaled = {key: (raw - mean) / spread for key, (mean, spread) in scales.items()}
            for i, task in enumerate(tasks):
                own = inner == task.without_inner
                if task.without_outer is not None:
                    own &= outer != task.without_outer
                z = _margins(scaled[task.standards][own], weights[task.name])
                sums[i] += (int(own.sum()), int(((z > 0) == (y[own] > 0.5)).sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(tasks)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["task", "n", "hits"]
        )

    counted = rows.mapInArrow(count, "task int, n bigint, hits bigint").groupBy("task").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits")
    )
    return {order[r["task"]]: (r["n"], r["hits"]) for r in counted.collect()}


def penalty_search(rows: DataFrame, features: Sequence[str], label: str, inner: str, outer: str | None = None,
                   inverse_penalties: Sequence[float] = INVERSE_PENALTIES) -> dict[object, LogisticModel]:
    """The model of all rows (key None) and, with ``outer``, one per outer fold that has not seen it.

    The penalty of each is the one with the best accuracy, averaged over the inner folds it can see;
    of equal ones, the strongest. Features are standardised over what a model of the outer folds may
    see. All models, inner folds and penalties are fitted together.
    """
    table = materialize(prepared(rows, features, label, outer, inner))
    scales = standards(table.withColumnsRenamed({f"x{i}": c for i, c in enumerate(features)}), features, "_outer" if outer else None)
    folds = sorted(r[0] for r in table.select("_inner").where("_inner IS NOT NULL").distinct().collect())
    outers = [None, *sorted(k for k in scales if k is not None)] if outer else [None]
    tasks = [
        Task((o, f, c), c, o, f, o) for o in outers for f in (*folds, None) for c in inverse_penalties
    ]
    weights = fit_tasks(table, features, tasks, scales)
    accuracy = _accuracy(table, [t for t in tasks if t.without_inner is not None], weights, scales)
    models = {}
    for o in outers:
        def mean_accuracy(c: float, o: str | None = o) -> float:
            shares = [accuracy[(o, f, c)] for f in folds]
            return float(np.mean([hits / n for n, hits in shares if n] or [0.0]))

        chosen = max(sorted(inverse_penalties), key=lambda c: (round(mean_accuracy(c), 12), -c))
        fitted, (mean, spread) = weights[(o, None, chosen)], scales[o]
        models[o] = LogisticModel(
            dict(zip(features, fitted[1:].tolist())), float(fitted[0]), dict(zip(features, mean.tolist())),
            dict(zip(features, spread.tolist())), chosen,
        )
    return models
