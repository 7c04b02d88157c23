"""Gradient-boosted trees from histograms, with monotone constraints, many models in one scan per level.

Rows are cut into bins once and packed into blocks. Per level of a tree, tasks add up gradients,
curvatures and counts per (model, node, feature, bin); a group per (model, node) sums those of all
tasks and picks the best split, so the driver gets one row per node. All models of a call, such as
those of different folds, constraints and feature sets, grow together: the number of jobs depends on
rounds and depth alone.

A positive model must not fall in any feature. A split is only taken if its left value is not above
its right one, and both halves inherit the middle of the two as a bound, so no split further down
can cross it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.frames import materialize

#: Trees that tasks evaluate again before the margins of all rows are written.
CHECKPOINT_ROUNDS = 20


@dataclass(frozen=True)
class Boosting:
    """Strength of the boosted trees. A half of a split needs ``least_rows`` rows and
    ``least_curvature`` of summed second derivatives."""

    rounds: int = 100
    depth: int = 5
    step: float = 0.1
    bins: int = 64
    least_rows: int = 20
    least_curvature: float = 1e-3


@dataclass(frozen=True)
class Member:
    """One model to grow: the features it may split on, whether it must not fall in them, and the fold
    it must not see."""

    name: tuple | str
    features: tuple[str, ...]
    positive: bool = False
    without: str | None = None


@dataclass
class Tree:
    """Nodes by heap position: children of i are 2i + 1 (up to the cut) and 2i + 2. ``feature`` is -1 in
    leaves; ``cover`` counts training rows."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size), np.zeros(size))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """Node where each row of bins ends up."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class BoostedModel:
    """Probability of the positive class; missing features count as 0. ``cuts`` are upper ends of bins."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def to_json(self) -> dict:
        trees = [{k: v.tolist() for k, v in vars(t).items()} for t in self.trees]
        return {"features": self.features, "cuts": [c.tolist() for c in self.cuts], "base": self.base, "trees": trees}

    @classmethod
    def from_json(cls, spec: dict) -> BoostedModel:
        kinds = {"feature": np.int32, "cut": np.int32, "value": float, "cover": float}
        trees = [Tree(**{k: np.array(v, kinds[k]) for k, v in t.items()}) for t in spec["trees"]]
        return cls(spec["features"], [np.array(c, float) for c in spec["cuts"]], spec["base"], trees)

    def binned(self, values: np.ndarray) -> np.ndarray:
        return binned(values, self.cuts)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.places(bins)] for t in self.trees), np.zeros(len(bins)))

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(self.binned(values))))

    def inputs(self) -> list[Column]:
        return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features]

    def score(self) -> Column:
        return grouped_probability(F.lit(""), {"": self})


def grouped_probability(by: Column, models: Mapping[str, BoostedModel]) -> Column:
    """Probability by the model of each row's group, NULL in a group without one. One Arrow pass."""
    first = next(iter(models.values()))

    @F.pandas_udf("double")
    def probability(group: pd.Series, *columns: pd.Series) -> pd.Series:
        values = np.stack([c.to_numpy(float) for c in columns], axis=1) if columns else np.zeros((len(group), 0))
        result = np.full(len(group), np.nan)
        keys = group.to_numpy(object)
        for key, model in models.items():
            own = keys == key
            if own.any():
                result[own] = model.probabilities(values[own])
        return pd.Series(result).astype(object).where(~np.isnan(result), None).astype("Float64")

    return probability(by.cast("string"), *first.inputs())


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of cuts below it."""
    return np.stack([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def feature_cuts(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of every feature: zero, and quantiles of the other values."""
    shares = [i / (bins - 2) for i in range(bins - 2)]
    found = rows.agg(
        *[
            F.percentile_approx(F.nullif(F.col(c).cast("double"), F.lit(0.0)), shares, 10_000).alias(f"q{i}")
            for i, c in enumerate(features)
        ]
    ).first()
    return [np.unique(np.array([0.0, *(found[f"q{i}"] or [])])) for i in range(len(features))]


_BLOCK = "bins binary, y binary, fold array<string>, margins binary"


def pack(rows: DataFrame, features: Sequence[str], label: str, fold: str | None, cuts: Sequence[np.ndarray]) -> DataFrame:
    """Labelled rows as blocks: one row per Arrow batch, with bins row by row."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    group = (F.lit(None) if fold is None else F.col(fold)).cast("string").alias("_fold")
    plain = rows.where(F.col(label).isNotNull()).select(group, F.col(label).cast("double").alias("_y"), *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(cuts))]
            bins = binned(np.stack(columns, axis=1), cuts)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (bins.tobytes(), y.tobytes())]
                + [pa.array([batch.column(0).to_pylist()], pa.list_(pa.string())), pa.array([b""], pa.binary())],
                ["bins", "y", "fold", "margins"],
            )

    return plain.mapInArrow(run, _BLOCK)


def _opened(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    for bins, y, fold, margins in zip(*[batch.column(c).to_pylist() for c in ("bins", "y", "fold", "margins")]):
        truth = np.frombuffer(y, np.float64)
        table = np.frombuffer(bins, np.uint8).reshape(len(truth), width)
        yield table, truth, np.array(fold, object), np.frombuffer(margins, np.float64).reshape(-1, len(truth))


def _current(table, margins, at: int, base: float, recent: Sequence[Tree]) -> np.ndarray:
    start = margins[at] if len(margins) else np.full(len(table), base)
    return start + sum((t.value[t.places(table)] for t in recent), np.zeros(len(table)))


def best_split(sums: np.ndarray, allowed: np.ndarray, positive: bool, low: float, high: float, how: Boosting):
    """Best split of a node from its (feature, bin, [gradient, curvature, rows]) sums.

    Returns (feature, bin, value left, value right, rows left, rows right, own value, rows); the feature
    is -1 if no split lowers the loss. Equal gains go to the first feature and bin.
    """
    whole = sums[0].sum(axis=0)

    def value(g, h):
        return np.clip(-g / np.maximum(h, 1e-12), low, high)

    def loss(g, h, w):
        return g * w + 0.5 * h * w * w

    own = float(value(whole[0], whole[1]))
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = whole - left
    wl, wr = value(left[..., 0], left[..., 1]), value(right[..., 0], right[..., 1])
    gain = loss(whole[0], whole[1], own) - loss(left[..., 0], left[..., 1], wl) - loss(right[..., 0], right[..., 1], wr)
    possible = (left[..., 2] >= how.least_rows) & (right[..., 2] >= how.least_rows)
    possible &= (left[..., 1] >= how.least_curvature) & (right[..., 1] >= how.least_curvature) & allowed[:, None]
    if positive:
        possible &= wl <= wr
    gain = np.where(possible, gain, -np.inf)
    top = gain.max(initial=-np.inf)
    if not top > 1e-10:
        return -1, 0, own, own, whole[2], 0.0, own, whole[2]
    f, b = np.unravel_index(int(np.argmax(gain >= top - 1e-9 * abs(top))), gain.shape)
    return int(f), int(b), float(wl[f, b]), float(wr[f, b]), float(left[f, b, 2]), float(right[f, b, 2]), own, float(whole[2])


_SPLITS = (
    "member int, node int, feature int, cut int, value_left double, value_right double, "
    "rows_left double, rows_right double, value double, n double"
)


def grow(rows: DataFrame, label: str, members: Sequence[Member], fold: str | None = None,
         how: Boosting = Boosting()) -> dict[object, BoostedModel]:
    """Fit every member. ``rows`` is read twice and should be a written table; rows without a label are
    not seen, nor are those of a member's excluded fold. Missing features count as 0."""
    features = list(dict.fromkeys(c for m in members for c in m.features))
    width = len(features)
    cuts = feature_cuts(rows, features, how.bins)
    blocks = materialize(pack(rows, features, label, fold, cuts))
    top = max((len(c) for c in cuts), default=0) + 1
    allowed = [np.array([c in m.features for c in features]) for m in members]
    bases = _priors(rows, label, fold, members)
    models = [BoostedModel(features, cuts, b) for b in bases]
    written = 0
    for round_ in range(how.rounds):
        if round_ - written == CHECKPOINT_ROUNDS:
            blocks = materialize(_with_margins(blocks, width, bases, [m.trees[written:] for m in models]))
            written = round_
        trees = [Tree.empty(how.depth) for _ in members]
        bounds = [{0: (-np.inf, np.inf)} for _ in members]
        for level in range(how.depth):
            open_ = {(m, n) for m in range(len(members)) for n in bounds[m] if n >= 2**level - 1}
            if not open_:
                break
            recent = [m.trees[written:] for m in models]
            for s in _level(blocks, width, top, members, allowed, bases, recent, trees, bounds, level, how):
                m, node, low_high = s["member"], s["node"], bounds[s["member"]][s["node"]]
                tree = trees[m]
                if level == 0:
                    tree.value[0], tree.cover[0] = s["value"] * how.step, s["n"]
                if s["feature"] < 0:
                    continue
                tree.feature[node], tree.cut[node] = s["feature"], s["cut"]
                middle = (s["value_left"] + s["value_right"]) / 2
                halves = ((s["value_left"], s["rows_left"]), (s["value_right"], s["rows_right"]))
                for child, (value, n) in zip((2 * node + 1, 2 * node + 2), halves):
                    tree.value[child], tree.cover[child] = value * how.step, n
                    low, high = low_high
                    if members[m].positive:
                        low, high = (low, min(high, middle)) if child % 2 else (max(low, middle), high)
                    bounds[m][child] = (low, high)
        for model, tree in zip(models, trees):
            model.trees.append(tree)
    return {m.name: model for m, model in zip(members, models)}


def _priors(rows: DataFrame, label: str, fold: str | None, members: Sequence[Member]) -> list[float]:
    """Log odds of the positive share that each member sees."""
    key = (F.lit(None) if fold is None else F.col(fold)).cast("string")
    counted = rows.where(F.col(label).isNotNull()).groupBy(key.alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")
    ).collect()
    result = []
    for member in members:
        own = [(r["n"], r["p"]) for r in counted if member.without is None or r["f"] != member.without]
        n, p = sum(a for a, _ in own), sum(b for _, b in own)
        if not n:
            raise ValueError(f"{member.name}: no training rows")
        share = min(max(p / n, 1e-9), 1 - 1e-9)
        result.append(float(np.log(share / (1 - share))))
    return result


def _with_margins(blocks: DataFrame, width: int, bases: Sequence[float], recent: Sequence[Sequence[Tree]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [
                np.stack([_current(table, known, i, b, recent[i]) for i, b in enumerate(bases)]).tobytes()
                for table, _, _, known in _opened(batch, width)
            ]
            kept = [batch.column(c) for c in ("bins", "y", "fold")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(margins, pa.binary())], ["bins", "y", "fold", "margins"])

    return blocks.mapInArrow(run, _BLOCK)


def _level(blocks, width, top, members, allowed, bases, recent, trees, bounds, level, how):
    """Best splits of all nodes of a level that any row reaches."""
    first, count = 2**level - 1, 2**level
    features = np.arange(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for table, y, fold, margins in _opened(batch, width):
                for i, member in enumerate(members):
                    z = _current(table, margins, i, bases[i], recent[i])
                    node = trees[i].places(table) - first
                    seen = node >= 0
                    if member.without is not None:
                        seen &= fold != member.without
                    p = 1 / (1 + np.exp(-z[seen]))
                    place = (node[seen, None] * width + features) * top + table[seen]
                    size = count * width * top
                    weights = (p - y[seen], p * (1 - p), np.ones(len(p)))
                    own = np.stack([np.bincount(place.ravel(), np.repeat(w, width), size) for w in weights], axis=-1)
                    sums[i] = sums.get(i, 0) + own
        keys, values = [], []
        for i, own in sums.items():
            parts = own.reshape(count, width * top * 3)
            for n in np.flatnonzero(parts[:, 2::3].any(axis=1)):
                if first + n in bounds[i]:
                    keys.append((i, int(first + n)))
                    values.append(parts[n].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.int32()), pa.array([n for _, n in keys], pa.int32()), pa.array(values, pa.binary())],
            ["member", "node", "v"],
        )

    def pick(table: pa.Table) -> pa.Table:
        m, n = table.column("member")[0].as_py(), table.column("node")[0].as_py()
        sums = sum(np.frombuffer(v, np.float64) for v in table.column("v").to_pylist()).reshape(width, top, 3)
        found = (m, n, *best_split(sums, allowed[m], members[m].positive, *bounds[m][n], how))
        names = [c.split()[0] for c in _SPLITS.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 6
        return pa.table([pa.array([v], k) for v, k in zip(found, kinds)], names=names)

    parts = blocks.mapInArrow(add, "member int, node int, v binary")
    return parts.groupBy("member", "node").applyInArrow(pick, _SPLITS).collect()
