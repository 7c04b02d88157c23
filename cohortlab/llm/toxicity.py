"""Toxicity by logistic regression with FTRL-proximal updates over hashed word features.

Features are the distinct hashed words (without punctuation), word pairs and skip-grams (pairs with
one word left out) of a text, 1 if present. Per-coordinate rates and the L1 term leave few weights, which are broadcast.
The trainer takes a bounded sample of labelled rows: all of them up to ``SAMPLE_ROWS``, else those
with the smallest id hashes in proportion. The sample is dealt to shards of about ``SHARD_ROWS`` rows,
each trained by one task; their weights are averaged. (McMahan et al., 2013.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.tables import fold
from cohortlab.llm.words import SPACE_AND_MARKS, Words, mix, slices_of, word_table

FEATURES = 1 << 20
SAMPLE_ROWS = 40_000
SHARD_ROWS = 10_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
_PAIR, _SKIP = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAAAAAAAAAAAAAAAB)


def feature_places(table: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and text of every word, pair and skip-gram of a slice."""
    h, owner = table.hashes, table.owner
    mask = np.uint64(FEATURES - 1)
    features, owners = [mix(h) & mask], [owner]
    for gap, key in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            together = owner[gap:] == owner[:-gap]
            joined = mix(h[:-gap] * key + h[gap:] + np.uint64(gap))
            features.append(joined[together] & mask)
            owners.append(owner[gap:][together])
    return np.concatenate(features).astype(np.int64), np.concatenate(owners)


def text_features(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct features of each text."""
    table = word_table(column, SPACE_AND_MARKS)
    features, owner = feature_places(table)
    key = np.unique(owner * FEATURES + features)
    cuts = np.searchsorted(key, np.arange(len(table.offsets)) * FEATURES)
    return [key[a:b] % FEATURES for a, b in zip(cuts, cuts[1:])]


class Ftrl:
    """State of one model: per-coordinate gradient sums ``z`` and squares ``n``."""

    def __init__(self):
        self.z, self.n, self.bias_z, self.bias_n = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0

    @staticmethod
    def _weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def weights(self) -> np.ndarray:
        return self._weight(self.z, self.n, L1)

    @property
    def bias(self) -> float:
        return float(self._weight(self.bias_z, self.bias_n, 0.0))

    def learn(self, features: np.ndarray, label: int) -> None:
        z, n = self.z[features], self.n[features]
        w = self._weight(z, n, L1)
        b = self.bias
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - label
        self.z[features] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[features] = n + g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / ALPHA * b
        self.bias_n += g * g


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's model as (feature, weight); the bias is feature -1."""
    rows = rows.sort_values("order", kind="stable")
    column = pa.array(rows["text"], pa.large_string())
    examples: list[np.ndarray] = []
    for part in slices_of(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
        examples += [x.astype(np.int32) for x in text_features(part.column(0))]
    labels = rows["toxic"].to_numpy()
    model = Ftrl()
    for _ in range(EPOCHS):
        for features, label in zip(examples, labels):
            model.learn(features, int(label))
    weights = model.weights()
    used = np.flatnonzero(weights)
    return pd.DataFrame({"feature": np.append(used, -1), "weight": np.append(weights[used], model.bias)})


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Averaged weights of the shards' models, learnt outside the held-out fold."""
    marks = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    count = marks.count()
    if not count:
        return np.zeros(FEATURES, np.float32), 0.0
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    sample = marks.withColumn("order", order)
    if count > SAMPLE_ROWS:
        sample = sample.where(F.col("order") < F.lit(int((1 << 40) * SAMPLE_ROWS / count)))
    shards = -(-min(count, SAMPLE_ROWS) // SHARD_ROWS)
    # At most about SAMPLE_ROWS narrow rows are broadcast, so texts outside the sample never move.
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic", "order")
        .agg(F.min("text").alias("text"))
        .select("text", "toxic", "order", (F.col("order") % shards).alias("shard"))
    )
    models = rows.groupBy("shard").applyInPandas(_train, "feature bigint, weight double")
    found = models.groupBy("feature").agg(F.sum("weight").alias("total")).toPandas()
    weights = np.zeros(FEATURES, np.float32)
    own = found[found["feature"] >= 0]
    weights[own["feature"].to_numpy()] = own["total"].to_numpy() / shards
    return weights, float(found.loc[found["feature"] < 0, "total"].sum() / shards)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every document.

    A null or empty text has no features and gets the score of the bias. Labels other than 0 and 1
    and labels without a document teach nothing; an id labelled twice is toxic if either says so.
    Without labels every score is 0.5. Repeated rows are scored each; other columns are not read.
    """
    weights, bias = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part in slices_of(batch, "text"):
                table = word_table(part.column(1), SPACE_AND_MARKS)
                features, owner = feature_places(table)
                used = weights[features] != 0
                # A feature counts once per text, however often it occurs.
                key = np.unique(owner[used] * FEATURES + features[used])
                margin = np.bincount(key // FEATURES, weights[key % FEATURES], part.num_rows) + bias
                value = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    held_out = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int"
    return docs.select("doc_id", "text", held_out).mapInArrow(score, schema)
