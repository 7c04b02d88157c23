"""Classification, regression and ranking metrics per group.

``by`` names the groups: model, fold, area, query. Rows without a truth are left out. Everything
that depends on score order works on counts per distinct score, cut into ordered slices, so that
one group may be far larger than a task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.expressions import ratio
from cohortlab.functions.frames import dimension_join, materialize
from cohortlab.operators.ordering import running_totals, top_rows, unpivot, with_group_range

DEFAULT_RANKS = (10, 50, 100, 200, 500, 1000)
AREA_RANKS = (*range(10, 100, 10), 150, 200, 250, 300, 400, 500, 1000)
QUERY_RANKS = (3, 5, 10, 20, 50, 100, 200)
DEFAULT_THRESHOLD = 0.5
EPSILON = sys.float_info.epsilon


def scored_rows(rows: DataFrame, by: Sequence[str], key: Sequence[str], truth: str,
                score: str) -> DataFrame:
    """Rows with a class as truth, -1 read as 0, in columns ``y`` and ``score``. Any other truth than
    -1, 0 and 1 fails the job that reads it."""
    y = F.col(truth).cast("double")
    bad = F.concat(F.lit(f"{truth} is not in (-1, 0, 1): "), y.cast("string"))
    y = F.when(y.isin(-1.0, 0.0, 1.0), y).otherwise(F.raise_error(bad).cast("double"))
    return graded_rows(rows.withColumn(truth, F.when(y == -1, 0.0).otherwise(y)), by, key, truth, score)


def graded_rows(rows: DataFrame, by: Sequence[str], key: Sequence[str], truth: str, score: str) -> DataFrame:
    """Rows with a truth of any size, for metrics of graded relevance and order, in columns ``y`` and
    ``score``."""
    return rows.filter(F.col(truth).isNotNull()).select(
        *by, *key, F.col(truth).cast("double").alias("y"), F.col(score).cast("double").alias("score")
    )


def truth_violations(rows: DataFrame, truth: str) -> DataFrame:
    """One row: how many truths are neither -1, 0 nor 1."""
    y = F.col(truth).cast("double")
    return rows.agg(F.count(F.when(~y.isin(-1.0, 0.0, 1.0), 1)).alias("n_violations"))


def check_truth(rows: DataFrame, truth: str) -> DataFrame:
    n = truth_violations(rows, truth).first()["n_violations"]
    if n:
        raise ValueError(f"{n} values of {truth!r} are not in (-1, 0, 1)")
    return rows


def threshold_metrics(scored: DataFrame, by: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Sizes, precision, recall, F1 and Matthews correlation at ``score > threshold``."""
    limit = DEFAULT_THRESHOLD if threshold is None else threshold
    positive, flagged = F.col("y") > 0, F.col("score") > limit
    counts = scored.groupBy(*by).agg(
        F.count("*").alias("n_samples"),
        F.count(F.when(positive, 1)).alias("n_positives"),
        F.count(F.when(positive & flagged, 1)).cast("double").alias("_tp"),
        F.count(F.when(~positive & flagged, 1)).cast("double").alias("_fp"),
        F.count(F.when(positive & ~flagged, 1)).cast("double").alias("_fn"),
        F.count(F.when(~positive & ~flagged, 1)).cast("double").alias("_tn"),
    )
    tp, fp, fn, tn = [F.col(f"_{x}") for x in ("tp", "fp", "fn", "tn")]
    zero = F.lit(0.0)
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.select(
        *by,
        "n_samples",
        "n_positives",
        ratio(F.col("n_positives"), F.col("n_samples")).alias("balance"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        F.coalesce(ratio(tp * tn - fp * fn, spread), zero).alias("mcc"),
    )


def calibration_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brier score, class-balanced absolute error and log loss (NULL with one class)."""
    y, p = F.col("y"), F.col("score")
    bounded = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))
    error = F.abs(y - p)
    both = (F.min("y") != F.max("y"))
    return scored.groupBy(*by).agg(
        F.avg((y - p) * (y - p)).alias("brier"),
        ((F.avg(F.when(y > 0, error)) + F.avg(F.when(y <= 0, error))) / 2).alias("balanced_mae"),
        F.when(both, -F.avg(y * F.ln(bounded) + (1 - y) * F.ln(1 - bounded))).alias("log_loss"),
    )


def rank_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC AUC (tied scores count half, NULL with one class) and average precision over the
    distinct scores (0 without positives), both from one set of running counts."""
    cells = scored.groupBy(*by, "score").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("y") > 0, 1)).alias("pos")
    )
    ranked = running_totals(cells, list(by), [F.col("score").desc()], ["n", "pos"])
    negatives_below = (F.col("n_total") - F.col("pos_total")) - (F.col("n_cum") - F.col("pos_cum"))
    wins = F.col("pos") * (negatives_below + (F.col("n") - F.col("pos")) / 2)
    n_pos = F.max("pos_total")
    n_neg = F.max("n_total") - n_pos
    return ranked.groupBy(*by).agg(
        ratio(F.sum(wins), n_pos.cast("double") * n_neg).alias("roc_auc"),
        F.coalesce(
            ratio(F.sum(F.col("pos") * ratio(F.col("pos_cum"), F.col("n_cum"))), n_pos), F.lit(0.0)
        ).alias("average_precision"),
    )


def metrics_at_ranks(scored: DataFrame, by: Sequence[str], key: Sequence[str],
                     ranks: Sequence[int] | None = None) -> DataFrame:
    """Precision, recall and average precision among the first k, ties broken by key.

    A k beyond the group size means all of it. Only the first max(k) rows of a group are ranked.
    """
    ranks = DEFAULT_RANKS if ranks is None else ranks
    order = [F.col("score").desc(), *[F.col(c).asc() for c in key]]
    top = top_rows(scored, list(by), order, list(key), max(ranks))
    up_to = Window.partitionBy(*by).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("_precision", F.sum("y").over(up_to) / F.col("rn"))
    totals = scored.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("y").alias("_pos"))

    def within(k: int, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("rn") <= k, value)), F.lit(0.0))

    sums = top.groupBy(*by).agg(
        *[within(k, F.col("y")).alias(f"_hits{k}") for k in ranks],
        *[within(k, F.col("y") * F.col("_precision")).alias(f"_sum{k}") for k in ranks],
    ).join(totals, list(by))
    return sums.select(
        *by,
        *[
            ratio(F.col(f"_hits{k}"), F.least(F.lit(k), F.col("_n"))).alias(f"precision@{k}")
            for k in ranks
        ],
        *[
            F.coalesce(ratio(F.col(f"_sum{k}"), F.col(f"_hits{k}")), F.lit(0.0)).alias(f"average_precision@{k}")
            for k in ranks
        ],
        *[ratio(F.col(f"_hits{k}"), F.col("_pos")).alias(f"recall@{k}") for k in ranks],
    )


def classification_metrics(rows: DataFrame, by: Sequence[str], key: Sequence[str], truth: str,
                           score: str, ranks: Sequence[int] | None = None,
                           threshold: float | None = None) -> DataFrame:
    """All classifier metrics, one row per group. ``rows`` is read several times and should be a
    written table; the key has to be unique within a group for ties to break the same way."""
    scored = scored_rows(rows, by, key, truth, score)
    parts = [
        threshold_metrics(scored, by, threshold),
        rank_metrics(scored, by),
        calibration_metrics(scored, by),
        metrics_at_ranks(scored, by, key, ranks),
    ]
    return reduce(lambda a, b: a.join(b, list(by)), parts)


def regression_metrics(rows: DataFrame, by: Sequence[str], truth: str, score: str) -> DataFrame:
    """n, explained variance, squared and absolute error, R² (1 or 0 for a constant truth)."""
    y, p = F.col(truth).cast("double"), F.col(score).cast("double")
    residual = y - p
    found = rows.filter(y.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_samples"),
        F.var_pop(residual).alias("_residual_var"),
        F.var_pop(y).alias("_var"),
        F.avg(residual * residual).alias("mean_squared_error"),
        F.avg(F.abs(residual)).alias("mean_absolute_error"),
    )

    def explained(loss: str) -> Column:
        return F.when(F.col("_var") > 0, 1 - F.col(loss) / F.col("_var")).otherwise(
            F.when(F.col(loss) == 0, 1.0).otherwise(0.0)
        )

    return found.select(
        *by,
        "n_samples",
        explained("_residual_var").alias("explained_variance"),
        "mean_squared_error",
        "mean_absolute_error",
        explained("mean_squared_error").alias("r2"),
    )


def ndcg_at_ranks(scored: DataFrame, by: Sequence[str], ranks: Sequence[int] = QUERY_RANKS) -> DataFrame:
    """NDCG with gain = truth; rows with equal scores share their mean gain over the positions
    they occupy; 0 when nothing is relevant. Counts per score are ranked, never the rows."""
    deepest = max(ranks)
    discounts = [0.0]
    for position in range(deepest):
        discounts.append(discounts[-1] + 1 / math.log2(position + 2))
    table = F.array(*[F.lit(d) for d in discounts])

    def gains(order: str, mean_gain: Column) -> DataFrame:
        cells = scored.groupBy(*by, F.col(order).alias("_order")).agg(
            F.count("*").alias("_n"), F.sum("y").alias("_y")
        )
        top = top_rows(cells, list(by), [F.col("_order").desc()], ["_order"], deepest)
        up_to = Window.partitionBy(*by).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
        placed = top.withColumn("_end", F.sum("_n").over(up_to))

        def discount(position: Column, k: int) -> Column:
            return F.element_at(table, (F.least(position, F.lit(k)) + 1).cast("int"))

        start, end = F.col("_end") - F.col("_n"), F.col("_end")
        return placed.groupBy(*by).agg(
            *[F.sum(mean_gain * (discount(end, k) - discount(start, k))).alias(str(k)) for k in ranks]
        )

    mean_gain = F.col("_y") / F.col("_n")
    actual = gains("score", mean_gain)
    ideal = gains("y", mean_gain).withColumnsRenamed({str(k): f"_{k}" for k in ranks})
    return actual.join(ideal, list(by)).select(
        *by,
        *[F.coalesce(ratio(F.col(str(k)), F.col(f"_{k}")), F.lit(0.0)).alias(f"ndcg@{k}") for k in ranks],
    )


def kendall_tau(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kendall's tau-b without forming pairs.

    Truth levels are numbered per group. Two rows of different levels first differ at exactly one
    bit of those numbers, counted from the top; among the rows that agree above it, the pair is a
    "one" against a "zero". Per bit, running counts of zeros by score therefore give concordant
    minus discordant pairs, at one row per cell and bit.
    """
    by = list(by)
    cells = scored.groupBy(*by, "y", "score").agg(F.count("*").alias("n"))
    levels = cells.groupBy(*by, "y").agg(F.sum("n").alias("n"))
    numbered = running_totals(levels.withColumn("one", F.lit(1)), by, [F.col("y").asc()], ["one", "n"])
    ranks = numbered.select(
        *by, "y", (F.col("one_cum") - 1).alias("_rank"),
        F.length(F.bin((F.col("one_total") - 1).cast("long"))).alias("_bits"), "one_total",
    ).filter(F.col("one_total") > 1)
    bit = F.expr("shiftright(_rank, _bit) & 1")
    per_bit = (
        dimension_join(cells, ranks, [*by, "y"], spread_by=["score"])
        .withColumn("_bit", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
        .groupBy(*by, "_bit", F.expr("shiftright(_rank, _bit + 1)").alias("_prefix"), "score")
        .agg(F.sum(F.col("n") * bit).alias("ones"), F.sum(F.col("n") * (1 - bit)).alias("zeros"))
    )
    placed = running_totals(per_bit, [*by, "_bit", "_prefix"], [F.col("score").asc()], ["zeros"])
    below = F.col("zeros_cum") - F.col("zeros")
    above = F.col("zeros_total") - F.col("zeros_cum")
    net = placed.groupBy(*by).agg(F.sum(F.col("ones").cast("double") * (below - above)).alias("_net"))

    def tied_pairs(df: DataFrame, name: str) -> DataFrame:
        n = F.col("n").cast("double")
        return df.groupBy(*by).agg(F.sum(n * (n - 1) / 2).alias(name), F.sum(n).alias(f"{name}_n"))

    in_score = tied_pairs(cells.groupBy(*by, "score").agg(F.sum("n").alias("n")), "_s")
    in_truth = tied_pairs(levels, "_t").drop("_t_n")
    all_pairs = F.col("_s_n") * (F.col("_s_n") - 1) / 2
    return (
        in_score.join(in_truth, by)
        .join(net, by, "left")
        .select(
            *by,
            ratio(
                F.col("_net"), F.sqrt(all_pairs - F.col("_s")) * F.sqrt(all_pairs - F.col("_t"))
            ).alias("kendalls_tau"),
        )
    )


def query_metrics(rows: DataFrame, by: Sequence[str], query: str, key: Sequence[str], truth: str,
                  score: str, ranks: Sequence[int] = QUERY_RANKS) -> DataFrame:
    """Ranker metrics of every query; classifier metrics use truth > 0 and the score scaled to
    [0, 1] within the query (NULL where all scores are equal). The selected columns are written
    once, as every metric reads them."""
    groups = [*by, query]
    scored = materialize(graded_rows(rows, groups, key, truth, score))
    unit = ratio(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    binary = with_group_range(scored, groups, "score").select(
        *groups, *key, F.when(F.col("y") > 0, 1.0).otherwise(0.0).alias("y"), unit.alias("score")
    )
    relevant = scored.groupBy(*groups).agg(F.count(F.when(F.col("y") > 0, 1)).alias("n_relevant"))
    parts = [
        relevant,
        kendall_tau(scored, groups),
        ndcg_at_ranks(scored, groups, ranks),
        threshold_metrics(binary, groups),
        rank_metrics(binary, groups),
        calibration_metrics(binary, groups),
        metrics_at_ranks(binary, groups, key, ranks),
    ]
    return reduce(lambda a, b: a.join(b, groups), parts)


def ranker_metrics(per_query: DataFrame, by: Sequence[str], query: str) -> DataFrame:
    """Across queries: counts (``n_*``) are summed, everything else averaged."""
    names = [c for c in per_query.columns if c not in (*by, query)]
    return per_query.groupBy(*by).agg(
        *[(F.sum(c) if c.startswith("n_") else F.avg(F.col(c))).alias(c) for c in names]
    )


def long_scores(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metric columns to (metric, value) rows."""
    names = [c for c in wide.columns if c not in by]
    doubles = wide.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return unpivot(doubles, list(by), names, "metric", "value")
