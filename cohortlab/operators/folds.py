"""Train/test folds as a column.

Positions inside a stratum or among groups come from running counts over ordered slices, so no
stratum has to fit one task. Guarantees match the usual splitters (groups never straddle folds,
sizes and class shares balanced); the fold labels are not those of any particular library.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.expressions import hash_unit
from cohortlab.functions.frames import dimension_join
from cohortlab.operators.ordering import running_totals


def single_split(rows: DataFrame, split: str = "test", name: str = "split") -> DataFrame:
    return rows.withColumn(name, F.lit(split))


def _serpentine(position: Column, n_folds: int) -> Column:
    """0, 1, .., k-1, k-1, .., 1, 0, 0, 1, ..: each round gives the next larger item to the fold
    that was served last in the round before."""
    turn, place = F.floor(position / n_folds), F.pmod(position, F.lit(n_folds))
    return F.when(turn % 2 == 0, place).otherwise(F.lit(n_folds - 1) - place).cast("int")


def group_kfold(rows: DataFrame, n_folds: int, group: str, name: str = "fold") -> DataFrame:
    """Folds of similar size that keep groups together: groups by falling size, dealt in turns."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size")).withColumn("one", F.lit(1))
    placed = running_totals(
        sizes.withColumn("_all", 0 * F.col("size")),
        ["_all"], [F.col("size").desc(), F.col(group).asc()], ["one"],
    )
    folds = placed.select(group, _serpentine(F.col("one_cum") - 1, n_folds).alias(name))
    return dimension_join(rows, folds, [group])


def stratified_kfold(rows: DataFrame, n_folds: int, label: str, key: Sequence[str], seed: int = 0,
                     group: str | None = None, map_label: Callable[[Column], Column] = lambda y: y,
                     name: str = "fold") -> DataFrame:
    """Folds with similar label shares.

    Without groups: rows of each label in hashed order, dealt in turn. With groups: groups ordered
    by their share of positive labels and then size, dealt in turns.
    """
    labelled = rows.withColumn("_label", map_label(F.col(label)).cast("string"))
    if group is None:
        order = [F.col("_order").asc(), *[F.col(c).asc() for c in key]]
        spots = labelled.select(*key, "_label", hash_unit(*[F.col(c) for c in key], seed=seed).alias("_order"))
        placed = running_totals(spots.withColumn("one", F.lit(1)), ["_label"], order, ["one"])
        folds = placed.select(*key, F.pmod(F.col("one_cum") - 1, F.lit(n_folds)).cast("int").alias(name))
        return rows.join(folds, list(key))
    per_group = labelled.groupBy(group).agg(
        F.count("*").alias("size"), F.sum(_as_number(F.col("_label"))).alias("_pos")
    )
    share = F.col("_pos") / F.col("size")
    ready = per_group.withColumns({"one": F.lit(1), "_share": share, "_all": 0 * F.col("size")})
    order = [F.col("_share").desc(), F.col("size").desc(), F.col(group).asc()]
    placed = running_totals(ready, ["_all"], order, ["one"])
    folds = placed.select(group, _serpentine(F.col("one_cum") - 1, n_folds).alias(name))
    return dimension_join(rows, folds, [group])


def _as_number(label: Column) -> Column:
    return F.when(label == "true", 1.0).when(label == "false", 0.0).otherwise(label.try_cast("double"))


def add_unlabeled(rows: DataFrame, extra: DataFrame, outcomes: Sequence[str], fold_label: str,
                  fold: str = "fold") -> DataFrame:
    """Append rows without outcome under a fold label of their own; they are predicted and
    explained but neither trained on nor scored."""
    if fold not in rows.columns:
        raise ValueError("add folds before unlabelled rows")
    labelled = extra.agg(*[F.count(c).alias(c) for c in outcomes]).first().asDict()
    if any(labelled.values()):
        raise ValueError(f"unlabelled rows have outcomes: {labelled}")
    kept = rows.withColumn(fold, F.col(fold).cast("string"))
    added = extra.withColumn(fold, F.lit(fold_label))
    return kept.unionByName(added, allowMissingColumns=True)
