"""Order-dependent building blocks that never hold a whole group in one task.

A window over ``partitionBy(group)`` sends every row of a group to one task. These operators cut
a group into ordered slices or keep only its top rows before the group comes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.frames import dimension_join, materialize, row_salt, salt_count


def running_totals(cells: DataFrame, group: list[str], order: list[Column], sums: list[str],
                   slices: int | None = None) -> DataFrame:
    """Add ``<c>_cum`` (inclusive running sum) and ``<c>_total`` for every column in ``sums``.

    ``cells`` has one row per (group, order value). Rows are range-partitioned by (group, order),
    so a hot group is spread over many slices of similar size. The slice numbers are written down
    before they are used twice. Offsets come from a table of one row per (group, slice), which has
    at most ``groups + slices`` rows. Without a number of slices, adaptive execution merges
    neighbouring ones on small data, which keeps their order.
    """
    keys = [*[F.col(g) for g in group], *order]
    ordered = cells.repartitionByRange(slices, *keys) if slices else cells.repartitionByRange(*keys)
    ranged = materialize(ordered.withColumn("_slice", F.spark_partition_id()))
    per_slice = ranged.groupBy(*group, "_slice").agg(*[F.sum(c).alias(c) for c in sums])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *group,
        "_slice",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_before") for c in sums],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums],
    )
    inside = (
        Window.partitionBy(*group, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumns({f"_{c}_local": F.sum(c).over(inside) for c in sums})
    return (
        local.join(offsets, [*group, "_slice"])
        .withColumns({f"{c}_cum": F.col(f"_{c}_local") + F.col(f"_{c}_before") for c in sums})
        .drop("_slice", *[f"_{c}_local" for c in sums], *[f"_{c}_before" for c in sums])
    )


def top_rows(df: DataFrame, group: list[str], order: list[Column], spread_by: list[str],
             k: int) -> DataFrame:
    """The first ``k`` rows per group with their position ``rn``.

    First the top ``k`` of every (group, salt), then the top ``k`` of those, so the last window
    sees at most ``k * salts`` rows per group. Exact: a row in the overall top is in the top of
    its salt.
    """
    salts = salt_count(df.sparkSession)
    salted = df.withColumn("_salt", row_salt(df, spread_by, salts))
    first = Window.partitionBy(*group, "_salt").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= k)
        .drop("rn", "_salt")
        .withColumn("rn", F.row_number().over(final))
        .filter(F.col("rn") <= k)
    )


def score_at_rank(top: DataFrame, group: list[str], score: str, limits: list[int]) -> DataFrame:
    """Per group and limit: the score at that position, NULL if the group is shorter."""
    wide = top.groupBy(*group).agg(
        *[F.max(F.when(F.col("rn") == k, F.col(score))).alias(str(k)) for k in limits]
    )
    return unpivot(wide, group, [str(k) for k in limits], "limit", "cutoff").withColumn(
        "limit", F.col("limit").cast("int")
    )


def topk_cutoffs(df: DataFrame, group: list[str], score: str, spread_by: list[str],
                 limits: list[int]) -> DataFrame:
    """Per group and limit: the k-th largest score, or the smallest if the group is shorter.

    Rows with ``score >= cutoff`` include all ties at the cutoff.
    """
    top = top_rows(
        df.filter(F.col(score).isNotNull()), group, [F.col(score).desc()], spread_by, max(limits)
    )
    wide = top.groupBy(*group).agg(
        *[F.min(F.when(F.col("rn") <= k, F.col(score))).alias(str(k)) for k in limits]
    )
    return unpivot(wide, group, [str(k) for k in limits], "limit", "cutoff").withColumn(
        "limit", F.col("limit").cast("int")
    )


def exact_quantiles(df: DataFrame, group: list[str], value: str,
                    quantiles: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group as rows (group, quantile, cutoff).

    Equal values are counted first; the two neighbours of each quantile are then found by
    running counts, so no aggregate holds all values of a group.
    """
    cells = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    ranked = running_totals(cells, group, [F.col(value).asc()], ["n"])
    position = {q: F.lit(q) * (F.col("n_total") - 1) for q in quantiles}

    def at(index: Column) -> Column:
        held = (F.col("n_cum") - F.col("n") <= index) & (index < F.col("n_cum"))
        return F.max(F.when(held, F.col(value)))

    named = {q: f"q{i}" for i, q in enumerate(quantiles)}
    wide = ranked.groupBy(*group).agg(
        *[at(F.floor(position[q])).alias(f"{named[q]}_lo") for q in quantiles],
        *[at(F.ceil(position[q])).alias(f"{named[q]}_hi") for q in quantiles],
        *[F.max(position[q] - F.floor(position[q])).alias(f"{named[q]}_w") for q in quantiles],
    )
    entries = [
        F.struct(
            F.lit(float(q)).alias("quantile"),
            (
                F.col(f"{named[q]}_lo")
                + (F.col(f"{named[q]}_hi") - F.col(f"{named[q]}_lo")) * F.col(f"{named[q]}_w")
            ).alias("cutoff"),
        )
        for q in quantiles
    ]
    return wide.select(*group, F.inline(F.array(*entries)))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str,
            keep_nulls: bool = True) -> DataFrame:
    """Wide to long; NULL cells are kept unless told otherwise."""
    long = df.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in columns], name, value)
    return long if keep_nulls else long.filter(F.col(value).isNotNull())


def with_group_range(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Add the group minimum and maximum (``_lo``, ``_hi``) without a window over the group."""
    extent = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return dimension_join(df, extent, group)
