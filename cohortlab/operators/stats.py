"""Statistics on cohorts: advancement tables, exact and rank tests, risk ratios, descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.expressions import (
    ln_factorial,
    neg_log10,
    normal_upper_tail,
    ratio,
    risk_ratio,
)
from cohortlab.functions.frames import dimension_join
from cohortlab.functions.naming import OUTCOME, PAIR_KEY, PAIR_PHASE, pair_evidence
from cohortlab.operators.features import first_years
from cohortlab.operators.ontology import join_areas

EMERGED = ("none", "before", "after")
PROGRESS = ("stalled", "advanced")
TAIL_BLOCK = 4096


def advancement_stats(features: DataFrame, initial_phases: Sequence[int], first: int,
                      last: int) -> DataFrame:
    """Pairs by feature, by whether it emerged before or after the first trial, and by progress.

    Evidence of the same year counts as "after".
    """
    phases = F.array(*[f"target_disease__clinical__phase{p}__reached" for p in initial_phases])
    early = F.coalesce(F.array_max(phases) > 0, F.lit(False))
    beyond = F.col(PAIR_PHASE) > max(initial_phases)
    reached, surpassed = F.col("reached"), F.col("surpassed")
    per_pair = first_years(
        features.filter(F.col("year").isNotNull()),
        PAIR_KEY,
        pair_evidence(features.columns),
        F.min(F.when(early, F.col("year"))).alias("reached"),
        F.min(F.when(early & beyond, F.col("year"))).alias("surpassed"),
    ).filter(reached.between(first, last))
    emerged = (
        F.when(F.col("first_year").isNull(), "none")
        .when(F.col("first_year") < reached, "before")
        .otherwise("after")
    )
    progress = F.when(surpassed.isNull(), "stalled").when(surpassed >= reached, "advanced")
    return per_pair.groupBy(
        F.col("name").alias("feature_name"), emerged.alias("emerged"), progress.alias("progress")
    ).agg(F.count("*").alias("n_pairs"))


def fisher_greater(tables: DataFrame, key: list[str], cells: Sequence[str],
                   name: str = "p_value") -> DataFrame:
    """One-sided exact test of [[a, b], [c, d]]: P(at least ``a`` in the first cell).

    The hypergeometric tail is cut into blocks of fixed length that are summed in parallel, so a
    table with very large counts does not become one long loop.
    """
    a, b, c, d = [F.col(x).cast("long") for x in cells]
    row, column, total = a + b, a + c, a + b + c + d
    last = F.least(row, column)
    constant = (
        ln_factorial(row) + ln_factorial(total - row) + ln_factorial(column)
        + ln_factorial(total - column) - ln_factorial(total)
    )
    blocks = tables.select(
        *key,
        row.alias("_row"), column.alias("_column"), total.alias("_total"), last.alias("_last"),
        constant.alias("_constant"), a.alias("_first"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - a) / F.lit(TAIL_BLOCK)))).alias("_block"),
    )
    start = F.col("_first") + F.col("_block") * TAIL_BLOCK
    points = F.sequence(start, F.least(F.col("_last"), start + (TAIL_BLOCK - 1)))

    def log_probability(x: Column) -> Column:
        return (
            F.col("_constant") - ln_factorial(x) - ln_factorial(F.col("_row") - x)
            - ln_factorial(F.col("_column") - x)
            - ln_factorial(F.col("_total") - F.col("_row") - F.col("_column") + x)
        )

    mass = F.aggregate(points, F.lit(0.0), lambda s, x: s + F.exp(log_probability(x)))
    tails = blocks.groupBy(*key).agg(F.least(F.lit(1.0), F.sum(mass)).alias(name))
    return tables.join(tails, key)


def inflation_stats(advancement: DataFrame, confidence: float = 0.99) -> DataFrame:
    """Does evidence that emerged after the first trial concentrate among advanced pairs?"""
    counts = {
        f"{e}_{p}": F.coalesce(
            F.sum(F.when((F.col("emerged") == e) & (F.col("progress") == p), F.col("n_pairs"))), F.lit(0)
        )
        for e in EMERGED
        for p in PROGRESS
    }
    table = advancement.groupBy("feature_name").agg(*[c.alias(n) for n, c in counts.items()])
    fractions = {
        f"{e}_fraction": ratio(F.col(f"{e}_advanced"), F.col(f"{e}_advanced") + F.col(f"{e}_stalled"))
        for e in EMERGED
    }
    tested = fisher_greater(
        table, ["feature_name"], ["after_advanced", "after_stalled", "before_advanced", "before_stalled"]
    )
    n_advanced = F.col("after_advanced") + F.col("before_advanced")
    n_stalled = F.col("after_stalled") + F.col("before_stalled")
    risk = risk_ratio(F.col("after_advanced"), n_advanced, F.col("after_stalled"), n_stalled, confidence)
    both = (n_advanced > 0) & (n_stalled > 0)
    return tested.withColumns(
        {
            **fractions,
            "p_value_neg_log10": neg_log10(F.col("p_value")),
            **{name: F.when(both, column) for name, column in risk.items()},
        }
    )


def relative_risk(rows: DataFrame, by: list[str], exposed: Column, outcome: Column,
                  confidence: float = 0.9) -> DataFrame:
    """Risk ratio of an exposure per group, from four counts in one aggregate."""
    counts = rows.groupBy(*by).agg(
        F.count(F.when(exposed, 1)).alias("n_exposed"),
        F.count(F.when(exposed & outcome, 1)).alias("n_exposed_true"),
        F.count(F.when(~exposed, 1)).alias("n_control"),
        F.count(F.when(~exposed & outcome, 1)).alias("n_control_true"),
    )
    return with_relative_risk(counts, confidence)


def with_relative_risk(counts: DataFrame, confidence: float) -> DataFrame:
    """Fractions and risk ratio from counts; rows with an empty side are dropped."""
    hits, n = F.col("n_exposed_true"), F.col("n_exposed")
    control_hits, control_n = F.col("n_control_true"), F.col("n_control")
    return (
        counts.filter((n > 0) & (control_n > 0))
        .withColumns(
            {
                "fraction_exposed": ratio(hits, n),
                "fraction_control": ratio(control_hits, control_n),
                "n_total": n + control_n,
                **risk_ratio(hits, n, control_hits, control_n, confidence),
            }
        )
        .drop("n_control_true")
    )


def signed_rank(values: DataFrame, group: list[str], pair: str, item: str, value: str,
                base: str) -> DataFrame:
    """One-sided signed-rank test of every item against a base item, paired within a group.

    ``values`` holds one row per (group, item, pair), for example per (limit, model, area), so a
    group is as long as there are areas. Zero and undefined differences are dropped, ties share
    their mean rank and correct the variance; normal approximation without continuity correction. The base item
    itself gets p = 0.
    """
    wanted = values.select(*group, item, pair, F.col(value).alias("_value"))
    base_values = wanted.filter(F.col(item) == base).select(*group, pair, F.col("_value").alias("_base"))
    differences = (
        wanted.join(base_values, [*group, pair])
        .withColumn("_d", F.nanvl(F.col("_value") - F.col("_base"), F.lit(None).cast("double")))
        .withColumn("_used", F.col("_d").isNotNull() & (F.col("_d") != 0))
    )
    key = [*group, item, "_used"]
    size = F.abs("_d")
    by_size = Window.partitionBy(*key).orderBy(size)
    tied = Window.partitionBy(*key, size)
    ranked = differences.withColumns(
        {
            "_rank": F.rank().over(by_size) + (F.count("*").over(tied) - 1) / 2,
            "_ties": F.count("*").over(tied),
        }
    )
    used = F.col("_used")
    sums = ranked.groupBy(*group, item).agg(
        F.count(F.when(used, 1)).alias("n_used"),
        F.coalesce(F.sum(F.when(used & (F.col("_d") > 0), F.col("_rank"))), F.lit(0.0)).alias("statistic"),
        F.coalesce(F.sum(F.when(used, F.pow("_ties", F.lit(2)) - 1)), F.lit(0.0)).alias("_tie_sum"),
    )
    n = F.col("n_used").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie_sum") / 48
    z = F.when(variance > 0, (F.col("statistic") - n * (n + 1) / 4) / F.sqrt(variance))
    return (
        sums.withColumn("z", F.when(F.col(item) != base, z))
        .withColumn("p_value", F.when(F.col(item) == base, 0.0).otherwise(normal_upper_tail("z")))
        .drop("_tie_sum")
    )


def cohort_stats(cohort: DataFrame, areas: DataFrame) -> DataFrame:
    """Size, years, balance and evidence share per therapeutic area and split.

    Distinct targets and diseases are counted by grouping on them first, so no aggregate keeps a
    set and no row is multiplied per distinct count.
    """
    by = ["therapeutic_area_name", "split"]
    names = areas.select("disease_id", "therapeutic_area_name").distinct()
    nowhere = cohort.select("disease_id").distinct().join(names, "disease_id", "left_anti")
    if not nowhere.isEmpty():
        raise ValueError(f"diseases without a therapeutic area: {[r[0] for r in nowhere.limit(5).collect()]}")
    has_evidence = F.greatest(
        F.lit(False), *[F.coalesce(F.col(c) > 0, F.lit(False)) for c in pair_evidence(cohort.columns)]
    )
    rows = join_areas(
        cohort.select(*PAIR_KEY, "split", "transition_year", OUTCOME, has_evidence.alias("_evidence")), names
    )
    n = F.sum("n")
    per_target = rows.groupBy(*by, "target_id").agg(
        F.count("*").alias("n"),
        F.min("transition_year").alias("lo"),
        F.max("transition_year").alias("hi"),
        F.count(F.when(F.col(OUTCOME), 1)).alias("advanced"),
        F.count(F.when(F.col("_evidence"), 1)).alias("evidence"),
    )
    main = per_target.groupBy(*by).agg(
        F.count("*").alias("n_targets"),
        n.alias("n_pairs"),
        F.min("lo").alias("min_year"),
        F.max("hi").alias("max_year"),
        ratio(F.sum("advanced"), n).alias("balance"),
        F.sum("evidence").alias("n_pairs_with_evidence"),
        ratio(F.sum("evidence"), n).alias("fraction_pairs_with_evidence"),
    )
    diseases = (
        dimension_join(cohort.select("split", "disease_id").distinct(), names, ["disease_id"])
        .groupBy(*by)
        .agg(F.count("*").alias("n_diseases"))
    )
    return main.join(diseases, by)


# Labels of the presence groups.
_PRESENCE_LABELS = {
    "phase_2": "prior phase 2+ trials",
    "outcome": "advanced beyond phase 2",
    "no_data": "no evidence",
}


def presence_groups(cohort: DataFrame) -> DataFrame:
    """Sorted array of the feature groups present for each pair, plus prior trials and no data."""
    evidence = pair_evidence(cohort.columns)
    by_group: dict[str, list[str]] = {}
    for name in evidence:
        by_group.setdefault("__".join(name.split("__")[:2]), []).append(name)

    def positive(names: list[str]) -> Column:
        return F.greatest(F.lit(False), *[F.coalesce(F.col(c) > 0, F.lit(False)) for c in names])

    flags = {group: positive(names) for group, names in by_group.items()}
    for entity in ("target", "disease"):
        flags[f"{entity}__phase_2"] = F.coalesce(
            F.col(f"{entity}__clinical__phase_max__reached") > 2, F.lit(False)
        )
    flags["target_disease__outcome"] = F.coalesce(F.col(OUTCOME), F.lit(False))
    flags["target_disease__no_data"] = ~positive(evidence)
    present = F.array_compact(F.array(*[F.when(flag, F.lit(g)) for g, flag in flags.items()]))
    return cohort.select(*PAIR_KEY, F.array_sort(present).alias("feature_groups"))


def presence_label(group: Column) -> Column:
    entity, name = F.split(group, "__")[0], F.split(group, "__")[1]
    text = F.concat(name, F.lit(" evidence"))
    for code, label in _PRESENCE_LABELS.items():
        text = F.when(name == code, F.lit(label)).otherwise(text)
    owner = F.when(entity == "target_disease", F.lit("pair")).otherwise(entity)
    return F.concat(owner, F.lit(" has "), F.replace(text, F.lit("_"), F.lit(" ")))


def feature_presence(cohort: DataFrame) -> DataFrame:
    """Pairs per feature group."""
    return (
        presence_groups(cohort)
        .select(F.explode("feature_groups").alias("feature_group"))
        .groupBy("feature_group")
        .agg(F.count("*").alias("n_pairs"))
        .withColumn("feature_group_label", presence_label(F.col("feature_group")))
    )


def presence_combinations(cohort: DataFrame) -> DataFrame:
    """Pairs per combination of groups, the sizes behind an intersection plot."""
    return presence_groups(cohort).groupBy("feature_groups").agg(F.count("*").alias("n_pairs"))


def describe(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a small result table, over finite values, and how
    many infinite ones there are beside them."""
    x = F.when(F.abs(value) < F.lit(float("inf")), F.col(value))
    return values.groupBy(*by).agg(
        F.count(x).alias("count"),
        F.count(F.when(F.abs(value) == F.lit(float("inf")), 1)).alias("n_infinite"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        *[F.percentile(x, q).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)],
        F.max(x).alias("max"),
    )
