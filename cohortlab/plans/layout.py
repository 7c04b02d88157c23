"""Evidence and features bucketed by target: one exchange when they are written, none when they are used.

Pairs of a target share its bucket, so transitions, as-of features, cumulative maxima and evidence inherited
within a target all find their rows in place. What crosses targets (the yearly phases of diseases) is
computed from whole tables first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortlab.config import CohortSpec
from cohortlab.functions.frames import materialize
from cohortlab.operators import features as ft
from cohortlab.operators.cohort import cohort_base, select_cohort
from cohortlab.operators.ontology import aggregated_features
from cohortlab.sources.bucketed import BUCKETS, Bucketed, bucket_count, bucket_overflow, open_bucketed, write_bucketed


@dataclass(frozen=True)
class TargetLayout:
    """Tables below ``path``: dated evidence, stages and features by target, yearly phases of diseases.

    ``buckets`` is the least number; larger tables have more.
    """

    path: str
    buckets: int = BUCKETS

    def write_evidence(self, dated: DataFrame, stages: DataFrame) -> None:
        """``dated`` and ``stages`` are written tables; a target too large in either stands apart in both."""
        buckets = bucket_count(self.buckets, dated, stages)
        over = [bucket_overflow(table, "targetId", buckets) for table in (dated, stages)]
        hot = materialize(over[0].union(over[1]).distinct())
        write_bucketed(dated, "targetId", f"{self.path}/evidence", buckets, hot)
        write_bucketed(stages, "targetId", f"{self.path}/stages", buckets, hot)
        ft.yearly_phases(stages, "disease").write.parquet(f"{self.path}/disease_phases")

    def features(self, spark: SparkSession, sources: Sequence[ft.Source]) -> DataFrame:
        """Temporal features straight from the buckets, without an exchange by pair."""
        dated, stages = (open_bucketed(spark, f"{self.path}/{name}") for name in ("evidence", "stages"))
        phases = spark.read.parquet(f"{self.path}/disease_phases")
        even = ft.temporal_features(dated.even, stages.even, sources, phases, colocated=True)
        return even.unionByName(ft.temporal_features(dated.hot, stages.hot, sources, phases))

    def write_features(self, features: DataFrame) -> Bucketed:
        """Write a feature table by target; it is written plainly first, as its targets are counted."""
        features = materialize(features)
        return write_bucketed(features, "target_id", f"{self.path}/features", bucket_count(self.buckets, features))

    def read_features(self, spark: SparkSession) -> Bucketed:
        return open_bucketed(spark, f"{self.path}/features")


def cohort_in_place(features: Bucketed, spec: CohortSpec) -> DataFrame:
    """``modeling_cohort`` of features bucketed by target: no exchange but for targets standing apart."""
    first, last = spec.min_transition_year, spec.max_transition_year
    return features.map(lambda rows: select_cohort(cohort_base(rows, spec.phase, first, last), spec))


def inherited_in_place(features: Bucketed, diseases: DataFrame) -> DataFrame:
    """``aggregated_features`` of features bucketed by target: ancestors' rows of a target share its bucket."""
    return features.map(lambda rows: aggregated_features(rows, diseases))
