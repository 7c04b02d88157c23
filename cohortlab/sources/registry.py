"""Versioned Parquet datasets addressed by logical name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.frames import dimension_join
from cohortlab.functions.naming import snake_columns

# Logical names, and the one physical name that differs in release 23.06.
TABLES = (
    "evidence",
    "targets",
    "diseases",
    "targetPrioritisation",
    "associationByOverallDirect",
    "associationByOverallIndirect",
)
VERSIONS = ("23.06", "23.09", "23.12")
RENAMED = {("23.06", "targetPrioritisation"): "targetsPriorisation"}


@dataclass(frozen=True)
class Registry:
    """Datasets below ``root/<version>/<table>``."""

    root: str

    def path(self, version: str, table: str) -> str:
        if version not in VERSIONS:
            raise NotImplementedError(f"version {version!r} is not one of {VERSIONS}")
        if table not in TABLES:
            raise KeyError(table)
        return f"{self.root}/{version}/{RENAMED.get((version, table), table)}"

    def read(self, spark: SparkSession, version: str, table: str) -> DataFrame:
        return spark.read.parquet(self.path(version, table))


def read_publication_years(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pmid bigint, pub_year int").parquet(path)


def load_targets(targets: DataFrame, prioritisation: DataFrame | None = None) -> DataFrame:
    """Targets, with their prioritisation columns where known."""
    if prioritisation is None:
        return targets
    return dimension_join(targets, prioritisation.withColumnRenamed("targetId", "id"), ["id"], "left")


def association_scores(direct: DataFrame, indirect: DataFrame) -> DataFrame:
    """Direct and indirect score per pair; a pair may have only one of them."""
    key = ["targetId", "diseaseId"]
    return snake_columns(
        direct.select(*key, F.col("score").alias("directScore")).join(
            indirect.select(*key, F.col("score").alias("indirectScore")), key, "full"
        )
    )
