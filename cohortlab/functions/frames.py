"""Plan-level helpers: written tables, size-checked broadcasts and joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS_CONF = "spark.cohortlab.salts"
DEFAULT_SALTS = 32
#: A key is hot from this share of a partition's even part on: at most 4 x partitions keys are.
HOT_SHARE = 4
#: Narrow rows that one task takes where they become wide there.
TASK_ROWS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only made up in local mode, where driver and executors are one
    process; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_scratch()


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="cohortlab-")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, below one folder per application."""
    return f"{scratch_dir(spark)}/cohortlab-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost
    executors, and gives the planner true sizes."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_limit(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    text = text.lower().removesuffix("b")
    return int(text[:-1]) * units[text[-1]] if text[-1:] in units else int(text)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan (from file sizes upwards)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    return 0 <= estimated_bytes(df) <= broadcast_limit(df.sparkSession)


def salt_count(spark: SparkSession) -> int:
    return int(spark.conf.get(SALTS_CONF, str(DEFAULT_SALTS)))


def row_salt(rows: DataFrame, columns: list[str], salts: int) -> Column:
    """A slice number computed from the row and the number of its partition, so that retried tasks
    agree and equal rows are spread as well. Map columns count by their JSON text."""
    kinds = dict(rows.dtypes)
    parts = [F.to_json(c) if kinds[c].startswith("map<") else F.col(c) for c in columns]
    return F.pmod(F.xxhash64(*parts, F.spark_partition_id()), F.lit(salts)).cast("int")


def hot_keys(facts: DataFrame, on: list[str], share: int) -> DataFrame:
    """Keys with more than 1 / ``share`` of all rows: fewer than ``share`` of them, as a written table."""
    counted = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    # Counts are spread over the keys' shuffle; only sums meet in one row.
    counted = materialize(counted)
    total = counted.agg(F.sum("_n")).first()[0] or 0
    return materialize(counted.where(F.col("_n") * share > F.lit(total)).select(*on))


def dealt_evenly(facts: DataFrame, on: list[str]) -> bool:
    """Whether rows can be dealt by these columns: no key holds far more than a partition's even part."""
    share = HOT_SHARE * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return hot_keys(facts, on, share).isEmpty()


def partitions_for(*tables: DataFrame, on: str) -> bool | int:
    """How many partitions to deal written tables to by this column, or False if a key of one of them holds too
    many rows.

    A number that is given is kept: adaptive execution would join partitions by the size of their narrow
    rows, and tasks would grow with the input. With fewer than shuffles have, a later join would deal the
    rows again. True leaves small tables to Spark.
    """
    if not all(dealt_evenly(table, [on]) for table in tables):
        return False
    spark = tables[0].sparkSession
    rows = max(table.count() for table in tables)
    if rows <= TASK_ROWS * spark.sparkContext.defaultParallelism:
        return True
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // TASK_ROWS))


def dimension_join(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner",
                   spread_by: list[str] | None = None) -> DataFrame:
    """Join many facts to few rows per key, safe when one key holds most facts.

    Catalyst's estimate of a joined or aggregated dimension can be far too high. Where it exceeds
    the broadcast threshold, the dimension is written, which also keeps it from being computed
    again, and its true size decides. A small one is broadcast. For a larger one the facts are
    counted by key: rows of hot keys are spread over salts by the hash of ``spread_by`` (default:
    all other columns) and their dimension rows repeated once per salt; all others are joined
    plainly. Adaptive execution may split further, as the salt is dropped and nothing downstream
    relies on the partitioning of the join. ``facts`` is then read twice.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"the dimension side cannot be kept whole in a {how!r} join")
    if not fits_broadcast(dimension):
        dimension = materialize(dimension)
    if fits_broadcast(dimension):
        return facts.join(F.broadcast(dimension), on, how)
    salts = salt_count(facts.sparkSession)
    share = HOT_SHARE * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    hot = hot_keys(facts, on, share)
    if hot.isEmpty():
        return facts.join(dimension, on, how)
    marks = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    spread = spread_by or [c for c in facts.columns if c not in on]
    salted = facts.join(marks, on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), row_salt(facts, spread, salts)).otherwise(F.lit(0))
    )
    copies = F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0))
    repeated = dimension.join(marks, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies)))
    return salted.drop("_hot").join(repeated.drop("_hot"), [*on, "_salt"], how).drop("_salt")
