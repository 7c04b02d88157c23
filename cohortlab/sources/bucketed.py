"""Tables laid out by one key, so that later joins and groupings on it need no exchange.

Rows are dealt to Spark buckets by the hash of the key once, when they are written. A key with far more
rows than a bucket's even part would make one task long each time the table is read, and no later plan
could split it; rows of such keys stand in a plain table beside the buckets. ``Bucketed.map`` applies work
that never mixes keys to both parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlab.functions.frames import HOT_SHARE, hot_keys

BUCKETS = 256
#: Rows of a bucket, which is read by one task.
BUCKET_ROWS = 250_000


@dataclass(frozen=True)
class Bucketed:
    """``even`` is bucketed by ``key``, ``hot`` holds all rows of keys too large for a bucket."""

    key: str
    even: DataFrame
    hot: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.even.unionByName(self.hot)

    def map(self, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` on each part. Right for work whose rows of one key depend on rows of that key only."""
        return work(self.even).unionByName(work(self.hot))


def bucket_overflow(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Keys with too many rows for a bucket: fewer than ``HOT_SHARE`` per bucket, as a written table."""
    return hot_keys(df, [key], HOT_SHARE * buckets)


def bucket_count(least: int, *tables: DataFrame) -> int:
    """As many buckets as keep the written tables' buckets small, so that tasks do not grow with the tables."""
    return max(least, *(-(-table.count() // BUCKET_ROWS) for table in tables))


def write_bucketed(df: DataFrame, key: str, path: str, buckets: int = BUCKETS, hot: DataFrame | None = None) -> Bucketed:
    """Write ``df`` below ``path``, a new folder, with one file per bucket, and return it as read back.

    ``df`` is read twice and should be a written table. Rows without a key share one bucket, or are hot
    together. Tables that are joined with each other name the same ``hot`` keys, by default those of ``df``.
    """
    hot = bucket_overflow(df, key, buckets) if hot is None else hot
    hot = F.broadcast(hot.select(F.col(hot.columns[0]).alias("_key")))
    is_hot = F.col(key).eqNullSafe(F.col("_key"))
    df.join(hot, is_hot, "left_semi").write.parquet(f"{path}/hot")
    # The writer deals rows to buckets by the hash that repartition uses, so each task fills one file.
    even = df.join(hot, is_hot, "left_anti").repartition(buckets, key)
    name = _table_name()
    even.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/even").saveAsTable(name)
    # Last: a folder without a layout is an export that did not finish.
    layout = json.dumps({"key": key, "buckets": buckets, "schema": df.schema.jsonValue()})
    df.sparkSession.createDataFrame([(layout,)], "value string").coalesce(1).write.text(f"{path}/layout")
    return open_bucketed(df.sparkSession, path)


def open_bucketed(spark: SparkSession, path: str) -> Bucketed:
    """Read what ``write_bucketed`` wrote, in any session. Buckets are known to the catalog only, so the files
    are declared there as an external table, which owns nothing."""
    layout = json.loads(spark.read.text(f"{path}/layout").first()["value"])
    schema = StructType.fromJson(layout["schema"])
    name = _table_name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout['key']}`) SORTED BY (`{layout['key']}`) "
        f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/even'"
    )
    return Bucketed(layout["key"], spark.table(name), spark.read.schema(schema).parquet(f"{path}/hot"))


def _table_name() -> str:
    return f"bucketed_{uuid.uuid4().hex}"
