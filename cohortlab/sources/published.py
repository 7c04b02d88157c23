"""Published versions of a set of tables.

A version is written to a folder of its own. Only when every table is written and its contracts hold
is it published, by one rename that puts its manifest in place. Readers go by manifests: a version
that is not published, because its job failed or was killed, is never seen, and one that is pinned
by number stays as it is while later ones appear.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Others may publish at the same time; each loser tries the next number.
ATTEMPTS = 100


@dataclass(frozen=True)
class PublishedTables:
    """Versions below ``root``, a path of any file system that Spark reads."""

    root: str

    def _files(self, spark: SparkSession):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder

    def versions(self, spark: SparkSession) -> list[int]:
        """Published numbers in ascending order."""
        files, folder = self._files(spark)
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def latest(self, spark: SparkSession) -> int | None:
        return max(self.versions(spark), default=None)

    def publish(self, spark: SparkSession, build: Callable[[str], Mapping[str, DataFrame]]) -> int:
        """Let ``build`` write tables into a new folder, each below its name, and publish them.

        ``build`` returns the tables as read back. If it raises, nothing is published and the
        folder stays unused.
        """
        name = uuid.uuid4().hex
        tables = build(f"{self.root}/data/{name}")
        manifest = {"folder": name, "tables": {table: df.schema.json() for table, df in tables.items()}}
        return self._commit(spark, json.dumps(manifest))

    def _commit(self, spark: SparkSession, text: str) -> int:
        files, folder = self._files(spark)
        hadoop = spark._jvm.org.apache.hadoop.fs
        files.mkdirs(folder)
        draft = hadoop.Path(folder, f".{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = hadoop.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration())
        keep = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        keep[0] = hadoop.Options.Rename.NONE
        for number in range((self.latest(spark) or 0) + 1, (self.latest(spark) or 0) + 1 + ATTEMPTS):
            target = hadoop.Path(folder, f"{number:08d}.json")
            try:
                # Fails if the number is taken: a manifest is never replaced.
                context.rename(draft, target, keep)
                return number
            except Exception as error:
                if not files.exists(target):
                    raise error
        raise RuntimeError("too many versions were published at the same time")

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict:
        """The manifest of a version, by default of the latest one."""
        number = self.latest(spark) if version is None else version
        if number is None or number not in self.versions(spark):
            raise LookupError(f"version {number} is not published below {self.root}")
        text = spark.read.option("wholetext", True).text(f"{self.root}/manifests/{number:08d}.json").first()["value"]
        return json.loads(text)

    def read(self, spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
        """A table of a version, by default of the latest one."""
        found = self.manifest(spark, version)
        if table not in found["tables"]:
            raise LookupError(f"no table {table!r} in {sorted(found['tables'])}")
        schema = StructType.fromJson(json.loads(found["tables"][table]))
        return spark.read.schema(schema).parquet(f"{self.root}/data/{found['folder']}/{table}")
