"""Published versions and resumed sweeps: what is lost, kept and written again."""

import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortlab.config import StudyConfig
from cohortlab.operators import contracts as ct
from cohortlab.operators.quality import QualityError
from cohortlab.plans import export as ep
from cohortlab.plans.study import finished_configs, resume_sweep
from cohortlab.sources import fixtures as fx
from cohortlab.sources.published import PublishedTables
from cohortlab.sources.registry import load_targets
from cohortlab.sources.sinks import write_table

AREAS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "all"]


def numbers(spark, value, n=5):
    return spark.range(n).select("id", F.lit(value).alias("v"))


def test_versions_are_pinned_and_numbered(spark, tmp_path):
    published = PublishedTables(str(tmp_path))
    assert published.latest(spark) is None
    with pytest.raises(LookupError):
        published.read(spark, "t")
    for value in (1, 2):
        assert published.publish(spark, lambda folder, v=value: {"t": write_table(numbers(spark, v), f"{folder}/t")}) == value
    assert published.versions(spark) == [1, 2]
    for version, value in ((None, 2), (1, 1), (2, 2)):
        assert {r.v for r in published.read(spark, "t", version).collect()} == {value}
    with pytest.raises(LookupError):
        published.read(spark, "other")
    with pytest.raises(LookupError):
        published.read(spark, "t", 3)


def test_a_killed_or_broken_export_leaves_the_old_version(spark, tmp_path):
    published = PublishedTables(str(tmp_path))
    published.publish(spark, lambda folder: {"t": write_table(numbers(spark, 1), f"{folder}/t")})

    def killed(folder):
        write_table(numbers(spark, 9), f"{folder}/t")
        raise KeyboardInterrupt

    def broken(folder):
        repeated = numbers(spark, 9).union(numbers(spark, 9))
        return {"t": write_table(repeated, f"{folder}/t", [ct.unique("id")])}

    for build, error in ((killed, KeyboardInterrupt), (broken, QualityError)):
        with pytest.raises(error):
            published.publish(spark, build)
        assert published.versions(spark) == [1]
        assert {r.v for r in published.read(spark, "t").collect()} == {1}


def test_publishing_at_the_same_time_loses_no_version(spark, tmp_path):
    published, inner = PublishedTables(str(tmp_path)), []

    def racing(folder):
        table = write_table(numbers(spark, 1), f"{folder}/t")
        inner.append(published.publish(spark, lambda other: {"t": write_table(numbers(spark, 2), f"{other}/t")}))
        return {"t": table}

    # The race is lost between the choice of a number and the rename as well.
    taken = published.latest
    outer = published.publish(spark, racing)
    assert (inner, outer, taken(spark)) == ([1], 2, 2)
    assert published._commit(spark, "{}") == 3
    object.__setattr__(published, "latest", lambda _: 1)
    assert published._commit(spark, "{}") == 4


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    tables = ep.EvidenceTables(
        fx.evidence(spark, SMALL), load_targets(fx.targets(spark, SMALL), fx.prioritisation(spark, SMALL)),
        fx.diseases(spark, SMALL), fx.publication_years(spark, SMALL),
    )
    published = PublishedTables(str(tmp_path_factory.mktemp("published")))
    assert ep.publish_features(spark, published, tables, fx.BOUNDS) == 1
    return published


def files_of(path):
    return {
        os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")
    }


def test_a_sweep_writes_only_what_is_missing(spark, features, tmp_path):
    late = features.read(spark, "temporal_features", 1)
    areas = features.read(spark, "therapeutic_areas")
    versions = {"23.10": late, "23.09": late.filter("year IS NULL OR year <= 1999")}
    configs = [StudyConfig("23.10", 1997, 1, 2, fx.BOUNDS), StudyConfig("23.09", 1997, 2, 2, fx.BOUNDS), StudyConfig("23.10", 1998, 1, 2, fx.BOUNDS)]
    output = str(tmp_path / "sweep")
    assert finished_configs(spark, output) == set()
    first = resume_sweep(spark, output, versions, areas, configs[:2], AREAS, (5, 10))
    assert {r[0] for r in first.select("version").distinct().collect()} == {"23.10", "23.09"}
    before = files_of(f"{output}/area_risk")
    full = resume_sweep(spark, output, versions, areas, configs, AREAS, (5, 10))
    after = files_of(f"{output}/area_risk")
    assert {k: after[k] for k in before} == before
    added = set(after) - set(before)
    assert len(added) == 1 and all("last_training_year=1998" in path for path in added)
    # Nothing is left to do: no file changes, and features are not even needed.
    again = resume_sweep(spark, output, {}, areas, configs, AREAS, (5, 10))
    assert files_of(f"{output}/area_risk") == after
    alone = resume_sweep(spark, str(tmp_path / "alone"), versions, areas, configs, AREAS, (5, 10))

    def rows(frame):
        return sorted((tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in frame.select(*sorted(frame.columns)).collect()))

    assert rows(full) == rows(again) == rows(alone)
    assert finished_configs(spark, output) == {("23.10", 1997, 1), ("23.09", 1997, 2), ("23.10", 1998, 1)}


def test_a_lost_sweep_is_written_again(spark, features, tmp_path):
    late, areas = features.read(spark, "temporal_features"), features.read(spark, "therapeutic_areas")
    config, output = StudyConfig("23.10", 1997, 1, 2, fx.BOUNDS), str(tmp_path / "sweep")
    whole = resume_sweep(spark, output, {"23.10": late}, areas, [config], AREAS, (5, 10)).count()
    # The partition is there, but its configuration was never listed as finished.
    spark.createDataFrame([], "version string, last_training_year int, window int").write.mode("overwrite").parquet(f"{output}/finished")
    assert finished_configs(spark, output) == set()
    assert resume_sweep(spark, output, {"23.10": late}, areas, [config], AREAS, (5, 10)).count() == whole
