"""Tables bucketed by target: same rows as the plain plans, no exchange, hot targets apart."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortlab.catalog import inputs
from cohortlab.functions.frames import materialize
from cohortlab.operators import cohort as ch
from cohortlab.operators import features as ft
from cohortlab.operators import ontology
from cohortlab.plans.layout import TargetLayout, cohort_in_place, inherited_in_place
from cohortlab.sources import fixtures as fx
from cohortlab.sources.bucketed import open_bucketed, write_bucketed

HOT = "T3"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (?:hash|range|roundrobin|Single)\w*\([^)]*\)", plan)


def same(left, right):
    left = left.select(*right.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture(scope="module")
def known(spark):
    """Dated evidence of which one target holds most rows."""
    temporal, stages = inputs.dated(spark, SMALL)
    target = F.when(F.xxhash64("targetId", "diseaseId") % 3 != 0, F.lit(HOT)).otherwise(F.col("targetId"))
    return [
        materialize(table.withColumn("targetId", target).groupBy(*key).agg(*[F.max(c).alias(c) for c in table.columns if c not in key]))
        for table, key in (
            (temporal, ["targetId", "diseaseId", "datatypeId", "datasourceId", "year"]), (stages, ["targetId", "diseaseId", "year"]),
        )
    ]


@pytest.fixture(scope="module")
def layout(spark, known, tmp_path_factory):
    made = TargetLayout(str(tmp_path_factory.mktemp("layout")), buckets=12)
    made.write_evidence(*known)
    made.write_features(made.features(spark, fx.SOURCES))
    return made


def test_features_equal_the_plain_plan(spark, known, layout):
    plain = materialize(ft.temporal_features(*known, fx.SOURCES))
    assert plain.count() > 0
    assert same(layout.features(spark, fx.SOURCES), plain)
    assert same(layout.read_features(spark).rows, plain)


def test_hot_target_stands_apart(spark, layout):
    written = layout.read_features(spark)
    assert [r[0] for r in written.hot.select("target_id").distinct().collect()] == [HOT]
    assert written.even.where(F.col("target_id") == HOT).isEmpty() and not written.even.isEmpty()
    for name in ("evidence", "stages"):
        assert HOT in [r[0] for r in open_bucketed(spark, f"{layout.path}/{name}").hot.select("targetId").distinct().collect()]


def test_cohort_in_place(spark, layout):
    written = layout.read_features(spark)
    assert same(cohort_in_place(written, inputs.TRAINING), ch.modeling_cohort(written.rows, inputs.TRAINING))
    assert exchanges(ch.modeling_cohort(written.even, inputs.TRAINING)) == []
    assert exchanges(ch.modeling_cohort(written.hot, inputs.TRAINING)) != []


def test_inherited_in_place(spark, layout):
    written, diseases = layout.read_features(spark), fx.diseases(spark, SMALL)
    assert same(inherited_in_place(written, diseases), ontology.aggregated_features(materialize(written.rows), diseases))
    assert exchanges(ontology.aggregated_features(written.even, diseases)) == []


def test_features_from_buckets_have_no_exchange_by_pair(spark, layout):
    dated, stages = (open_bucketed(spark, f"{layout.path}/{name}") for name in ("evidence", "stages"))
    phases = spark.read.parquet(f"{layout.path}/disease_phases")
    found = exchanges(ft.temporal_features(dated.even, stages.even, fx.SOURCES, phases, colocated=True))
    # Only the few yearly phases of diseases are dealt anew.
    assert not [e for e in found if "target" in e], found


def test_null_keys_odd_names_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "`a key` string, n int")
    made = write_bucketed(rows, "a key", str(tmp_path / "nulls"), 4)
    assert same(made.rows, rows)
    empty = write_bucketed(rows.limit(0), "a key", str(tmp_path / "empty"), 4)
    assert empty.rows.count() == 0 and empty.rows.dtypes == rows.dtypes
