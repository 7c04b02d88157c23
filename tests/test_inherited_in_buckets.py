"""Inherited evidence of buckets too large to be broadcast is found in place."""

from test_layout import exchanges

from pyspark.sql import functions as F

from cohortlab.functions.frames import fits_broadcast, materialize
from cohortlab.operators.ontology import aggregated_features
from cohortlab.plans.layout import TargetLayout

SCORE, PHASE = "target_disease__literature__europepmc", "target__clinical__phase_max__reached"


def test_no_exchange_without_a_broadcast(spark, tmp_path):
    rows = spark.range(12_000).select(
        F.concat(F.lit("T"), F.col("id") % 300).alias("target_id"), F.concat(F.lit("D"), F.floor(F.col("id") / 300) % 8).alias("disease_id"),
        (F.lit(1996) + F.floor(F.col("id") / 2400)).cast("int").alias("year"),
        F.rand(3).alias(SCORE), (F.col("id") % 4).cast("int").alias(PHASE),
    )
    listed = spark.createDataFrame([("D1", ["D0", "D5"]), ("D2", ["D0"]), ("D3", None)], "id string, ancestors array<string>")
    diseases = materialize(listed.coalesce(1))
    written = TargetLayout(str(tmp_path / "layout"), buckets=12).write_features(rows)
    known = {(r[0], r[1], r[2]): (r[3], r[4]) for r in written.rows.collect()}
    above = {"D1": ["D0", "D5"], "D2": ["D0"]}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        assert fits_broadcast(diseases) and not fits_broadcast(written.even)
        found = aggregated_features(written.even, diseases)
        assert exchanges(found) == []
        got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(known) == 12_000 and got == {
        (t, d, y): (max(known[k][0] for k in [(t, d, y), *((t, a, y) for a in above.get(d, []))] if k in known), phase)
        for (t, d, y), (_, phase) in known.items()
    }
