"""Domain tables derived from the supplied order tables.

Parts stand for targets, nations and regions for diseases, line items for evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.config import YearBounds
from cohortlab.functions.frames import dimension_join

BOUNDS = YearBounds(1996, 2000)
SOURCES = [
    ("genetic_association", "clingen"),
    ("genetic_association", "curated"),
    ("genetic_association", "eva"),
    ("genetic_association", "gene_burden"),
    ("genetic_association", "omim"),
    ("genetic_association", "orphanet"),
    ("genetic_association", "ot_genetics_portal"),
    ("literature", "europepmc"),
    ("animal_model", "impc"),
    ("known_drug", "chembl"),
]
PRIORITY_SOURCE = {
    "1-URGENT": "eva",
    "2-HIGH": "orphanet",
    "5-LOW": "ot_genetics_portal",
    "4-NOT SPECIFIED": "gene_burden",
}
# Evidence names per modality, as in the table of bucket assignments.
MODALITY_EVIDENCE = {
    "SM": [
        "Approved Drug", "Advanced Clinical", "Phase 1 Clinical", "Structure with Ligand",
        "High-Quality Ligand", "High-Quality Pocket", "Med-Quality Pocket", "Druggable Family",
    ],
    "AB": [
        "Approved Drug", "Advanced Clinical", "Phase 1 Clinical", "UniProt loc high conf",
        "GO CC high conf", "UniProt loc med conf", "UniProt SigP or TMHMM", "GO CC med conf",
        "Human Protein Atlas loc",
    ],
    "PR": [
        "Advanced Clinical", "Phase 1 Clinical", "Literature", "UniProt Ubiquitination",
        "Database Ubiquitination", "Half-life Data", "Small Molecule Binder",
    ],
    "OC": ["Approved Drug", "Advanced Clinical", "Phase 1 Clinical"],
}
MODALITY_ORDER = ["SM", "AB", "PR", "OC"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    # Orders find their nations while they are few and narrow. They are hashed, so items are not sorted.
    placed = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderpriority", "n_nationkey", "n_regionkey")
    )
    rows = items.join(placed.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    clinical = F.col("l_linestatus") == "F"
    flag = F.col("l_returnflag")
    genetic = F.lit("clingen")
    for priority, source in PRIORITY_SOURCE.items():
        genetic = F.when(F.col("o_orderpriority") == priority, F.lit(source)).otherwise(genetic)
    phase = F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber")).otherwise(1)
    return rows.select(
        F.concat(F.lit("T"), "l_partkey").alias("targetId"),
        F.when(F.col("l_orderkey") % 10 == 0, F.concat(F.lit("A"), "n_regionkey"))
        .otherwise(F.concat(F.lit("D"), "n_nationkey"))
        .alias("diseaseId"),
        F.when(clinical, "known_drug")
        .when(flag == "A", "genetic_association")
        .when(flag == "R", "literature")
        .otherwise("animal_model")
        .alias("datatypeId"),
        F.when(clinical, "chembl")
        .when(flag == "R", "europepmc")
        .when(flag != "A", "impc")
        .otherwise(genetic)
        .alias("datasourceId"),
        F.round(F.col("l_discount") * 10, 1).alias("score"),
        F.when(F.col("l_orderkey") % 3 != 0, F.array(F.col("l_orderkey").cast("string"))).alias("literature"),
        F.when(F.col("l_orderkey") % 2 == 0, F.year("l_shipdate")).alias("publicationYear"),
        F.when(clinical, phase.cast("double")).alias("clinicalPhase"),
        F.when(clinical, F.col("l_shipdate").cast("date")).alias("studyStartDate"),
    )


def publication_years(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pmid"), F.year("o_orderdate").alias("pub_year")
    )


def targets(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    modality = F.element_at(
        F.array(*[F.lit(m) for m in MODALITY_ORDER]), (F.col("p_partkey") % 4 + 1).cast("int")
    )
    name = F.lit(None).cast("string")
    for code, names in MODALITY_EVIDENCE.items():
        picked = F.element_at(
            F.array(*[F.lit(n) for n in names]), (F.col("p_size") % len(names) + 1).cast("int")
        )
        name = F.when(modality == code, picked).otherwise(name)
    entry = F.struct(
        name.alias("id"), (F.col("p_partkey") % 3 != 0).alias("value"), modality.alias("modality")
    )
    return part.select(
        F.concat(F.lit("T"), "p_partkey").alias("id"),
        F.col("p_name").alias("approvedSymbol"),
        F.array(entry).alias("tractability"),
    )


def prioritisation(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        F.concat(F.lit("T"), "p_partkey").alias("targetId"),
        (size / 50.0).alias("tissueSpecificity"),
        ((F.col("p_retailprice") - 900) / 100).alias("tissueDistribution"),
        F.when(key % 7 != 0, size / 100.0).alias("geneticConstraint"),
        F.when(key % 5 != 0, (key % 10) / 10.0).alias("mouseKOScore"),
    )


def diseases(spark: SparkSession, sf: str) -> DataFrame:
    region_id = F.concat(F.lit("A"), "n_regionkey")
    nations = table(spark, sf, "nation").select(
        F.concat(F.lit("D"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.array(region_id).alias("ancestors"),
        F.array(region_id).alias("therapeuticAreas"),
        F.struct(F.lit(False).alias("isTherapeuticArea")).alias("ontology"),
    )
    own_id = F.concat(F.lit("A"), "r_regionkey")
    regions = table(spark, sf, "region").select(
        own_id.alias("id"),
        F.col("r_name").alias("name"),
        F.array().cast("array<string>").alias("ancestors"),
        F.array(own_id).alias("therapeuticAreas"),
        F.struct(F.lit(True).alias("isTherapeuticArea")).alias("ontology"),
    )
    return nations.unionByName(regions)


def associations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Best score per (target, nation), and per (target, region)."""
    rows = evidence(spark, sf)
    parents = diseases(spark, sf).select(
        F.col("id").alias("diseaseId"), F.col("therapeuticAreas")[0].alias("region")
    )
    direct = (
        rows.filter(F.col("diseaseId").startswith("D"))
        .groupBy("targetId", "diseaseId")
        .agg(F.max("score").alias("score"))
    )
    indirect = (
        dimension_join(rows, parents, ["diseaseId"])
        .groupBy("targetId", F.col("region").alias("diseaseId"))
        .agg(F.max("score").alias("score"))
    )
    return direct, indirect
