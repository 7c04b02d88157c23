"""Registered queries of the operators, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import bpe, decontaminate, fingerprint, infill, jaccard_join, langid, pii, ppm, prefix_trie, repeats, sharding, toxicity, warc
from cohortlab.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


@register
def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit(*warc.replicas(read(spark, sf_dir, "pages")))


ORACLES["op2_merkle_fixity"] = warc.ORACLE


@register
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(read(spark, sf_dir, "documents"))


@register
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@register
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest_documents(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@register
def op6_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(read(spark, sf_dir, "documents"))


@register
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(read(spark, sf_dir, "documents"))


@register
def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest_documents(read(spark, sf_dir, "documents"))


ORACLES["op11_infill"] = infill.ORACLE


@register
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest_documents(read(spark, sf_dir, "documents"))


ORACLES["op12_substring_dedup"] = repeats.ORACLE


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = prefix_trie.ORACLE


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
