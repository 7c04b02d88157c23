"""Column naming: snake case, entity prefixes and the feature-name grammar.

A feature is called ``<entity>__<group>__<name>``; the name alone says which entity it
describes and whether it may change over time.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE_KEY = ["target_id", "disease_id", "year"]
PAIR_KEY = ["target_id", "disease_id"]
OUTCOME = "target_disease__outcome__advanced"
TRANSITION_TIME = "target_disease__time__transition"
PAIR_PHASE = "target_disease__clinical__phase_max__reached"
TARGET_PHASE = "target__clinical__phase_max__reached"
DISEASE_PHASE = "disease__clinical__phase_max__reached"


class Feature(NamedTuple):
    feature: str
    entity: str
    kind: str


def snake_case(name: str) -> str:
    """Every capital but a leading one opens a new word, so ``KO`` becomes ``k_o``."""
    return name[:1].lower() + re.sub("[A-Z]", lambda m: "_" + m.group().lower(), name[1:])


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def prefix_columns(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def phase_feature_name(column: str) -> str:
    """``clinical_phase_2_reached`` style names to ``target_disease__clinical__phase2__reached``."""
    stage = re.fullmatch(r"clinical_phase_?(\d|max)_reached", column).group(1)
    label = "phase_max" if stage == "max" else f"phase{stage}"
    return f"target_disease__clinical__{label}__reached"


def parse_feature(name: str) -> Feature | None:
    """Entity and kind of a feature, or None if the name is outside the grammar."""
    entity = name.split("__")[0]
    if entity == "target_disease":
        static = name.startswith("target_disease__genetic_association__")
    elif entity in ("target", "disease"):
        static = "__clinical__" not in name
    else:
        return None
    return Feature(name, entity, "static" if static else "temporal")


def feature_info(names: list[str], strict: bool = False) -> list[Feature]:
    parsed = [(n, parse_feature(n)) for n in names]
    unknown = [n for n, f in parsed if f is None]
    if strict and unknown:
        raise ValueError(f"names outside the feature grammar: {unknown}")
    return [f for _, f in parsed if f is not None]


def features_of_kind(names: list[str], kind: str, entity: str | None = None) -> list[str]:
    return [
        f.feature for f in feature_info(names) if f.kind == kind and entity in (None, f.entity)
    ]


def pair_evidence(names: list[str]) -> list[str]:
    """Pair features that carry evidence: not clinical, not time, not outcome."""
    return [n for n in names if re.match(r"target_disease__(?!clinical__|time__|outcome__)", n)]


def with_feature_info(df: DataFrame, column: str) -> DataFrame:
    """The same grammar over a column of names; rows outside it are dropped."""
    name = F.col(column)
    entity = F.split(name, "__")[0]
    static = F.when(
        entity == "target_disease", name.startswith("target_disease__genetic_association__")
    ).otherwise(~name.contains("__clinical__"))
    return (
        df.withColumn("entity", entity)
        .filter(F.col("entity").isin("target", "disease", "target_disease"))
        .withColumn("kind", F.when(static, "static").otherwise("temporal"))
    )


def method_parts(method: Column) -> dict[str, Column]:
    """Model name and limit encoded in a ranking-method name; NULL where absent."""
    model = F.regexp_extract(method, r"^target_disease__model__(.+)__limit_\d+$", 1)
    limit = F.regexp_extract(method, r"__limit_(\d+)$", 1)
    return {
        "model_name": F.when(model != "", model),
        "limit": F.when(limit != "", limit).cast("int"),
    }
