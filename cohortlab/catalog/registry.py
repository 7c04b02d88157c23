"""Registration of queries and assembly of their reference SQL from shared views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.catalog.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(body: str) -> str:
    """Prefix a statement with the views it uses, directly or through other views."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        for name in re.findall(r"\bv_\w+", pending.pop()):
            if name not in needed:
                needed.add(name)
                pending.append(VIEWS[name])
    ctes = ",\n".join(f"{n} AS ({text})" for n, text in VIEWS.items() if n in needed)
    if not ctes:
        return body
    statement = f"SELECT * FROM ({body})" if body.lstrip().startswith("WITH") else body
    return f"WITH {ctes}\n{statement}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison; adding zero turns ``-0.0`` into ``0.0``."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )
