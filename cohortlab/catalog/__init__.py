"""Named queries over the supplied tables, each with its reference SQL where SQL can say it."""

from __future__ import annotations

from cohortlab.catalog.registry import ORACLES, QUERIES
from cohortlab.catalog import (  # noqa: F401  (importing a module registers its queries)
    q_evidence,
    q_features,
    q_cohort,
    q_ranking,
    q_metrics,
    q_models,
    q_reports,
)

__all__ = ["ORACLES", "QUERIES"]
