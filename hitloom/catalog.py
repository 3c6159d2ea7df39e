"""All queries of the point-cloud operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hitloom.plans import clusters, graphs, losses, matched, metrics, objects, scalars, scores, selections, summaries  # noqa: F401  they register their queries
from hitloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "analyse"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
