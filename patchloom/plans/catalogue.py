"""All registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, patches, reports, retrieval

FAMILIES = (retrieval, patches, evaluation, reports)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, f in family.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for family in FAMILIES for name, s in family.oracle_sql().items()}
