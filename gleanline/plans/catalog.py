"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog_check, catalog_filter, catalog_rank, catalog_resolve, catalog_serve, catalog_sources, catalog_text, catalog_tracking  # noqa: F401
from .registry import ORACLES, QUERIES, Tables  # noqa: F401


def shortlist(spark: SparkSession, folder: str) -> DataFrame:
    return catalog_rank.shortlist(Tables(spark, folder))
