"""All queries of the reference's operators over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import markup_queries, package_queries, quality_queries, sequence_queries, stage_queries, text_queries

_MODULES = (text_queries, sequence_queries, markup_queries, package_queries, quality_queries, stage_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
