"""All core queries by name, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import corpus_queries, evaluation_queries, inference_queries, pipeline_queries, report_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for module in (corpus_queries, evaluation_queries, inference_queries, pipeline_queries, report_queries):
    QUERIES.update(module.QUERIES)
    ORACLE.update(module.ORACLE)
