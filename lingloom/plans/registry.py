"""Every registered query of the parallel-text library and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_checks, queries_flow, queries_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = queries_text.QUERIES | queries_flow.QUERIES | queries_checks.QUERIES
ORACLE_SQL: dict[str, str] = queries_text.ORACLE_SQL | queries_flow.ORACLE_SQL | queries_checks.ORACLE_SQL
