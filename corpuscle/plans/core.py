"""Queries of the core's general corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.operators import incremental
from corpuscle.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_files(table(spark, d, "scan_runs"), table(spark, d, "scan_entries"), table(spark, d, "processing_state"))


P1_SQL = """
WITH latest AS (
  SELECT scope_key, arg_max(run_id, updated_at) AS run_id FROM scan_runs
  WHERE lower(trim(status)) IN ('complete', 'completed') GROUP BY scope_key
), cur AS (
  SELECT scope_key, source_path, nullif(lower(trim(file_hash)), '') AS h, file_size_bytes AS s, modified_at AS m
  FROM scan_entries SEMI JOIN latest USING (scope_key, run_id)
  QUALIFY row_number() OVER (PARTITION BY scope_key, source_path ORDER BY updated_at DESC) = 1
), done AS (
  SELECT source_path, nullif(lower(trim(file_hash)), '') AS h, file_size_bytes AS s, modified_at AS m
  FROM processing_state WHERE lower(trim(status)) IN ('complete', 'completed')
  QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY processed_at DESC) = 1
)
SELECT c.scope_key, c.source_path FROM cur c LEFT JOIN done d ON c.source_path = d.source_path
WHERE d.source_path IS NULL OR NOT coalesce(
  CASE WHEN c.h IS NOT NULL AND d.h IS NOT NULL THEN c.h = d.h ELSE c.s = d.s AND c.m = d.m END, FALSE)
"""

QUERIES = {"p1_found": p1_found}
SQL = {"p1_found": P1_SQL}
