"""Queries over the driver tables for the core operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.operators import incremental
from quern.plans import flow_plans, inventory_plans, quality_plans, text_plans
from quern.runtime import fresh_folder
from quern.sources.versioned import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The logs are taken in as first versions where they lie; the output table names the versions it has processed."""
    root = fresh_folder(spark, "pending")
    samples, work, sink = (VersionedTable(spark, f"{root}/{n}") for n in ("samples", "work", "pending"))
    samples.commit(adopt=[f"{folder}/file_sample.parquet"])
    work.commit(adopt=[f"{folder}/work_item.parquet"])
    incremental.refresh_pending(samples, work, sink)
    return sink.read().select("document_key", "relative_path").distinct()


P6_FOUND = """
WITH events AS (SELECT document_key, run_id, lower(trim(status)) AS st, updated_at FROM work_item),
done AS (
  SELECT document_key, run_id FROM events WHERE st = 'done'
  QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY updated_at DESC NULLS LAST, run_id DESC) = 1),
lease AS (SELECT document_key, run_id, max(updated_at) AS leased_at FROM events WHERE st = 'leased' GROUP BY ALL),
run AS (SELECT d.document_key, l.leased_at FROM done d LEFT JOIN lease l USING (document_key, run_id)),
s AS (
  SELECT f.document_key, f.root_name, f.relative_path, f.sampled_at, f.sample_id, f.stable_checks, r.leased_at,
    last_value(f.content_hash IGNORE NULLS) OVER (
      PARTITION BY f.document_key, f.root_name, f.relative_path ORDER BY f.sampled_at, f.sample_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
  FROM file_sample f LEFT JOIN run r ON f.document_key = r.document_key),
newest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY document_key, root_name, relative_path ORDER BY sampled_at DESC, sample_id DESC) = 1),
processed AS (
  SELECT document_key, root_name, relative_path, h FROM s WHERE sampled_at <= leased_at
  QUALIFY row_number() OVER (PARTITION BY document_key, root_name, relative_path ORDER BY sampled_at DESC, sample_id DESC) = 1)
SELECT DISTINCT n.document_key, n.relative_path
FROM newest n LEFT JOIN processed p
  ON n.document_key = p.document_key AND n.root_name = p.root_name AND n.relative_path = p.relative_path
WHERE n.stable_checks >= 2 AND (p.document_key IS NULL OR n.h IS DISTINCT FROM p.h)
"""


PLANS = (inventory_plans, quality_plans, text_plans, flow_plans)


def queries() -> dict[str, Query]:
    return {"p6_found": p6_found} | {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_FOUND} | {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
