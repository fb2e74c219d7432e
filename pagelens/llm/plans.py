"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.llm import languages, leaks, personal, quantiles, tokens
from pagelens.session import cut_lineage, spread
from pagelens.sources.tables import table


def _percentiles(spark, d):
    timeline, milestones = table(spark, d, "timeline"), table(spark, d, "milestones")
    day = F.to_date(F.coalesce("timestamp", "received_at"))
    latency = quantiles.partials("latencyMs", timeline, F.col("component"), day, F.col("latencyMs"))
    day = F.to_date(F.coalesce("milestone.lastUpdated", "received_at"))
    run = quantiles.partials("executionTimeMs", milestones, F.col("milestone.id"), day, F.col("milestone.executionTimeMs"))
    return quantiles.per_day_and_all([latency, run], cut_lineage)


def _documents(spark, d, *more):
    return spread(table(spark, d, "documents").select("doc_id", "text", *more))


def _texts(spark, d):
    return personal.units_of(_documents(spark, d), table(spark, d, "dom_elements"), table(spark, d, "observations"))


QUERIES = {
    "p2_percentiles": _percentiles,
    "p4_found": lambda spark, d: personal.found(_texts(spark, d)),
    "p4_redacted": lambda spark, d: personal.redacted(_texts(spark, d)),
    "p6_ids": lambda spark, d: tokens.encode(_documents(spark, d)),
    "p6_decoded": lambda spark, d: tokens.decode(tokens.encode(_documents(spark, d))),
    "p7_found": lambda spark, d: leaks.found(_documents(spark, d), table(spark, d, "benchmark")),
    "p8_found": lambda spark, d: languages.found(_documents(spark, d, "lang")),
    "p8_documents": lambda spark, d: languages.documents(_documents(spark, d, "lang")),
}

SQL = {
    # exact; the sketches are so too while a group has fewer than K * FAN values
    "p2_percentiles": """
WITH v AS (
  SELECT 'latencyMs' AS metric, component AS grp, CAST(CAST(coalesce(timestamp, received_at) AS DATE) AS VARCHAR) AS day, latencyMs AS x FROM timeline
  UNION ALL
  SELECT 'executionTimeMs', milestone.id, CAST(CAST(coalesce(milestone.lastUpdated, received_at) AS DATE) AS VARCHAR), milestone.executionTimeMs FROM milestones
), c AS (
  SELECT metric, grp, day, CASE WHEN isfinite(x) AND x >= 0 THEN x END AS x FROM v
), a AS (SELECT * FROM c UNION ALL SELECT metric, grp, 'all', x FROM c)
SELECT metric, grp, day, count(x) AS n, min(x) AS lo, max(x) AS hi,
       quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.9) AS p90, quantile_disc(x, 0.95) AS p95, quantile_disc(x, 0.99) AS p99,
       CAST(0 AS BIGINT) AS rank_error
FROM a GROUP BY 1, 2, 3
""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
