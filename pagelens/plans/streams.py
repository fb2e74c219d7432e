"""Queries that run as streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.operators.messages import normal_id
from pagelens.streaming import streams as s


def _last(spark, d):
    m = s.source(spark, d, "milestones").where("milestone is not null").select("update_id", "milestone.id", "milestone.status", "milestone.summary")
    return s.last_values(m, "id", F.col("update_id"), ["status", "summary"])


def _once(spark, d):
    out = s.once(s.source(spark, d, "timeline"), normal_id(F.col("id")), "received_at")
    return out.agg(F.count_distinct("_id").alias("ids"), F.count("*").alias("rows"))


def _relay(spark, d):
    return s.relayed(s.source(spark, d, "timeline")).groupBy("component", "event").agg(F.count("*").alias("n"))


def _history(spark, d):
    rows = s.history(s.source(spark, d, "timeline"), [F.col("received_at").desc(), F.col("id").asc_nulls_last(), F.col("event").asc(), F.col("batch_id").desc()])
    return rows.select("id", "event", F.unix_micros("received_at").alias("received_us"))


def _ingest(spark, d):
    good, bad = s.ingested(s.source(spark, d, "raw_records").select("record_id", "payload"), "payload")
    return good.groupBy(F.lit(True).alias("accepted"), "route").agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.lit(False).alias("accepted"), "route").agg(F.count("*").alias("n")))


def _windows(spark, d):
    ms = F.col("latencyMs")
    value = F.when(~F.isnan(ms) & (ms >= 0) & (ms < float("inf")), ms)
    return s.windows(s.source(spark, d, "timeline").where("timestamp is not null"), "timestamp", "component", value)


def _visits(spark, d):
    return s.trails(s.source(spark, d, "timeline").where("tab_id is not null and component is not null"), "tab_id", "component")


def _connection(spark, d):
    return s.connection(s.source(spark, d, "timeline"))


QUERIES = {
    "stream_last_value": _last,
    "stream_once": _once,
    "stream_relay": _relay,
    "stream_history": _history,
    "stream_ingest": _ingest,
    "stream_latency_windows": _windows,
    "stream_visits": _visits,
    "stream_connection": _connection,
}

SQL = {
    "stream_once": r"SELECT count(DISTINCT k) AS ids, count(DISTINCT k) AS rows FROM (SELECT nullif(lower(regexp_replace(id, '^\s+|\s+$', '', 'g')), '') AS k FROM timeline)",
    "stream_relay": "SELECT component, event, count(*) AS n FROM timeline GROUP BY 1, 2",
    "stream_history": "SELECT id, event, epoch_us(received_at) AS received_us FROM timeline ORDER BY received_at DESC, id ASC NULLS LAST, event, batch_id DESC LIMIT 250",
    "stream_last_value": "SELECT milestone.id AS id, arg_max(milestone.status, update_id) FILTER (milestone.status IS NOT NULL) AS status, arg_max(milestone.summary, update_id) FILTER (milestone.summary IS NOT NULL) AS summary FROM milestones WHERE milestone.id IS NOT NULL GROUP BY 1",
    "stream_ingest": "SELECT coalesce(json_valid(payload), false) AS accepted, CASE WHEN json_valid(payload) AND json_extract_string(payload, '$.type') = 'M2_RESULT' THEN 'dom' END AS route, count(*) AS n FROM raw_records GROUP BY 1, 2",
    "stream_latency_windows": 'SELECT epoch_us(date_trunc(\'day\', timestamp)) AS start_us, component, count(*) AS n, min("latencyMs") AS low, max("latencyMs") AS top FROM timeline WHERE timestamp IS NOT NULL AND isfinite("latencyMs") AND "latencyMs" >= 0 GROUP BY 1, 2',
    "stream_visits": "SELECT tab_id, component, count(*) AS visits FROM timeline WHERE tab_id IS NOT NULL AND component IS NOT NULL GROUP BY 1, 2",
    "stream_connection": """
WITH l AS (SELECT tab_id, status, row_number() OVER (PARTITION BY tab_id ORDER BY received_at DESC NULLS LAST, event DESC NULLS LAST, status DESC) AS rn FROM timeline WHERE tab_id IS NOT NULL AND status IS NOT NULL)
SELECT tab_id, CASE WHEN lower(status) = 'error' THEN 'error' WHEN lower(status) IN ('success', 'info', 'running') THEN 'connected' ELSE 'disconnected' END AS connection FROM l WHERE rn = 1""",
}
