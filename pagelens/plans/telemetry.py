"""Queries over the telemetry tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.columns import falsy, js_round
from pagelens.operators import telemetry as t
from pagelens.sources.tables import table

STAGES = ("M1", "M2", "M3", "M4", "M5", "M6")


def _finite(c):
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _components(spark, d):
    return table(spark, d, "timeline").groupBy("event", t.component_of(F.col("event")).alias("inferred")).agg(F.count("*").alias("n"))


def _routes(spark, d):
    r = t.routed(table(spark, d, "raw_records").select("record_id", "payload"))
    return r.select("record_id", "type", "route", "event", "component", "status")


def _filter(spark, d):
    rows = t.timeline_filter(table(spark, d, "timeline"), "complete", "m2_dom")
    return rows.groupBy("component", "event", "status").agg(F.count("*").alias("n"))


def _latest(spark, d):
    rows = t.latest(table(spark, d, "timeline"), [F.col("received_at").desc(), F.col("id").asc_nulls_last(), F.col("event").asc(), F.col("batch_id").desc()], 250)
    return rows.select("id", "event", F.unix_micros("received_at").alias("received_us"))


def _last_values(spark, d):
    m = table(spark, d, "milestones").where("milestone is not null").select("update_id", "perception_cycle_id", "milestone.*")
    return t.last_values(m, "id", F.col("update_id"), ["status", "executionTimeMs", "summary", "perception_cycle_id"]).where("id is not null")


def _upsert(spark, d):
    m = table(spark, d, "milestones").where("milestone.id is not null").select("update_id", F.col("milestone.id").alias("id"), F.col("milestone.status").alias("status"), "received_at")
    cut = F.lit("2026-01-20").cast("timestamp")
    return t.upsert(m.where(F.col("received_at") < cut), m.where(F.col("received_at") >= cut), "id", F.struct("received_at", "update_id")).select("id", "update_id", "status")


def _per_cycle(spark, d):
    m = table(spark, d, "milestones").where("milestone is not null and perception_cycle_id is not null").select(F.col("perception_cycle_id").alias("grp"), "milestone.id", F.col("milestone.status").alias("status"), _finite(F.col("milestone.executionTimeMs")).alias("ms"), "update_id")
    return m.where(F.col("id").isin(*STAGES)).groupBy("grp", "id").agg(F.max_by(F.struct("status", "ms"), "update_id").alias("l")).select("grp", "id", "l.*")


def _latency(spark, d):
    m = _per_cycle(spark, d)
    per = m.groupBy("grp").agg(F.sum(F.coalesce("ms", F.lit(0.0))).alias("total_ms"), F.greatest(F.max(F.coalesce("ms", F.lit(0.0))), F.lit(50.0)).alias("top_ms"), F.count_if(F.lower("status") == "success").alias("n_success"))
    return per


def _bars(spark, d):
    m = _per_cycle(spark, d)
    top = F.greatest(F.max(F.coalesce("ms", F.lit(0.0))).over(W.partitionBy("grp")), F.lit(50.0))
    return m.select("grp", "id", F.least(F.lit(100), js_round(F.coalesce("ms", F.lit(0.0)) / top * 100)).cast("long").alias("bar"))


def _verdicts(spark, d):
    m = _per_cycle(spark, d)
    return t.verdict(m.select("grp", "status"), F.lit(True), F.lit("PASSED")).select("grp", "n_success", "verdict")


def _gate(spark, d):
    e = table(spark, d, "timeline").where("component = 'PRIVACY_GATE' and perception_cycle_id is not null")
    agg = e.groupBy("perception_cycle_id").agg(F.bool_or(F.col("status") == "error").alias("b"), F.bool_or(F.col("status") == "success").alias("p"))
    return agg.select("perception_cycle_id", F.when(F.col("b"), "BLOCKED").when(F.col("p"), "PASSED").otherwise("STANDBY").alias("gate"))


def _asof(spark, d):
    base = table(spark, d, "timeline").where("timestamp is not null and tab_id is not null").select("tab_id", "timestamp", "component", "perception_cycle_id").distinct()
    left = base.where("component = 'M5_PII'")
    right = base.where("component = 'M1_SCREENSHOT'").groupBy("tab_id", "timestamp").agg(F.max("perception_cycle_id").alias("cycle"))
    out = t.asof(left, right, "tab_id", "timestamp", "timestamp", 4000, "cycle")
    return out.select("tab_id", F.unix_micros("timestamp").alias("us"), "perception_cycle_id", "last_cycle")


def _asof_any(spark, d):
    """The latest vision event before each fusion event of a tab, however old."""
    base = table(spark, d, "timeline").where("timestamp is not null and tab_id is not null")
    left = base.where("component = 'M6_FUSION'").select("tab_id", "timestamp").distinct()
    right = base.where("component = 'M3_VISION'").groupBy("tab_id", "timestamp").agg(F.max("event").alias("seen"))
    return t.asof(left, right, "tab_id", "timestamp", "timestamp", None, "seen").groupBy("last_seen").agg(F.count("*").alias("n"))


def _channels(spark, d):
    """Two channels of the relay together, each message once."""
    e = table(spark, d, "timeline").where("trim(id) <> ''").select(F.lower(F.trim("id")).alias("id"), "component", "batch_id")
    a, b = e.where("batch_id % 2 = 0").select("id"), e.where("batch_id % 2 = 1").select("id")
    both = a.unionByName(b).groupBy("id").agg(F.count("*").alias("n"))
    return both.groupBy("n").agg(F.count("*").alias("ids"))


def _trace(spark, d):
    e = table(spark, d, "timeline").where("perception_cycle_id is not null")
    return t.trace(e, "perception_cycle_id", "received_at", ["event", "component", "status", "id"])


def _trace_rows(spark, d):
    """The exported texts read back, row by row."""
    read = F.from_json("trace", "n long, events array<struct<_rn: int, event: string, component: string, status: string, id: string>>")
    rows = _trace(spark, d).select("perception_cycle_id", read.alias("t")).select("perception_cycle_id", "t.n", F.explode("t.events").alias("e"))
    return rows.select("perception_cycle_id", "n", F.col("e._rn").alias("place"), "e.event", "e.component", "e.status", "e.id")


def _health(spark, d):
    links = spark.createDataFrame([("link-capture", "M1"), ("link-dom", "M2"), ("link-vision", "M3"), ("link-text", "M4"), ("link-faces", "M5"), ("link-fusion", "M6"), ("link-agent", "AGENT")], "link string, id string")
    last = t.last_values(table(spark, d, "milestones").where("milestone.id is not null").select("update_id", "milestone.id", "milestone.status"), "id", F.col("update_id"), ["status"])
    return F.broadcast(links).join(last, "id", "left").select("link", F.coalesce("status", F.lit("waiting")).alias("status"))


def _badges(spark, d):
    s = F.lower("status")
    e = table(spark, d, "timeline").groupBy("status").agg(F.count("*").alias("n"))
    return e.select("status", "n", F.when(s == "success", "✓").when(s == "running", "↻").when(s == "error", "✗").otherwise("○").alias("symbol"), F.coalesce(s.isin("executed", "success"), F.lit(False)).alias("done"))


def _falsy(spark, d):
    m = _per_cycle(spark, d).groupBy("grp").agg(F.max(F.when(F.col("id") == "M6", F.col("ms"))).alias("a"), F.max(F.when(F.col("id") == "M5", F.col("ms"))).alias("b"))
    return m.select("grp", F.coalesce(falsy(F.col("a"), F.col("b"), F.lit(0.0)), F.lit(0.0)).alias("value"))


def _flags(spark, d):
    o = table(spark, d, "observations")
    return o.select("obs_id", F.col("observation.url").isNotNull().alias("has_browser"), (F.col("observation.title").isNotNull() | F.col("observation.pageHash").isNotNull()).alias("has_data"), F.coalesce("observation.title", "observation.url", "observation.pageHash").alias("label"))


def _dashboard_urls(spark, d):
    e = table(spark, d, "documents").where(F.col("url").isNotNull() & ~F.col("url").rlike(r"^https?://(?:localhost|127\.0\.0\.1):517[0-9](?:/|$)"))
    return e.groupBy("url").agg(F.count("*").alias("n"))


def _task_scan(spark, d):
    """Keyed states by prefix: the last state of each tab that is running."""
    e = table(spark, d, "timeline").where("tab_id is not null").select(F.concat(F.lit("task_"), F.col("tab_id").cast("string")).alias("key"), "status", F.struct("received_at", F.coalesce("id", F.lit("")).alias("i"), "batch_id", "event", "status").alias("o"))
    last = e.groupBy("key").agg(F.max_by("status", "o").alias("status"))
    return last.where(F.col("key").startswith("task_") & (F.col("status") == "running"))


def _hourly(spark, d):
    """Latency by component and hour of event time (an extension: the pages have no windows)."""
    e = table(spark, d, "timeline").where("timestamp is not null").select("component", F.date_trunc("hour", "timestamp").alias("h"), _finite(F.col("latencyMs")).alias("ms")).where("ms >= 0")
    return e.groupBy("component", F.unix_micros("h").alias("hour_us")).agg(F.count("*").alias("n"), F.max("ms").alias("top"), F.min("ms").alias("low"))


QUERIES = {
    "tele_component_inference": _components,
    "tele_packet_routes": _routes,
    "tele_timeline_filter": _filter,
    "tele_latest_250": _latest,
    "tele_last_value_state": _last_values,
    "tele_keyed_upsert": _upsert,
    "tele_latency_summary": _latency,
    "tele_latency_bars": _bars,
    "tele_verdict": _verdicts,
    "tele_gate": _gate,
    "tele_asof_capture": _asof,
    "tele_asof_vision": _asof_any,
    "tele_dedup_union": _channels,
    "tele_trace_export": _trace,
    "tele_trace_rows": _trace_rows,
    "tele_health_links": _health,
    "tele_status_badges": _badges,
    "tele_sensitive_fallback": _falsy,
    "tele_data_flags": _flags,
    "tele_dashboard_urls": _dashboard_urls,
    "tele_running_tasks": _task_scan,
    "tele_latency_by_hour": _hourly,
}

_INFER = "CASE WHEN event IS NULL OR event = '' THEN 'SYSTEM' " + " ".join(f"WHEN starts_with(event, '{a}') THEN '{b}'" for a, b in t.STARTS) + " " + " ".join(f"WHEN contains(event, '{a}') THEN '{b}'" for a, b in t.PARTS) + f" ELSE '{t.OTHER}' END"
_CYCLE = """
WITH l AS (SELECT perception_cycle_id AS grp, milestone.id AS id, arg_max(struct_pack(status := milestone.status, ms := CASE WHEN isfinite(milestone."executionTimeMs") THEN milestone."executionTimeMs" END), update_id) AS l
  FROM milestones WHERE milestone IS NOT NULL AND perception_cycle_id IS NOT NULL AND milestone.id IN ('M1', 'M2', 'M3', 'M4', 'M5', 'M6') GROUP BY 1, 2),
m AS (SELECT grp, id, l.status AS status, l.ms AS ms FROM l)
"""
_J = "CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.{0}') END"

SQL = {
    "tele_component_inference": f"SELECT event, {_INFER} AS inferred, count(*) AS n FROM timeline GROUP BY 1, 2",
    "tele_timeline_filter": "SELECT component, event, status, count(*) AS n FROM timeline WHERE upper(component) = 'M2_DOM' AND (contains(lower(event), 'complete') OR contains(lower(component), 'complete')) GROUP BY 1, 2, 3",
    "tele_latest_250": "SELECT id, event, epoch_us(received_at) AS received_us FROM timeline ORDER BY received_at DESC, id ASC NULLS LAST, event, batch_id DESC LIMIT 250",
    "tele_last_value_state": """
SELECT milestone.id AS id, arg_max(milestone.status, update_id) FILTER (milestone.status IS NOT NULL) AS status, arg_max(milestone."executionTimeMs", update_id) FILTER (milestone."executionTimeMs" IS NOT NULL) AS "executionTimeMs",
       arg_max(milestone.summary, update_id) FILTER (milestone.summary IS NOT NULL) AS summary, arg_max(perception_cycle_id, update_id) FILTER (perception_cycle_id IS NOT NULL) AS perception_cycle_id
FROM milestones WHERE milestone.id IS NOT NULL GROUP BY 1""",
    "tele_keyed_upsert": """
SELECT id, update_id, status FROM (SELECT milestone.id AS id, update_id, milestone.status AS status, row_number() OVER (PARTITION BY milestone.id ORDER BY received_at DESC, update_id DESC) AS rn FROM milestones WHERE milestone.id IS NOT NULL) WHERE rn = 1""",
    "tele_latency_summary": _CYCLE + "SELECT grp, sum(coalesce(ms, 0)) AS total_ms, greatest(max(coalesce(ms, 0)), 50) AS top_ms, count(*) FILTER (lower(status) = 'success') AS n_success FROM m GROUP BY 1",
    "tele_latency_bars": _CYCLE + "SELECT grp, id, CAST(least(100, floor(coalesce(ms, 0) / greatest(max(coalesce(ms, 0)) OVER (PARTITION BY grp), 50) * 100 + 0.5)) AS BIGINT) AS bar FROM m",
    "tele_verdict": _CYCLE + """
SELECT grp, count(*) FILTER (lower(status) = 'success') AS n_success,
  CASE WHEN bool_or(lower(status) = 'error') THEN 'error' WHEN bool_or(lower(status) = 'running') THEN 'running' WHEN bool_and(lower(status) = 'success') THEN 'success' ELSE 'waiting' END AS verdict FROM m GROUP BY 1""",
    "tele_gate": "SELECT perception_cycle_id, CASE WHEN bool_or(status = 'error') THEN 'BLOCKED' WHEN bool_or(status = 'success') THEN 'PASSED' ELSE 'STANDBY' END AS gate FROM timeline WHERE component = 'PRIVACY_GATE' AND perception_cycle_id IS NOT NULL GROUP BY 1",
    "tele_asof_capture": """
WITH b AS (SELECT DISTINCT tab_id, timestamp, component, perception_cycle_id FROM timeline WHERE timestamp IS NOT NULL AND tab_id IS NOT NULL),
r AS (SELECT tab_id, timestamp AS rt, max(perception_cycle_id) AS cycle FROM b WHERE component = 'M1_SCREENSHOT' GROUP BY 1, 2)
SELECT l.tab_id, epoch_us(l.timestamp) AS us, l.perception_cycle_id, CASE WHEN epoch_us(l.timestamp) - epoch_us(r.rt) <= 4000000 THEN r.cycle END AS last_cycle
FROM (SELECT * FROM b WHERE component = 'M5_PII') l ASOF LEFT JOIN r ON l.tab_id = r.tab_id AND l.timestamp >= r.rt""",
    "tele_asof_vision": """
WITH b AS (SELECT tab_id, timestamp, component, event FROM timeline WHERE timestamp IS NOT NULL AND tab_id IS NOT NULL),
r AS (SELECT tab_id, timestamp AS rt, max(event) AS seen FROM b WHERE component = 'M3_VISION' GROUP BY 1, 2)
SELECT r.seen AS last_seen, count(*) AS n FROM (SELECT DISTINCT tab_id, timestamp FROM b WHERE component = 'M6_FUSION') l ASOF LEFT JOIN r ON l.tab_id = r.tab_id AND l.timestamp >= r.rt GROUP BY 1""",
    "tele_dedup_union": "SELECT n, count(*) AS ids FROM (SELECT lower(trim(id)) AS id, count(*) AS n FROM timeline WHERE trim(id) <> '' AND batch_id IS NOT NULL GROUP BY 1) GROUP BY 1",
    "tele_trace_rows": """
WITH r AS (SELECT perception_cycle_id, event, component, status, id, CAST(row_number() OVER (PARTITION BY perception_cycle_id ORDER BY received_at DESC NULLS LAST, event NULLS FIRST, component NULLS FIRST, status NULLS FIRST, id NULLS FIRST) AS INTEGER) AS place FROM timeline WHERE perception_cycle_id IS NOT NULL)
SELECT perception_cycle_id, least(count(*) OVER (PARTITION BY perception_cycle_id), 250) AS n, place, event, component, status, id FROM r QUALIFY place <= 250""",
    "tele_health_links": """
WITH s AS (SELECT milestone.id AS id, arg_max(milestone.status, update_id) FILTER (milestone.status IS NOT NULL) AS status FROM milestones WHERE milestone.id IS NOT NULL GROUP BY 1)
SELECT l.link, coalesce(s.status, 'waiting') AS status FROM (VALUES ('link-capture', 'M1'), ('link-dom', 'M2'), ('link-vision', 'M3'), ('link-text', 'M4'), ('link-faces', 'M5'), ('link-fusion', 'M6'), ('link-agent', 'AGENT')) l(link, id) LEFT JOIN s ON s.id = l.id""",
    "tele_status_badges": "SELECT status, count(*) AS n, CASE lower(status) WHEN 'success' THEN '✓' WHEN 'running' THEN '↻' WHEN 'error' THEN '✗' ELSE '○' END AS symbol, coalesce(lower(status) IN ('executed', 'success'), false) AS done FROM timeline GROUP BY 1",
    "tele_sensitive_fallback": _CYCLE + "SELECT grp, coalesce(nullif(max(ms) FILTER (id = 'M6'), 0), nullif(max(ms) FILTER (id = 'M5'), 0), 0) AS value FROM m GROUP BY 1",
    "tele_data_flags": 'SELECT obs_id, observation.url IS NOT NULL AS has_browser, observation.title IS NOT NULL OR observation."pageHash" IS NOT NULL AS has_data, coalesce(observation.title, observation.url, observation."pageHash") AS label FROM observations',
    "tele_dashboard_urls": r"SELECT url, count(*) AS n FROM documents WHERE url IS NOT NULL AND NOT regexp_matches(url, '^https?://(?:localhost|127\.0\.0\.1):517[0-9](?:/|$)') GROUP BY 1",
    "tele_running_tasks": """
SELECT key, status FROM (SELECT 'task_' || tab_id AS key, status, row_number() OVER (PARTITION BY tab_id ORDER BY received_at DESC NULLS LAST, coalesce(id, '') DESC, batch_id DESC NULLS LAST, event DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM timeline WHERE tab_id IS NOT NULL) WHERE rn = 1 AND status = 'running'""",
    "tele_latency_by_hour": """
SELECT component, epoch_us(date_trunc('hour', timestamp)) AS hour_us, count(*) AS n, max("latencyMs") AS top, min("latencyMs") AS low FROM timeline WHERE timestamp IS NOT NULL AND isfinite("latencyMs") AND "latencyMs" >= 0 GROUP BY 1, 2""",
    "tele_packet_routes": f"""
WITH p AS (SELECT record_id, {_J.format("type")} AS type, coalesce(nullif({_J.format("event")}, ''), nullif({_J.format("eventType")}, '')) AS event, nullif({_J.format("component")}, '') AS c, nullif({_J.format("status")}, '') AS s FROM raw_records)
SELECT record_id, type, CASE type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.ROUTES.items())} END AS route, event,
       CASE WHEN event IS NOT NULL THEN coalesce(c, {_INFER}) END AS component, CASE WHEN event IS NOT NULL THEN coalesce(s, 'info') END AS status FROM p""",
}
