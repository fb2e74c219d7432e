"""Telemetry: component inference, routing, last values, roll-ups, verdicts and trace export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Packet types by the part of the state they update.
ROUTES = {
    "BROWSER_STATE": "browser", "BROWSER_STATE_CHANGED": "browser", "MILESTONE_UPDATE": "milestone", "M1_CAPTURE": "browser", "M1_RESULT": "browser", "M2_DOM": "dom", "M2_RESULT": "dom",
    "M3_VISION": "vision", "M3_RESULT": "vision", "M4_OCR": "ocr", "M4_RESULT": "ocr", "M5_PII": "privacy", "M5_RESULT": "privacy", "M6_FUSION": "fusion", "M6_RESULT": "fusion",
    "TASK_START": "agent", "TASK_UPDATE": "agent", "AGENT_TASK": "agent", "AGENT_TELEMETRY": "agent", "GEMINI_DECISION": "agent", "HEALTH_UPDATE": "health",
}
# Component by the start, then by a part of an event's name.
STARTS = (("M1", "M1_SCREENSHOT"), ("M2", "M2_DOM"), ("M3", "M3_VISION"), ("M4", "M4_OCR"), ("M5", "M5_PII"), ("M6", "M6_FUSION"))
PARTS = (("SANITIZ", "PRIVACY_GATE"), ("PRIVACY", "PRIVACY_GATE"), ("AGENT", "SIMPLE_UI_GEMINI"), ("GEMINI", "SIMPLE_UI_GEMINI"), ("ACTION", "BROWSER_ACTION"), ("BROWSER", "BROWSER_ACTION"))
#: The component of events that no rule names.
OTHER = "CORE"


def component_of(event: Column) -> Column:
    """The component an event's name tells; SYSTEM for a null or empty one."""
    out = F.when(event.isNull() | (event == ""), "SYSTEM")
    for start, name in STARTS:
        out = out.when(event.startswith(start), name)
    for part, name in PARTS:
        out = out.when(event.contains(part), name)
    return out.otherwise(OTHER)


def routed(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON packets with type, route, event, component, status and latency.

    A packet without an event or event type is no timeline row (event null); one of an
    unknown type has a null route. Broken JSON and empty text give nulls throughout.
    """
    get = lambda p: F.get_json_object(payload, f"$.{p}")
    kind = get("type")
    event = F.coalesce(F.when(get("event") != "", get("event")), F.when(get("eventType") != "", get("eventType")))
    route = F.try_element_at(F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair]), kind)
    return packets.select(
        "*",
        kind.alias("type"),
        route.alias("route"),
        event.alias("event"),
        F.when(event.isNotNull(), F.coalesce(F.when(get("component") != "", get("component")), component_of(event))).alias("component"),
        F.when(event.isNotNull(), F.coalesce(F.when(get("status") != "", get("status")), F.lit("info"))).alias("status"),
        get("latencyMs").try_cast("double").alias("latencyMs"),
    )


def timeline_filter(df: DataFrame, text: str = "", component: str = "ALL") -> DataFrame:
    """Rows of a component (any case; ALL passes) with the text in event or component."""
    out = df
    if component.upper() != "ALL":
        out = out.where(F.upper("component") == component.upper())
    if text:
        hit = lambda c: F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
        out = out.where(hit(F.col("event")) | hit(F.col("component")))
    return out


def latest(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The newest rows; Spark keeps `most` a task and merges them (no full sort)."""
    return df.orderBy(*order).limit(most)


def last_values(df: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """For each key the last non-null value of each field: documents merged over one another."""
    return df.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])


def upsert(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows of both tables, of each key the newest one."""
    both = old.unionByName(new)
    names = both.columns
    return both.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select("r.*")


def verdict(statuses: DataFrame, connected: Column, gate: Column) -> DataFrame:
    """statuses (grp, status of each stage) to one verdict a group."""
    s = F.lower("status")
    agg = statuses.groupBy("grp").agg(F.bool_or(s == "error").alias("any_error"), F.bool_or(s == "running").alias("any_running"), F.bool_and(s == "success").alias("all_success"), F.bool_and(s == "waiting").alias("all_waiting"), F.count_if(s == "success").alias("n_success"))
    word = (
        F.when(~connected & F.col("all_waiting"), "disconnected")
        .when(F.col("any_error"), "error")
        .when(F.col("any_running"), "running")
        .when(F.col("all_success") & (gate == "PASSED"), "success")
        .otherwise("waiting")
    )
    return agg.withColumn("verdict", word)


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tolerance_ms: int | None, value: str) -> DataFrame:
    """left with the latest right value not after it, within the tolerance (null: any age).

    One union and one window per key instead of a range join: no pair of rows is built.
    At equal times right rows come first; null times never match.
    """
    sides = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("timestamp").alias("_vt"))
    other = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(sides.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.col(right_time).cast("timestamp").alias("_vt"))
    w = W.partitionBy("_k").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_v", "_vt")), ignorenulls=True).over(w)
    out = sides.unionAll(other).withColumn("_l", last).where("_side = 1")
    fresh = F.col("_t").isNotNull() if tolerance_ms is None else F.col("_t").isNotNull() & (F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros("_l._vt") <= tolerance_ms * 1000)
    return out.select("_row.*", F.when(fresh, F.col("_l._v")).alias(f"last_{value}"))


def trace(df: DataFrame, group: str, order: str, fields: list[str], most: int = 250) -> DataFrame:
    """(group, trace): each group's newest rows as one JSON text."""
    newest = df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(F.col(order).desc_nulls_last(), *[F.col(f) for f in fields]))).where(F.col("_rn") <= most)
    packed = newest.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_rn", *fields))).alias("events"), F.count("*").alias("n"))
    return packed.select(group, F.to_json(F.struct(F.col(group), "n", "events")).alias("trace"))
