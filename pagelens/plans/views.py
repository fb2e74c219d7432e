"""Queries behind the views: filters, labels, caps, versions and reads by key."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.columns import js_round
from pagelens.operators import pages, telemetry, trajectory
from pagelens.plans.pages import _BLOCKS, observed
from pagelens.plans.raster import SQL as RASTER
from pagelens.plans.raster import _classify
from pagelens.plans.spatial import _OUT, _STEPS, _with_outcome, steps
from pagelens.sources.tables import table


def _block_filter(spark, d):
    """Text blocks with a text in any case."""
    b = pages.text_blocks(observed(spark, d))
    return b.where(F.lower("text").contains("cart")).select("page", "ord", "text")


def _category_filter(spark, d):
    """Regions whose class contains a token."""
    return _classify(spark, d).where(F.col("class").contains("button")).select("row_id", "class")


def _labels(spark, d):
    """What stands for a block's numbers: percent and sides, a dash for what is missing or 0."""
    b = pages.text_blocks(observed(spark, d))
    sides = F.when((F.coalesce("w", F.lit(0)) == 0) | (F.coalesce("h", F.lit(0)) == 0), F.lit("—")).otherwise(F.concat_ws("×", F.col("w").cast("string"), F.col("h").cast("string")))
    return b.select("page", "ord", F.concat(js_round(F.col("confidence") * 100).cast("string"), F.lit("%")).alias("percent"), sides.alias("sides"))


def _attempt_signatures(spark, d):
    o = observed(spark, d)
    action = F.when(F.lower("tag").isin("input", "textarea"), F.lit("type")).otherwise(F.lit("click"))
    return o.select("page", "ord", trajectory.attempt_signature(action, F.col("target_id"), F.col("value"), F.lit(None).cast("string")).alias("signature"))


def _dead_ends(spark, d):
    """Actions without effect in a state of a task; the address stands for the target, there being none."""
    o = _with_outcome(spark, d).select("task", "seq", "state", "outcome", F.col("url").alias("target"), F.lit(None).cast("string").alias("mark"), F.col("action").alias("signature"))
    return trajectory.dead_ends(o).select("task", "state", "target", "signature", "n")


def _iteration_cap(spark, d):
    return trajectory.capped(steps(spark, d))


def _versions(spark, d):
    o = table(spark, d, "observations").where("observation is not null").select(F.col("perception_cycle_id").alias("grp"), F.col("obs_id").alias("seq"), "observation.url", F.col("observation.pageHash").alias("mark"))
    return trajectory.versions(o).select(F.col("seq").alias("obs_id"), "version")


def _last_index(spark, d):
    """The last place of each state in a task's steps, from 0."""
    return steps(spark, d).groupBy("task", "state").agg((F.max("seq") - 1).alias("last_index"))


def _inputs(spark, d):
    """The stages that left a result for each cycle, in order."""
    m = table(spark, d, "milestones").where("perception_cycle_id is not null").groupBy("perception_cycle_id").agg(*[F.bool_or(F.coalesce(F.col("milestone.id") == s, F.lit(False))).alias(s) for s in ("M1", "M2", "M3", "M4", "M5")])
    return m.select("perception_cycle_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in ("M1", "M2", "M3", "M4", "M5")])), ",").alias("inputs"))


def _thumbnails(spark, d):
    """Whether any element of a capture has a picture to show."""
    e = table(spark, d, "dom_elements")
    return e.groupBy("perception_cycle_id").agg(F.bool_or(F.coalesce((F.col("tag") == "img") & (F.col("bounds.width") > 0), F.lit(False))).alias("any_thumbnail"))


def _task_state(spark, d):
    """A read by key: the last state of one tab; the key reaches the scan as a filter."""
    e = table(spark, d, "timeline").where("tab_id = 4071")
    last = telemetry.last_values(e, "tab_id", F.struct("received_at", F.coalesce("id", F.lit("")), "batch_id", F.coalesce("event", F.lit(""))), ["component", "event", "status"])
    return last.select(F.concat(F.lit("task_"), F.col("tab_id").cast("string")).alias("key"), "component", "event", "status")


def _viewport(spark, d):
    """Sides of the view in the records that tell them, the ratio of pixels 1 where it isn't told."""
    r = table(spark, d, "raw_records")
    get = lambda p: F.get_json_object("payload", f"$.details.viewport.{p}")
    out = r.select("record_id", get("width").try_cast("long").alias("width"), get("height").try_cast("long").alias("height"), F.coalesce(get("dpr").try_cast("double"), F.lit(1.0)).alias("dpr"))
    return out.where("width is not null and height is not null")


def _recent(spark, d):
    """The five newest events of each component, and whether they are among all components' seven newest."""
    e = table(spark, d, "timeline").where("component is not null and trim(id) <> ''").select("component", "id", "event", "batch_id", "received_at").distinct()
    order = [F.col("received_at").desc(), F.col("id"), F.col("event"), F.col("batch_id").desc()]
    top = telemetry.latest(e, order, 7).select("id", "batch_id", F.lit(True).alias("newest"))
    five = e.withColumn("place", F.row_number().over(W.partitionBy("component").orderBy(*order))).where("place <= 5")
    return five.join(F.broadcast(top.distinct()), ["id", "batch_id"], "left").select("component", "place", "id", F.coalesce("newest", F.lit(False)).alias("newest"))


QUERIES = {
    "text_block_filter": _block_filter,
    "region_category_filter": _category_filter,
    "display_labels": _labels,
    "attempt_signatures": _attempt_signatures,
    "traj_dead_ends": _dead_ends,
    "traj_iteration_cap": _iteration_cap,
    "traj_observation_versions": _versions,
    "traj_last_index": _last_index,
    "cycle_inputs_received": _inputs,
    "dom_any_thumbnail": _thumbnails,
    "tele_task_state": _task_state,
    "viewport_metrics": _viewport,
    "tele_recent_events": _recent,
}

SQL = {
    "text_block_filter": f"SELECT page, ord, text FROM ({_BLOCKS}) WHERE contains(lower(text), 'cart')",
    "region_category_filter": f"SELECT row_id, \"class\" FROM ({RASTER['region_classify']}) WHERE contains(\"class\", 'button')",
    "display_labels": f"SELECT page, ord, CAST(floor(floor((0.85 + least(0.14, n_words * 0.02)) * 100 + 0.5) / 100 * 100 + 0.5) AS BIGINT) || '%' AS percent, CASE WHEN coalesce(w, 0) = 0 OR coalesce(h, 0) = 0 THEN '—' ELSE w || '×' || h END AS sides FROM ({_BLOCKS})",
    "attempt_signatures": "SELECT obs_id AS page, CAST(i - 1 AS INTEGER) AS ord, (CASE WHEN lower(e.tag) IN ('input', 'textarea') THEN 'type' ELSE 'click' END) || ':' || coalesce(e.target_id, '') || ':' || coalesce(e.value, '') || ':' AS signature FROM (SELECT obs_id, i, observation.elements[i] AS e FROM (SELECT obs_id, observation, unnest(range(1, len(observation.elements) + 1)) AS i FROM observations))",
    "traj_dead_ends": _OUT + "SELECT task, state, arg_min(url, seq) AS target, arg_min(action, seq) AS signature, count(*) AS n FROM o WHERE outcome = 'NO_EFFECT' GROUP BY task, state, CASE WHEN url <> '' THEN 't' || url ELSE 's' || action END",
    "traj_iteration_cap": _STEPS + "SELECT task, count(*) AS steps, CASE WHEN bool_or(coalesce(action = 'done', false)) THEN 'done' WHEN count(*) >= 25 THEN 'max_iterations' ELSE 'open' END AS status FROM s WHERE seq <= 25 GROUP BY 1",
    "traj_observation_versions": """
WITH o AS (SELECT obs_id, perception_cycle_id AS g, observation.url AS url, observation."pageHash" AS mark FROM observations WHERE observation IS NOT NULL),
n AS (SELECT *, CASE WHEN lag(url) OVER w IS NOT DISTINCT FROM url AND lag(mark) OVER w IS NOT DISTINCT FROM mark AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS k FROM o WINDOW w AS (PARTITION BY g ORDER BY obs_id))
SELECT obs_id, CAST(sum(k) OVER (PARTITION BY g ORDER BY obs_id) AS BIGINT) AS version FROM n""",
    "traj_last_index": _STEPS + "SELECT task, state, CAST(max(seq) - 1 AS INTEGER) AS last_index FROM s GROUP BY 1, 2",
    "cycle_inputs_received": "SELECT perception_cycle_id, coalesce(string_agg(DISTINCT milestone.id, ',' ORDER BY milestone.id) FILTER (milestone.id IN ('M1', 'M2', 'M3', 'M4', 'M5')), '') AS inputs FROM milestones WHERE perception_cycle_id IS NOT NULL GROUP BY 1",
    "dom_any_thumbnail": "SELECT perception_cycle_id, bool_or(coalesce(tag = 'img' AND bounds.width > 0, false)) AS any_thumbnail FROM dom_elements GROUP BY 1",
    "tele_task_state": """
WITH t AS (SELECT *, struct_pack(a := received_at, b := coalesce(id, ''), c := batch_id, d := coalesce(event, '')) AS o FROM timeline WHERE tab_id = 4071)
SELECT 'task_' || tab_id AS key, arg_max(component, o) FILTER (component IS NOT NULL) AS component, arg_max(event, o) FILTER (event IS NOT NULL) AS event, arg_max(status, o) FILTER (status IS NOT NULL) AS status FROM t GROUP BY tab_id""",
    "viewport_metrics": """
WITH v AS (SELECT record_id, TRY_CAST(json_extract_string(payload, '$.details.viewport.width') AS BIGINT) AS width, TRY_CAST(json_extract_string(payload, '$.details.viewport.height') AS BIGINT) AS height,
  coalesce(TRY_CAST(json_extract_string(payload, '$.details.viewport.dpr') AS DOUBLE), 1.0) AS dpr FROM (SELECT * FROM raw_records WHERE CASE WHEN json_valid(payload) THEN true ELSE false END))
SELECT * FROM v WHERE width IS NOT NULL AND height IS NOT NULL""",
    "tele_recent_events": """
WITH e AS (SELECT DISTINCT component, id, event, batch_id, received_at FROM timeline WHERE component IS NOT NULL AND trim(id) <> ''),
n AS (SELECT DISTINCT id, batch_id FROM (SELECT * FROM e ORDER BY received_at DESC, id, event, batch_id DESC LIMIT 7)),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY received_at DESC, id, event, batch_id DESC) AS INTEGER) AS place FROM e)
SELECT component, place, p.id, n.id IS NOT NULL AS newest FROM p LEFT JOIN n ON n.id = p.id AND n.batch_id = p.batch_id WHERE place <= 5""",
}
