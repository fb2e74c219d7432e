"""Queries over boxes and trajectories."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.columns import fixed
from pagelens.operators import boxes, trajectory
from pagelens.plans.pages import elements, observed
from pagelens.sources.tables import table


def _boxes(spark, d):
    return elements(spark, d).where("x is not null").select("page", F.col("row_id").alias("id"), "ord", "x", "y", "w", "h", "tag", "role", "target_id")


def _validate(spark, d):
    e = elements(spark, d)
    return e.select("row_id", boxes.validated(*[F.col(c) for c in "xywh"], F.lit(1280), F.lit(720)).alias("v")).select("row_id", "v.*")


def _normalise(spark, d):
    e = elements(spark, d)
    canonical = F.col("row_id") % 3 == 0
    return e.select("row_id", boxes.normalised(*[F.col(c) for c in "xywh"], F.lit(1280.0), F.lit(800.0), F.lit(1920.0), F.lit(1080.0), canonical).alias("v")).select("row_id", "v.*")


def _coordinate_telemetry(spark, d):
    e = _validate(spark, d)
    return e.groupBy("valid", F.coalesce("reason", F.lit("ok")).alias("reason"), F.lit(boxes.CANONICAL).alias("space")).agg(F.count("*").alias("n"), F.count_if("clamped").alias("n_clamped"))


def _nearby(spark, d):
    b = _boxes(spark, d)
    left = b.where("tag = 'img'").select("page", "id", "x", "y")
    return boxes.nearby(left, b.where("tag in ('input', 'button')")).select("id", "near")


def _inside(spark, d):
    b = _boxes(spark, d)
    points = b.where("tag = 'button'").select("page", "id", (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    area = b.where("tag in ('nav', 'div')").withColumn("ord", F.struct(-(F.col("w") * F.col("h")), F.col("ord")))
    return boxes.containing(points, area).select("id", "inside")


def _pairs(spark, d):
    return boxes.overlaps(_boxes(spark, d), 0.1).select("a", "b", fixed(F.col("iou"), 6).alias("iou"))


def _nms(spark, d):
    return boxes.suppressed(_boxes(spark, d).withColumn("score", F.col("w") * F.col("h")))


def _coverage(spark, d):
    v = elements(spark, d).where("tag = 'img'").select("page", boxes.validated(*[F.col(c) for c in "xywh"], F.lit(1920), F.lit(1080)).alias("v"))
    return v.where("v.valid").groupBy("page").agg(F.sum(F.col("v.width") * F.col("v.height")).alias("area")).select("page", "area", fixed(F.col("area") / (1920.0 * 1080.0), 4).alias("share"))


def steps(spark, d):
    """The action log: a tab is a task, a cycle's component its state."""
    e = table(spark, d, "timeline").where("tab_id is not null and trim(id) <> ''")
    e = e.groupBy(F.lower(F.regexp_replace("id", r"^\s+|\s+$", "")).alias("id")).agg(F.min(F.struct("received_at", "tab_id", F.coalesce("component", F.lit("")).alias("component"), "event", "status", F.coalesce("perception_cycle_id", F.lit("")).alias("cycle"))).alias("m")).select("id", "m.*")
    return trajectory.numbered(e.select(F.col("tab_id").alias("task"), "received_at", "id", F.col("event").alias("action"), F.col("component").alias("state"), "status", F.col("cycle").alias("url")), "task", F.col("received_at"), F.col("id"))


def _visits(spark, d):
    return trajectory.visits(steps(spark, d)).groupBy("task", "state").agg(F.max("visit").alias("visits"), F.count_if("loop").alias("looped"))


def _streaks(spark, d):
    return trajectory.streaks(steps(spark, d)).where("stuck").select("task", "seq", "action", "state", F.col("streak").cast("long").alias("streak"))


def _with_outcome(spark, d):
    s = steps(spark, d)
    w = W.partitionBy("task").orderBy("seq")
    s = s.withColumn("before", F.lag("state").over(w)).withColumn("url_before", F.lag("url").over(w))
    return s.withColumn("outcome", trajectory.outcome(F.col("status") == "error", F.col("before"), F.col("state"), F.col("action"), F.col("url_before"), F.col("url"), F.lit(False)))


def _outcomes(spark, d):
    return _with_outcome(spark, d).groupBy("task", "outcome").agg(F.count("*").alias("n"))


def _failures(spark, d):
    return trajectory.failures(_with_outcome(spark, d))


def _first_seen(spark, d):
    return trajectory.first_seen(steps(spark, d))


def _breadcrumbs(spark, d):
    return trajectory.breadcrumbs(steps(spark, d))


def _new_tabs(spark, d):
    s = table(spark, d, "timeline").where("tab_id is not null")
    before, after = s.where("received_at < '2026-01-15'").select("tab_id").distinct(), s.where("received_at >= '2026-01-15'").select("tab_id").distinct()
    return after.join(before, "tab_id", "left_anti")


def _seen_elements(spark, d):
    """Elements of observations with their capture, and the ids and tags of the captures (unique only within one)."""
    cycles = table(spark, d, "observations").select(F.col("obs_id").alias("page"), F.col("perception_cycle_id").alias("cycle"))
    o = observed(spark, d).select("page", "ord", "target_id", "tag").join(cycles, "page")
    known = table(spark, d, "dom_elements").select(F.col("perception_cycle_id").alias("cycle"), "target_id", "tag").where("target_id is not null and tag is not null").distinct()
    return o, known


def _targets(spark, d):
    """Elements of observations that their capture also has, by id and tag."""
    o, known = _seen_elements(spark, d)
    return o.join(known, ["cycle", "target_id", "tag"], "left_semi").select("page", "ord", "target_id", "tag")


def _gone(spark, d):
    """Elements of observations that their capture doesn't have by id and tag."""
    o, known = _seen_elements(spark, d)
    return o.join(known, ["cycle", "target_id", "tag"], "left_anti").groupBy("tag").agg(F.count("*").alias("n"))


def _context(spark, d):
    """Each observation against the one before it in its capture: the action that was to be taken there, and what changed.

    The target is the earlier page's last element; the tab is derived from the address.
    """
    o = table(spark, d, "observations").where("observation is not null").select("obs_id", "perception_cycle_id", "observation.url", "observation.pageHash", F.transform("observation.elements", lambda e: e["target_id"]).alias("known"))
    o = o.withColumn("tab", F.length("url") % 3)
    w = W.orderBy("obs_id").partitionBy("perception_cycle_id")
    back = {c: F.lag(c).over(w).alias(f"_{c}") for c in ("url", "pageHash", "known", "tab")}
    o = o.select("*", *back.values()).withColumn("target", F.try_element_at("_known", F.lit(-1)))
    check = trajectory.context_check(F.col("target"), F.col("known"), F.col("_tab"), F.col("tab"), F.col("_url"), F.col("url"))
    change = trajectory.change_reason(F.col("_tab"), F.col("tab"), F.col("_url"), F.col("url"), F.col("_pageHash"), F.col("pageHash"))
    return o.select("obs_id", check.alias("check"), change.alias("change"))


OUTCOMES = (
    (True, "a", "b", "click", "u", "v", True, "FAILED"), (None, None, "b", "click", "u", "u", None, "UNKNOWN"), (False, "a", None, "done", "u", "u", None, "UNKNOWN"), (False, "a", "b", "done", "u", "v", True, "SUCCESS"), (False, "a", "b", "click", "u", "v", True, "NAVIGATION"),
    (False, "a", "b", "click", None, "v", False, "NAVIGATION"), (False, "a", "b", "click", "u", "u", True, "TARGET_DISAPPEARED"), (False, "a", "b", "click", "u", "u", False, "STATE_CHANGED"), (False, "a", "a", "click", None, None, None, "NO_EFFECT"),
)
CONTEXTS = (
    ("t", ["s"], 1, 1, "u", "u", "TARGET_NOT_IN_OBSERVATION", "SAME_PAGE"), ("t", None, 1, 1, "u", "u", "TARGET_NOT_IN_OBSERVATION", "SAME_PAGE"), ("t", ["t"], 1, 2, "u", "v", "TAB_CHANGED", "NEW_TAB"), (None, [], 1, 1, "u", "v", "URL_CHANGED", "NAVIGATION"),
    (None, None, None, None, None, None, "OK", "SAME_PAGE"), ("t", ["s", "t"], 1, 1, "u", "u", "OK", "SAME_PAGE"), (None, [], None, 1, "u", "u", "TAB_CHANGED", "NEW_TAB"),
)


def _outcome_cases(spark, d):
    rows = spark.createDataFrame([(i, *x[:7]) for i, x in enumerate(OUTCOMES)], "n int, error boolean, before string, after string, action string, url string, new_url string, gone boolean")
    return rows.select("n", trajectory.outcome(*[F.col(c) for c in ("error", "before", "after", "action", "url", "new_url", "gone")]).alias("outcome"))


def _context_cases(spark, d):
    rows = spark.createDataFrame([(i, *x[:6]) for i, x in enumerate(CONTEXTS)], "n int, target string, known array<string>, tab int, new_tab int, url string, new_url string")
    c = [F.col(x) for x in ("target", "known", "tab", "new_tab", "url", "new_url")]
    return rows.select("n", trajectory.context_check(*c).alias("check"), trajectory.change_reason(*c[2:], F.lit("m"), F.lit("m")).alias("change"))


def _signatures(spark, d):
    o = observed(spark, d)
    return o.select("page", "ord", trajectory.action_signature(F.lit("click"), F.col("target_id"), F.col("text")).alias("signature"))


CASES = """VALUES
 (1, '{"action":"click","target_id":" el-4 ","memory":"m"}'), (2, '```json\n{"action":"WAIT","wait_ms":99999}\n```'), (3, 'sure: {"action":"scroll","direction":"sideways"}'),
 (4, '{"action":"type","target_id":"el-1"}'), (5, '{"action":"done","iterations_remaining":70.4}'), (6, 'no json here'), (7, '{"action":"fly"}'), (8, '{"action":"click","target_id":"  "}'),
 (9, '{"action":"press","target_id":"el-9","value":"Enter","iterations_remaining":-3}'), (10, '{"action":"wait","wait_ms":"soon"}')"""


def _actions(spark, d):
    rows = spark.sql(f"SELECT * FROM ({CASES}) AS t(n, raw)")
    return rows.select("n", trajectory.action_of(F.col("raw")).alias("a")).select("n", "a.*")


QUERIES = {
    "box_validate": _validate,
    "box_normalize": _normalise,
    "box_telemetry": _coordinate_telemetry,
    "spatial_nearby_join": _nearby,
    "spatial_point_in_box": _inside,
    "spatial_iou_pairs": _pairs,
    "spatial_nms": _nms,
    "spatial_coverage": _coverage,
    "traj_visit_counts": _visits,
    "traj_stuck_streaks": _streaks,
    "traj_outcomes": _outcomes,
    "traj_failures_since_navigation": _failures,
    "traj_first_seen_parent": _first_seen,
    "traj_breadcrumbs": _breadcrumbs,
    "traj_new_tabs_anti": _new_tabs,
    "traj_target_semi": _targets,
    "traj_target_gone": _gone,
    "traj_context_check": _context,
    "traj_outcome_cases": _outcome_cases,
    "traj_context_cases": _context_cases,
    "action_signatures": _signatures,
    "action_validate": _actions,
}


def _valid_sql(x, y, w, h, width, height, source):
    return f"""
WITH b AS (SELECT row_id, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST({w} AS DOUBLE) AS w, CAST({h} AS DOUBLE) AS h FROM ({source})),
e AS (SELECT *, CASE WHEN x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL THEN 'box_null_or_invalid_type' WHEN w <= 0 OR h <= 0 THEN 'zero_or_negative_dimensions'
  WHEN x >= {width} OR y >= {height} OR x + w <= 0 OR y + h <= 0 THEN 'box_completely_outside_image' END AS early,
  greatest(0, least({width} - 1, floor(x + 0.5))) AS cx, greatest(0, floor(y + 0.5)) AS cy FROM b),
f AS (SELECT *, greatest(1, least({width} - cx, floor(w + 0.5))) AS cw, greatest(1, least({height} - cy, floor(h + 0.5))) AS ch FROM e),
g AS (SELECT *, floor(cw * ch / ({width} * {height})::DOUBLE * 10000 + 0.5) / 10000 AS cover FROM f)
SELECT row_id, coalesce(early, CASE WHEN cover >= 0.45 THEN 'suspiciously_large_coverage_ratio' END) IS NULL AS valid, coalesce(early, CASE WHEN cover >= 0.45 THEN 'suspiciously_large_coverage_ratio' END) AS reason,
  CASE WHEN early IS NULL THEN CAST(cx AS INTEGER) END AS x, CASE WHEN early IS NULL THEN CAST(cy AS INTEGER) END AS y, CASE WHEN early IS NULL THEN CAST(cw AS INTEGER) END AS width, CASE WHEN early IS NULL THEN CAST(ch AS INTEGER) END AS height,
  CASE WHEN early IS NULL THEN cover END AS coverage, CASE WHEN early IS NULL THEN abs(cx - x) > 2 OR abs(cy - y) > 2 OR abs(cw - w) > 2 OR abs(ch - h) > 2 END AS clamped FROM g"""


_FLAT = "SELECT row_id, bounds.x AS x, bounds.y AS y, bounds.width AS w, bounds.height AS h FROM dom_elements"
_VALID = _valid_sql("x", "y", "w", "h", 1280, 720, _FLAT)
_SCALE = "CASE WHEN row_id % 3 = 0 AND false THEN {0} ELSE floor({0} * {1}::DOUBLE + 0.5) END"
_STEPS = r"""
WITH i AS (SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id, min(struct_pack(received_at := received_at, tab_id := tab_id, component := coalesce(component, ''), event := event, status := status, cycle := coalesce(perception_cycle_id, ''))) AS m
  FROM timeline WHERE tab_id IS NOT NULL AND trim(id) <> '' GROUP BY 1),
s AS (SELECT m.tab_id AS task, m.received_at AS received_at, id, m.event AS action, m.component AS state, m.status AS status, m.cycle AS url, row_number() OVER (PARTITION BY m.tab_id ORDER BY m.received_at, id) AS seq FROM i)
"""
_OUT = _STEPS + """, b AS (SELECT *, lag(state) OVER (PARTITION BY task ORDER BY seq) AS before, lag(url) OVER (PARTITION BY task ORDER BY seq) AS ub FROM s),
o AS (SELECT *, CASE WHEN coalesce(status = 'error', false) THEN 'FAILED' WHEN before IS NULL THEN 'UNKNOWN' WHEN action = 'done' THEN 'SUCCESS' WHEN ub IS DISTINCT FROM url THEN 'NAVIGATION' WHEN before <> state THEN 'STATE_CHANGED' ELSE 'NO_EFFECT' END AS outcome FROM b)
"""
_B = "SELECT perception_cycle_id AS page, row_id AS id, row_id AS ord, bounds.x AS x, bounds.y AS y, bounds.width AS w, bounds.height AS h, tag FROM dom_elements WHERE bounds.x IS NOT NULL"
_OBS = "SELECT obs_id AS page, CAST(i - 1 AS INTEGER) AS ord, observation.elements[i] AS e FROM (SELECT obs_id, observation, unnest(range(1, len(observation.elements) + 1)) AS i FROM observations)"

# the trail: from a task's first state on to what followed the last visit of each, until nothing does
_CRUMBS = _STEPS.replace("WITH i", "WITH RECURSIVE i") + """, nx AS (SELECT task, state, seq, lead(state) OVER (PARTITION BY task ORDER BY seq) AS nxt FROM s),
lastv AS (SELECT task, state, arg_max(struct_pack(n := nxt), seq) AS l FROM nx GROUP BY 1, 2),
way AS (SELECT task, arg_min(state, seq) AS state, 1 AS k FROM s GROUP BY 1 UNION ALL SELECT way.task, l.n, k + 1 FROM way JOIN lastv USING (task, state) WHERE l.n IS NOT NULL),
crumbs AS (SELECT task, string_agg(k || '. ' || left(state, 25), ' > ' ORDER BY k) AS crumbs FROM way GROUP BY 1)
"""

SQL = {
    "box_validate": _VALID,
    "box_normalize": _valid_sql(*[_SCALE.format(c, s) for c, s in (("x", 1.5), ("y", 1.35), ("w", 1.5), ("h", 1.35))], 1920, 1080, _FLAT),
    "box_telemetry": f"SELECT valid, coalesce(reason, 'ok') AS reason, '{boxes.CANONICAL}' AS space, count(*) AS n, count(*) FILTER (clamped) AS n_clamped FROM ({_VALID}) GROUP BY 1, 2",
    "spatial_nearby_join": f"""
WITH b AS ({_B}), p AS (SELECT l.id, arg_min(r.id, r.ord) AS near FROM b l JOIN b r ON l.page = r.page AND r.tag IN ('input', 'button') AND abs(r.x - l.x) < 120 AND abs(r.y - l.y) < 60 WHERE l.tag = 'img' GROUP BY 1)
SELECT b.id, p.near FROM b LEFT JOIN p USING (id) WHERE b.tag = 'img'""",
    "spatial_point_in_box": f"""
WITH b AS ({_B}), p AS (SELECT l.id, r.id AS box, row_number() OVER (PARTITION BY l.id ORDER BY r.w * r.h DESC, r.ord) AS rn FROM b l JOIN b r ON l.page = r.page AND r.tag IN ('nav', 'div') AND r.w > 0 AND r.h > 0
  AND l.x + l.w / 2::DOUBLE BETWEEN r.x AND r.x + r.w AND l.y + l.h / 2::DOUBLE BETWEEN r.y AND r.y + r.h WHERE l.tag = 'button')
SELECT b.id, p.box AS inside FROM b LEFT JOIN p ON p.id = b.id AND p.rn = 1 WHERE b.tag = 'button'""",
    "spatial_iou_pairs": f"""
WITH b AS (SELECT * FROM ({_B}) WHERE w > 0 AND h > 0), p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS shared, a.w * a.h + b.w * b.h AS total FROM b a JOIN b ON a.page = b.page AND a.id < b.id)
SELECT a, b, floor(shared / (total - shared)::DOUBLE * 1000000 + 0.5) / 1000000 AS iou FROM p WHERE shared / (total - shared)::DOUBLE > 0.1""",
    # greedy, one box of each page a step
    "spatial_nms": f"""
WITH RECURSIVE b AS (SELECT page, id, x, y, w, h, w * h AS score, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, ord) AS r FROM ({_B}) WHERE w > 0 AND h > 0),
k AS (SELECT page, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(id BIGINT, score INTEGER, x INTEGER, y INTEGER, w INTEGER, h INTEGER)[]) AS kept FROM (SELECT DISTINCT page FROM b)
  UNION ALL SELECT k.page, b.r, CASE WHEN len(list_filter(kept, lambda q: greatest(0, least(q.x + q.w, b.x + b.w) - greatest(q.x, b.x)) * greatest(0, least(q.y + q.h, b.y + b.h) - greatest(q.y, b.y))
    > {boxes.MOST_OVERLAP}::DOUBLE * (q.w * q.h + b.w * b.h - greatest(0, least(q.x + q.w, b.x + b.w) - greatest(q.x, b.x)) * greatest(0, least(q.y + q.h, b.y + b.h) - greatest(q.y, b.y))))) = 0
    THEN list_append(kept, struct_pack(id := b.id, score := b.score, x := b.x, y := b.y, w := b.w, h := b.h)) ELSE kept END FROM k JOIN b ON b.page = k.page AND b.r = k.r + 1)
SELECT page, u.id AS id, u.score AS score FROM (SELECT page, unnest(arg_max(kept, r)) AS u FROM k GROUP BY 1)""",
    "spatial_coverage": f"""
WITH v AS ({_valid_sql("x", "y", "w", "h", 1920, 1080, _FLAT + " WHERE tag = 'img'")})
SELECT e.perception_cycle_id AS page, CAST(sum(v.width * v.height) AS BIGINT) AS area, floor(sum(v.width * v.height) / (1920.0::DOUBLE * 1080) * 10000 + 0.5) / 10000 AS share FROM v JOIN dom_elements e USING (row_id) WHERE v.valid GROUP BY 1""",
    "traj_visit_counts": _STEPS + "SELECT task, state, count(*) AS visits, greatest(count(*) - 2, 0) AS looped FROM s GROUP BY 1, 2",
    "traj_stuck_streaks": _STEPS + """, r AS (SELECT *, sum(CASE WHEN lag_a IS NOT DISTINCT FROM action AND lag_s IS NOT DISTINCT FROM state AND seq > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY task ORDER BY seq) AS run
  FROM (SELECT *, lag(action) OVER (PARTITION BY task ORDER BY seq) AS lag_a, lag(state) OVER (PARTITION BY task ORDER BY seq) AS lag_s FROM s)),
n AS (SELECT *, row_number() OVER (PARTITION BY task, run ORDER BY seq) AS streak FROM r)
SELECT task, seq, action, state, streak FROM n WHERE streak >= 2""",
    "traj_outcomes": _OUT + "SELECT task, outcome, count(*) AS n FROM o GROUP BY 1, 2",
    "traj_failures_since_navigation": _OUT + """, p AS (SELECT *, sum(CASE WHEN outcome = 'NAVIGATION' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY seq) AS part FROM o),
l AS (SELECT *, max(part) OVER (PARTITION BY task) AS last FROM p)
SELECT task, action, count(*) AS n, CAST(count(DISTINCT state) AS INTEGER) AS n_states, arg_max(outcome, seq) AS last_outcome, count(*) >= 2 OR count(DISTINCT state) >= 2 AS retry
FROM l WHERE part = last AND outcome IN ('FAILED', 'NO_EFFECT', 'TARGET_DISAPPEARED') GROUP BY 1, 2""",
    "traj_first_seen_parent": _STEPS.replace("WITH i", "WITH RECURSIVE i") + """, b AS (SELECT *, lag(state) OVER (PARTITION BY task ORDER BY seq) AS before, row_number() OVER (PARTITION BY task, state ORDER BY seq) AS v FROM s),
f AS (SELECT task, state, CAST(min(seq) AS INTEGER) AS first_seq, CAST(max(seq) AS INTEGER) AS last_seq, count(*) AS visits, max(before) FILTER (v = 1) AS parent, arg_max(url, seq) AS url FROM b GROUP BY 1, 2),
r AS (SELECT task, state, 0 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.task, f.state, r.depth + 1 FROM r JOIN f ON f.task = r.task AND f.parent = r.state)
SELECT f.*, CAST(r.depth AS BIGINT) AS depth FROM f JOIN r USING (task, state)""",
    "traj_breadcrumbs": _CRUMBS + "SELECT task, crumbs FROM crumbs",
    "traj_new_tabs_anti": "SELECT DISTINCT tab_id FROM timeline WHERE tab_id IS NOT NULL AND received_at >= '2026-01-15' AND tab_id NOT IN (SELECT tab_id FROM timeline WHERE tab_id IS NOT NULL AND received_at < '2026-01-15')",
    "traj_target_semi": f"SELECT page, ord, e.target_id AS target_id, e.tag AS tag FROM ({_OBS}) JOIN observations q ON q.obs_id = page WHERE EXISTS (SELECT 1 FROM dom_elements k WHERE k.perception_cycle_id = q.perception_cycle_id AND k.target_id = e.target_id AND k.tag = e.tag)",
    "traj_target_gone": f"SELECT e.tag AS tag, count(*) AS n FROM ({_OBS}) JOIN observations q ON q.obs_id = page WHERE NOT EXISTS (SELECT 1 FROM dom_elements k WHERE k.perception_cycle_id = q.perception_cycle_id AND k.target_id = e.target_id AND k.tag = e.tag) GROUP BY 1",
    "traj_context_check": """
WITH o AS (SELECT obs_id, perception_cycle_id, observation.url AS url, observation."pageHash" AS mark, list_transform(observation.elements, lambda e: e.target_id) AS known, length(observation.url) % 3 AS tab FROM observations WHERE observation IS NOT NULL),
b AS (SELECT *, lag(url) OVER w AS u, lag(mark) OVER w AS m, lag(known)  OVER w AS k, lag(tab) OVER w AS t FROM o WINDOW w AS (PARTITION BY perception_cycle_id ORDER BY obs_id))
SELECT obs_id, CASE WHEN k[-1] IS NOT NULL AND NOT coalesce(list_contains(known, k[-1]), false) THEN 'TARGET_NOT_IN_OBSERVATION' WHEN t IS DISTINCT FROM tab THEN 'TAB_CHANGED' WHEN u IS DISTINCT FROM url THEN 'URL_CHANGED' ELSE 'OK' END AS "check",
       CASE WHEN t IS DISTINCT FROM tab THEN 'NEW_TAB' WHEN u IS DISTINCT FROM url THEN 'NAVIGATION' WHEN m IS DISTINCT FROM mark THEN 'RELOAD' ELSE 'SAME_PAGE' END AS change FROM b""",
    "traj_outcome_cases": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x[-1]}')" for i, x in enumerate(OUTCOMES)) + ") AS t(n, outcome)",
    "traj_context_cases": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x[-2]}', '{x[-1]}')" for i, x in enumerate(CONTEXTS)) + ') AS t(n, "check", change)',
    "action_signatures": f"SELECT page, ord, 'click:' || coalesce(e.target_id, '') || ':' || left(coalesce(e.text, ''), 30) AS signature FROM ({_OBS})",
    "action_validate": """
SELECT * FROM (VALUES
 (1, true, NULL, 'click', 'el-4', NULL, NULL, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 'm'), (2, true, NULL, 'wait', NULL, NULL, NULL, 10000, 0, ''), (3, false, 'direction_required', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
 (4, false, 'value_required', NULL, NULL, NULL, NULL, NULL, NULL, NULL), (5, true, NULL, 'done', NULL, NULL, NULL, NULL, 50, ''), (6, false, 'no_json', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
 (7, false, 'unsupported_action', NULL, NULL, NULL, NULL, NULL, NULL, NULL), (8, false, 'target_id_required', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
 (9, true, NULL, 'press', 'el-9', 'Enter', NULL, NULL, 0, ''), (10, true, NULL, 'wait', NULL, NULL, NULL, 1000, 0, '')) AS t(n, valid, reason, action, target_id, value, direction, wait_ms, remaining, memory)""",
}
