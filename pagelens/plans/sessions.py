"""Queries that bring the stages of a session together."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.operators import pages, trajectory
from pagelens.plans.pages import elements
from pagelens.plans.spatial import _CRUMBS, _OUT, _STEPS, _with_outcome, steps
from pagelens.sources.tables import table


def _avatars(spark, d):
    """Images that say they are photos, then those of a photo's size; each once, 20 a page."""
    e = elements(spark, d).where("tag = 'img' and w >= 12 and h >= 12 and w / h between 0.3 and 3.2 and x < 1920 and y < 1080 and x + w > 0 and y + h > 0")
    said = e.where(F.lower(F.coalesce("semanticName", F.lit(""))).rlike("avatar|photo|profil")).select("page", "row_id", F.lit(0).alias("rank"))
    sized = e.where("w between 16 and 700 and h between 16 and 700").select("page", "row_id", F.lit(1).alias("rank"))
    each = said.unionByName(sized).groupBy("page", "row_id").agg(F.min("rank").alias("rank"))
    first = each.withColumn("_rn", F.row_number().over(W.partitionBy("page").orderBy("rank", "row_id"))).where("_rn <= 20")
    return first.select("page", "row_id", "rank")


def _stages(spark, d):
    """What each stage left for a cycle."""
    m = table(spark, d, "milestones").where("perception_cycle_id is not null").groupBy("perception_cycle_id").agg(F.count("*").alias("updates"))
    e = table(spark, d, "dom_elements").groupBy("perception_cycle_id").agg(F.count("*").alias("elements"))
    o = table(spark, d, "observations").where("perception_cycle_id is not null").groupBy("perception_cycle_id").agg(F.count("*").alias("pages"))
    t = table(spark, d, "timeline").where("perception_cycle_id is not null").groupBy("perception_cycle_id").agg(F.count("*").alias("events"))
    out = t
    for other in (m, e, o):
        out = out.join(other, "perception_cycle_id", "left")
    return out.select("perception_cycle_id", "events", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("updates", "elements", "pages")])


def _resolve(spark, d):
    """The tab a request is for: a running task's, else the busiest, by component."""
    t = table(spark, d, "timeline").where("tab_id is not null and component is not null")
    running = t.where("status = 'running'").groupBy("component", "tab_id").agg(F.count("*").alias("n"), F.lit(0).alias("p"))
    active = t.groupBy("component", "tab_id").agg(F.count("*").alias("n"), F.lit(1).alias("p"))
    both = running.unionByName(active)
    return both.groupBy("component").agg(F.min_by("tab_id", F.struct("p", -F.col("n"), "tab_id")).alias("tab_id"))


def _states(spark, d):
    return steps(spark, d).groupBy("task").agg(F.count_distinct("state").alias("states"), F.count_distinct("action").alias("actions"))


def _attempts(spark, d):
    """The first three attempts of each action in a state; later ones are given up."""
    s = steps(spark, d).withColumn("attempt", F.row_number().over(W.partitionBy("task", "state", "action").orderBy("seq")))
    return s.groupBy("task").agg(F.count_if(F.col("attempt") <= 3).alias("tried"), F.count_if(F.col("attempt") > 3).alias("given_up"))


def _memory(spark, d):
    """The text a task's memory adds to a prompt: its trail and the actions to leave."""
    crumbs = trajectory.breadcrumbs(steps(spark, d))
    bad = trajectory.failures(_with_outcome(spark, d)).where("retry").groupBy("task").agg(F.array_join(F.array_sort(F.collect_set("action")), ", ").alias("bad"))
    seen = steps(spark, d).groupBy("task").agg(F.count("*").alias("n"))
    text = F.concat_ws("\n", F.concat(F.lit("Path: "), "crumbs"), F.concat(F.lit("Steps: "), F.col("n").cast("string")), F.concat(F.lit("Avoid: "), "bad"))
    return crumbs.join(seen, "task").join(bad, "task", "left").select("task", text.alias("memory"))


def _dead_ends(spark, d):
    """Actions still allowed in each state of a task: those seen anywhere in it and not failing there."""
    o = _with_outcome(spark, d)
    seen = o.select("task", "action").distinct()
    here = o.select("task", "state").distinct()
    bad = o.where(F.col("outcome").isin("FAILED", "NO_EFFECT")).select("task", "state", "action").distinct()
    return here.join(seen, "task").join(bad, ["task", "state", "action"], "left_anti").groupBy("task", "state").agg(F.count("*").alias("allowed"))


def _log_lines(spark, d):
    o = table(spark, d, "observations")
    n = F.coalesce(F.size("observation.elements"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    line = F.concat_ws(" ", F.lit("[AGENT]"), F.concat(F.lit("url="), "observation.url"), F.concat(F.lit("title="), F.left("observation.title", F.lit(25))))
    return o.select("obs_id", line.alias("line"), F.concat(n.cast("string"), F.lit(":"), F.coalesce("observation.pageHash", F.lit(""))).alias("fingerprint"), F.concat(F.left("observation.pageHash", F.lit(3)), F.lit("***")).alias("masked"))


def _capped(spark, d):
    """The first 100 boxes of a page in scan order, then the largest 15 of them."""
    e = elements(spark, d).where("w > 0 and h > 0")
    first = pages.first_per_page(e, "page", "ord", 100).withColumn("area", F.col("w") * F.col("h"))
    top = first.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy(F.col("area").desc(), "ord"))).where("place <= 15")
    return top.select("page", "row_id", "place", "area")


QUERIES = {
    "dom_avatars": _avatars,
    "cycle_stages": _stages,
    "tele_resolve_tab": _resolve,
    "traj_distinct_states": _states,
    "traj_attempts": _attempts,
    "traj_memory_text": _memory,
    "traj_allowed_actions": _dead_ends,
    "context_log_lines": _log_lines,
    "region_cap_then_sort": _capped,
}

SQL = {
    "dom_avatars": """
WITH e AS (SELECT perception_cycle_id AS page, row_id, bounds.x AS x, bounds.y AS y, bounds.width AS w, bounds.height AS h, "semanticName" AS n FROM dom_elements WHERE tag = 'img'),
f AS (SELECT * FROM e WHERE w >= 12 AND h >= 12 AND w / h::DOUBLE BETWEEN 0.3 AND 3.2 AND x < 1920 AND y < 1080 AND x + w > 0 AND y + h > 0),
u AS (SELECT page, row_id, 0 AS rank FROM f WHERE regexp_matches(lower(coalesce(n, '')), 'avatar|photo|profil') UNION ALL SELECT page, row_id, 1 FROM f WHERE w BETWEEN 16 AND 700 AND h BETWEEN 16 AND 700),
g AS (SELECT page, row_id, min(rank) AS rank FROM u GROUP BY 1, 2)
SELECT page, row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rank, row_id) AS rn FROM g) WHERE rn <= 20""",
    "cycle_stages": """
WITH t AS (SELECT perception_cycle_id AS c, count(*) AS events FROM timeline WHERE perception_cycle_id IS NOT NULL GROUP BY 1), m AS (SELECT perception_cycle_id AS c, count(*) AS n FROM milestones GROUP BY 1),
e AS (SELECT perception_cycle_id AS c, count(*) AS n FROM dom_elements GROUP BY 1), o AS (SELECT perception_cycle_id AS c, count(*) AS n FROM observations GROUP BY 1)
SELECT t.c AS perception_cycle_id, events, coalesce(m.n, 0) AS updates, coalesce(e.n, 0) AS elements, coalesce(o.n, 0) AS pages FROM t LEFT JOIN m USING (c) LEFT JOIN e USING (c) LEFT JOIN o USING (c)""",
    "tele_resolve_tab": """
WITH b AS (SELECT component, tab_id, count(*) AS n, 0 AS p FROM timeline WHERE tab_id IS NOT NULL AND component IS NOT NULL AND status = 'running' GROUP BY 1, 2
  UNION ALL SELECT component, tab_id, count(*), 1 FROM timeline WHERE tab_id IS NOT NULL AND component IS NOT NULL GROUP BY 1, 2)
SELECT component, tab_id FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY p, n DESC, tab_id) AS rn FROM b) WHERE rn = 1""",
    "traj_distinct_states": _STEPS + "SELECT task, count(DISTINCT state) AS states, count(DISTINCT action) AS actions FROM s GROUP BY 1",
    "traj_memory_text": _CRUMBS.rstrip() + """, b AS (SELECT *, lag(state) OVER (PARTITION BY task ORDER BY seq) AS before, lag(url) OVER (PARTITION BY task ORDER BY seq) AS ub FROM s),
o AS (SELECT *, CASE WHEN coalesce(status = 'error', false) THEN 'FAILED' WHEN before IS NULL THEN 'UNKNOWN' WHEN action = 'done' THEN 'SUCCESS' WHEN ub IS DISTINCT FROM url THEN 'NAVIGATION' WHEN before <> state THEN 'STATE_CHANGED' ELSE 'NO_EFFECT' END AS outcome FROM b),
p AS (SELECT *, sum(CASE WHEN outcome = 'NAVIGATION' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY seq) AS part FROM o), l AS (SELECT *, max(part) OVER (PARTITION BY task) AS final FROM p),
f AS (SELECT task, action FROM l WHERE part = final AND outcome IN ('FAILED', 'NO_EFFECT', 'TARGET_DISAPPEARED') GROUP BY 1, 2 HAVING count(*) >= 2 OR count(DISTINCT state) >= 2), g AS (SELECT task, string_agg(action, ', ' ORDER BY action) AS bad FROM f GROUP BY 1), n AS (SELECT task, count(*) AS n FROM s GROUP BY 1)
SELECT task, concat_ws(chr(10), 'Path: ' || crumbs, 'Steps: ' || n, 'Avoid: ' || bad) AS memory FROM crumbs JOIN n USING (task) LEFT JOIN g USING (task)""",
    "traj_attempts": _STEPS + ", a AS (SELECT task, row_number() OVER (PARTITION BY task, state, action ORDER BY seq) AS k FROM s) SELECT task, count(*) FILTER (k <= 3) AS tried, count(*) FILTER (k > 3) AS given_up FROM a GROUP BY 1",
    "traj_allowed_actions": _OUT
    + """, h AS (SELECT DISTINCT task, state FROM o), a AS (SELECT DISTINCT task, action FROM o), x AS (SELECT DISTINCT task, state, action FROM o WHERE outcome IN ('FAILED', 'NO_EFFECT'))
SELECT h.task, h.state, count(*) AS allowed FROM h JOIN a USING (task) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.task = h.task AND x.state = h.state AND x.action = a.action) GROUP BY 1, 2""",
    "context_log_lines": """
SELECT obs_id, concat_ws(' ', '[AGENT]', 'url=' || observation.url, 'title=' || left(observation.title, 25)) AS line,
       coalesce(len(observation.elements), 0) || ':' || coalesce(observation."pageHash", '') AS fingerprint, left(observation."pageHash", 3) || '***' AS masked FROM observations""",
    "region_cap_then_sort": """
WITH f AS MATERIALIZED (SELECT perception_cycle_id AS page, row_id, bounds.width AS w, bounds.height AS h FROM dom_elements), e AS (SELECT page, row_id, w * h AS area, row_number() OVER (PARTITION BY page ORDER BY row_id) AS rn FROM f WHERE w > 0 AND h > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, row_id) AS place FROM e WHERE rn <= 100)
SELECT page, row_id, place, area FROM p WHERE place <= 15""",
}
