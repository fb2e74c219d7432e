"""Queries of the general operators for training data: problems 1, 3 and 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.operators import hierarchy, messages, nested
from pagelens.sources.tables import table



def _one_copy(spark, d):
    """All columns of one copy of each message, times in microseconds."""
    rows = messages.one_copy(table(spark, d, "timeline"))
    return rows.withColumns({c: F.unix_micros(c) for c in ("timestamp", "received_at")})


QUERIES = {
    "p1_found": lambda spark, d: nested.found(table(spark, d, "raw_records")),
    "p1_spatial": lambda spark, d: nested.one_table(table(spark, d, "raw_records"), "spatial"),
    "p1_warnings": lambda spark, d: nested.one_table(table(spark, d, "raw_records"), "warning"),
    "p1_tables": lambda spark, d: nested.links(table(spark, d, "raw_records")),
    "p3_found": lambda spark, d: hierarchy.found(table(spark, d, "dom_elements")),
    "p3_paths": lambda spark, d: hierarchy.paths(table(spark, d, "dom_elements")),
    "p3_cycles": lambda spark, d: hierarchy.cycles(table(spark, d, "dom_elements")),
    "p3_descendants": lambda spark, d: hierarchy.descendants(table(spark, d, "dom_elements")),
    # the ways for captures and components too large for a task, taken from 20 nodes on
    "hierarchy_split": lambda spark, d: hierarchy.paths(table(spark, d, "dom_elements"), max_local=20),
    "hierarchy_split_cycles": lambda spark, d: hierarchy.cycles(table(spark, d, "dom_elements"), max_local=20),
    "p5_found": lambda spark, d: messages.repeated(table(spark, d, "timeline")),
    "p5_one_copy": _one_copy,
}

_TIMELINE = ("id", "timestamp", "component", "event", "status", "latencyMs", "metadata", "perception_cycle_id", "tab_id", "batch_id", "received_at")

_DOM = """
WITH RECURSIVE n AS (
  SELECT perception_cycle_id AS c, target_id AS t, min(nullif(parent_id, '')) AS p
  FROM dom_elements WHERE target_id IS NOT NULL GROUP BY 1, 2
), e AS (
  SELECT n.c, n.t, u.t AS p FROM n LEFT JOIN n u ON u.c = n.c AND u.t = n.p
), r AS (
  SELECT c, t, t AS root, 0 AS depth, [t] AS path FROM e WHERE p IS NULL
  UNION ALL
  SELECT e.c, e.t, r.root, r.depth + 1, list_append(r.path, e.t) FROM r JOIN e ON e.c = r.c AND e.p = r.t
), d AS (
  SELECT c, a AS t, count(*) AS below
  FROM (SELECT c, t, unnest(path) AS a FROM r) WHERE a <> t GROUP BY 1, 2
)
"""
# nodes no root reaches, followed upwards; those that come back to themselves are on a cycle
_RINGS = _DOM + """, w AS (
  SELECT e.c, e.t, e.p AS x FROM e LEFT JOIN r ON r.c = e.c AND r.t = e.t WHERE r.t IS NULL
  UNION
  SELECT w.c, w.t, e.p FROM w JOIN e ON e.c = w.c AND e.t = w.x
), ring AS (
  SELECT c, t, (SELECT min(v.x) FROM w v WHERE v.c = w.c AND v.t = w.t) AS least FROM w WHERE x = t
)
"""

SQL = {
    # an invariant: every table has unique keys, and every child row a parent row
    "p1_tables": "SELECT tag, true AS keys_unique, CAST(0 AS BIGINT) AS orphans FROM (VALUES " + ", ".join(f"('{t}')" for t in nested.TAGS) + ") AS t(tag)",
    "p3_found": _DOM
    + """
SELECT e.c AS perception_cycle_id, e.t AS target_id, coalesce(r.root, '') AS root_id,
       CAST(coalesce(r.depth, -1) AS BIGINT) AS depth,
       CAST(CASE WHEN r.t IS NULL THEN -1 ELSE coalesce(d.below, 0) END AS BIGINT) AS n_descendants
FROM e LEFT JOIN r ON r.c = e.c AND r.t = e.t LEFT JOIN d ON d.c = e.c AND d.t = e.t
""",
    "p3_paths": _DOM
    + """
SELECT e.c AS grp, e.t AS node, coalesce(r.root, '') AS root,
       CAST(coalesce(r.depth, -1) AS BIGINT) AS depth,
       CAST(CASE WHEN r.t IS NULL THEN -1 ELSE coalesce(d.below, 0) END AS BIGINT) AS descendants,
       array_to_string(r.path, '/') AS path
FROM e LEFT JOIN r ON r.c = e.c AND r.t = e.t LEFT JOIN d ON d.c = e.c AND d.t = e.t
""",
    "p3_descendants": _DOM
    + """
SELECT c AS grp, a AS node, t AS descendant
FROM (SELECT c, t, unnest(path) AS a FROM r) WHERE a <> t
""",
    "p3_cycles": _RINGS
    + """
SELECT e.c AS grp, e.t AS node, e.p AS parent, (SELECT count(*) FROM ring x WHERE x.c = e.c AND x.least = e.t) AS length
FROM e JOIN ring ON ring.c = e.c AND ring.t = e.t WHERE ring.least = e.t
""",
    "p5_found": r"""
SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id, count(*) AS copies
FROM timeline WHERE regexp_replace(id, '^\s+|\s+$', '', 'g') <> ''
GROUP BY 1 HAVING count(*) > 1
""",
    "p5_one_copy": rf"""
WITH k AS (SELECT *, nullif(lower(regexp_replace(id, '^\s+|\s+$', '', 'g')), '') AS k FROM timeline),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY received_at NULLS LAST, batch_id NULLS LAST, timestamp NULLS LAST, {", ".join(f'"{c}" NULLS FIRST' for c in _TIMELINE)}) AS rn FROM k)
SELECT id, epoch_us(timestamp) AS timestamp, component, event, status, "latencyMs", metadata, perception_cycle_id, tab_id, batch_id, epoch_us(received_at) AS received_at
FROM o WHERE k IS NULL OR rn = 1
""",
}
SQL["hierarchy_split"] = SQL["p3_paths"]
SQL["hierarchy_split_cycles"] = SQL["p3_cycles"]
