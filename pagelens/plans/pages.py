"""Queries over page elements and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions.columns import byte_size, ratio_label
from pagelens.operators import hierarchy, pages
from pagelens.plans.training import _DOM
from pagelens.sources.tables import table

WIDTH, HEIGHT = 1920, 1080


def elements(spark, d):
    """dom_elements flat: page, ord, box and texts."""
    return table(spark, d, "dom_elements").select("row_id", F.col("perception_cycle_id").alias("page"), F.col("row_id").alias("ord"), "url", "target_id", "parent_id", "tag", "role", "semanticName", "text", "actionable", *[F.col(f"bounds.{a}").alias(b) for a, b in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))])


def observed(spark, d):
    """Elements of the observations, one row each, in order."""
    o = table(spark, d, "observations").select("obs_id", F.posexplode("observation.elements").alias("ord", "e"))
    return o.select(F.col("obs_id").alias("page"), "ord", "e.target_id", "e.tag", "e.role", F.col("e.type").alias("kind"), "e.text", "e.name", "e.value", "e.placeholder", "e.aria_label", *[F.col(f"e.bounds.{a}").alias(b) for a, b in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))])


def _roles(spark, d):
    e = elements(spark, d)
    return e.select("row_id", pages.role_of(F.col("tag"), F.col("role")).alias("role"))


def _role_histogram(spark, d):
    return table(spark, d, "dom_elements").where("role is not null").groupBy("perception_cycle_id", "role").agg(F.count("*").alias("n"))


def _counts(spark, d):
    e = elements(spark, d)
    role = pages.role_of(F.col("tag"), F.col("role"))
    e = e.select("page", pages.visibility(*[F.col(c) for c in "xywh"], WIDTH, HEIGHT).alias("vis"), pages.interactivity(F.col("tag"), role, F.lit(None).cast("string"), F.col("actionable")).alias("i"))
    return e.groupBy("page").agg(F.count("*").alias("total"), F.count_if(F.col("vis").isin("VISIBLE", "PARTIALLY_VISIBLE")).alias("visible"), F.count_if("i.interactive").alias("interactive"), F.count_if("i.editable").alias("editable"), F.count_if("i.clickable").alias("clickable"), F.count_if("i.focusable").alias("focusable"))


def _visibility(spark, d):
    e = elements(spark, d)
    return e.groupBy(pages.visibility(*[F.col(c) for c in "xywh"], WIDTH, HEIGHT).alias("visibility")).agg(F.count("*").alias("n"))


def _names(spark, d):
    o = observed(spark, d)
    return o.select("page", "ord", pages.accessible_name(*[F.col(c) for c in ("aria_label", "placeholder", "name", "text", "value")]).alias("name"))


def _signatures(spark, d):
    e = elements(spark, d)
    null = F.lit(None).cast("string")
    return e.select("row_id", pages.signature(F.col("tag"), F.col("role"), null, F.col("semanticName"), F.col("url"), F.col("parent_id"), F.col("target_id")).alias("signature"))


def _state_hash(spark, d):
    e = elements(spark, d)
    return pages.state_hash(e, "page", "ord", F.col("tag"), F.col("role"), F.col("text"))


def _first_200(spark, d):
    e = elements(spark, d).where("actionable")
    return pages.first_per_page(e, "page", "ord", 200).select("page", "row_id")


def _visible_text(spark, d):
    lines = table(spark, d, "observations").select("obs_id", F.posexplode("observation.visibleText").alias("pos", "line"))
    lines = lines.select("obs_id", "pos", pages.squeeze(F.col("line"), 200).alias("line")).where(F.length("line") > 1)
    return pages.first_per_page(lines, "obs_id", "pos", 100)


def _children(spark, d):
    e = table(spark, d, "dom_elements").where("target_id is not null and coalesce(parent_id, '') != ''")
    pairs = e.select("perception_cycle_id", "parent_id", "target_id").distinct()
    return pairs.groupBy("perception_cycle_id", "parent_id").agg(F.count("*").alias("n_children"), F.array_join(F.array_sort(F.collect_list("target_id")), ",").alias("children"))


def _lookup(spark, d):
    """Each row's parent element, first by row_id."""
    e = elements(spark, d)
    first = e.where("target_id is not null").groupBy("page", F.col("target_id").alias("parent_id")).agg(F.min_by("tag", "row_id").alias("parent_tag"), F.min_by("role", "row_id").alias("parent_role"))
    return e.select("row_id", "page", "parent_id").join(first, ["page", "parent_id"], "left").select("row_id", "parent_tag", "parent_role")


def _interactive_ancestor(spark, d):
    """The nearest element above that is interactive, carried down by the walk of the hierarchy."""
    tag, role = F.min_by("tag", "row_id"), F.min_by("role", "row_id")
    wanted = tag.isin(*pages.INTERACTIVE_TAGS) | role.isin(*pages.INTERACTIVE_ROLES)
    rows = hierarchy.hierarchy(table(spark, d, "dom_elements"), with_paths=False, mark=F.when(wanted, F.coalesce(tag, F.lit(""))))
    return rows.where("near is not null").select("grp", "node", F.col("near").alias("ancestor"), F.nullif("near_mark", F.lit("")).alias("ancestor_tag"))


def _search(spark, d):
    e = elements(spark, d)
    return pages.element_filter(e, "menu", "button", ("semanticName", "text", "tag", "role", "target_id")).select("row_id", "semanticName", "text")


def _blocks(spark, d):
    return pages.text_blocks(observed(spark, d))


def _block_stats(spark, d):
    b = pages.text_blocks(observed(spark, d))
    o = table(spark, d, "observations").select(F.col("obs_id").alias("page"))
    per = b.groupBy("page").agg(F.count("*").alias("blocks"), F.sum("n_words").alias("words"), F.avg("confidence").alias("c"))
    return o.join(per, "page", "left").select("page", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("words", F.lit(0)).alias("words"), (F.floor(F.coalesce("c", F.lit(0.9)) * 100 + 0.5) / 100).alias("confidence"))


def _password(spark, d):
    o = observed(spark, d).where((F.lower("kind") == "password") & (F.coalesce(F.when(F.col("value") != "", F.col("value")), F.when(F.col("text") != "", F.col("text"))).isNotNull()))
    return o.select("page", "ord", F.lit("ACCOUNT_IDENTIFIER").alias("type"), F.lit(0.99).alias("confidence"))


def _ratios(spark, d):
    e = elements(spark, d).where("w is not null and h is not null")
    return e.select("row_id", ratio_label(F.col("w").cast("double"), F.col("h").cast("double")).alias("ratio"))


def _sizes(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", byte_size(F.octet_length("text")).alias("size"))


def _occlusion(spark, d):
    return pages.occlusion(elements(spark, d).where("x is not null"), WIDTH, HEIGHT).select("row_id", "occlusion")


QUERIES = {
    "dom_roles": _roles,
    "dom_role_histogram": _role_histogram,
    "dom_element_counts": _counts,
    "dom_visibility_classes": _visibility,
    "dom_accessible_names": _names,
    "dom_structural_signatures": _signatures,
    "dom_state_hash": _state_hash,
    "dom_interactive_first_200": _first_200,
    "dom_visible_text_cap": _visible_text,
    "dom_children": _children,
    "dom_parent_lookup": _lookup,
    "dom_interactive_ancestor": _interactive_ancestor,
    "dom_search_filter": _search,
    "dom_occlusion": _occlusion,
    "text_blocks": _blocks,
    "text_blocks_stats": _block_stats,
    "pii_password_fields": _password,
    "aspect_ratio_label": _ratios,
    "byte_size_label": _sizes,
}

_VIS = "CASE WHEN bounds.x IS NULL OR (bounds.width = 0 AND bounds.height = 0) THEN 'HIDDEN' WHEN NOT (bounds.x + bounds.width > 0 AND bounds.x < 1920 AND bounds.y + bounds.height > 0 AND bounds.y < 1080) THEN 'OUTSIDE_VIEWPORT' WHEN bounds.x >= 0 AND bounds.y >= 0 AND bounds.x + bounds.width <= 1920 AND bounds.y + bounds.height <= 1080 THEN 'VISIBLE' ELSE 'PARTIALLY_VISIBLE' END"
_ROLE = (
    "coalesce(nullif(lower(trim(role)), ''), CASE lower(tag) WHEN 'input' THEN 'textbox' "
    + " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in pages.TAG_ROLES.items())
    + " END)"
)
_TAGS = ", ".join(f"'{t}'" for t in pages.INTERACTIVE_TAGS)
_ROLES = ", ".join(f"'{t}'" for t in pages.INTERACTIVE_ROLES)
_OBS = "SELECT obs_id AS page, i - 1 AS ord, observation.elements[i] AS e FROM (SELECT obs_id, observation, unnest(range(1, len(observation.elements) + 1)) AS i FROM observations)"
_SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_BLOCKS = rf"""
SELECT page, CAST(ord AS INTEGER) AS ord, e.target_id AS target_id, e.text AS text, e.bounds.x AS x, e.bounds.y AS y, e.bounds.width AS w, e.bounds.height AS h,
       CAST(len(list_filter(regexp_split_to_array(trim(e.text), '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words
FROM ({_OBS}) WHERE trim(e.text) <> '' AND e.bounds.x IS NOT NULL
"""
_NEAR = ", ".join(f"nullif(left({_SQ.format('e.' + c)}, 100), '')" for c in ("aria_label", "placeholder", "name", "text", "value"))

SQL = {
    "dom_occlusion": f"""
WITH e AS MATERIALIZED (SELECT row_id, perception_cycle_id AS page, bounds.x AS x, bounds.y AS y, bounds.width AS w, bounds.height AS h, {_VIS} AS vis FROM dom_elements WHERE bounds.x IS NOT NULL),
p AS (SELECT *, unnest([0, 1, 2]) AS spot FROM e WHERE vis IN ('VISIBLE', 'PARTIALLY_VISIBLE')),
q AS (SELECT *, x + w * [0.5::DOUBLE, 0.25, 0.75][spot + 1] AS px, y + h * [0.5::DOUBLE, 0.25, 0.75][spot + 1] AS py FROM p),
hit AS (SELECT q.row_id, count(DISTINCT spot) AS n, bool_or(spot = 0) AS mid FROM q JOIN e o ON o.page = q.page AND o.row_id > q.row_id AND o.w > 0 AND o.h > 0 AND px BETWEEN o.x AND o.x + o.w AND py BETWEEN o.y AND o.y + o.h
  AND NOT (o.x >= q.x AND o.y >= q.y AND o.x + o.w <= q.x + q.w AND o.y + o.h <= q.y + q.h) GROUP BY 1)
SELECT e.row_id, CASE WHEN vis NOT IN ('VISIBLE', 'PARTIALLY_VISIBLE') THEN 'UNKNOWN' WHEN NOT coalesce(mid, false) THEN 'NOT_OCCLUDED' WHEN n < 3 THEN 'PARTIALLY_OCCLUDED' ELSE 'OCCLUDED' END AS occlusion FROM e LEFT JOIN hit USING (row_id)""",
    "dom_roles": f"SELECT row_id, {_ROLE} AS role FROM dom_elements",
    "dom_role_histogram": "SELECT perception_cycle_id, role, count(*) AS n FROM dom_elements WHERE role IS NOT NULL GROUP BY 1, 2",
    "dom_element_counts": f"""
WITH e AS (
  SELECT perception_cycle_id AS page, {_VIS} AS vis, coalesce(actionable, true) AS en,
         coalesce(lower(tag) IN ({_TAGS}), false) OR coalesce({_ROLE} IN ({_ROLES}), false) AS clickable,
         coalesce(lower(tag) IN ('textarea', 'input'), false) AS editable
  FROM dom_elements)
SELECT page, count(*) AS total, count(*) FILTER (vis IN ('VISIBLE', 'PARTIALLY_VISIBLE')) AS visible,
       count(*) FILTER ((clickable OR editable) AND en) AS interactive, count(*) FILTER (editable AND en) AS editable,
       count(*) FILTER (clickable AND en) AS clickable, count(*) FILTER (clickable OR editable) AS focusable
FROM e GROUP BY 1""",
    "dom_visibility_classes": f"SELECT {_VIS} AS visibility, count(*) AS n FROM dom_elements GROUP BY 1",
    "dom_accessible_names": f"SELECT page, CAST(ord AS INTEGER) AS ord, coalesce({_NEAR}) AS name FROM ({_OBS})",
    "dom_structural_signatures": """
SELECT row_id, coalesce(tag, '') || '|' || coalesce(role, '') || '||' || left(coalesce("semanticName", ''), 40) || '|' || coalesce(url, '')
       || '|parent:' || coalesce(parent_id, '') || '|path:' || coalesce(target_id, '') AS signature FROM dom_elements""",
    "dom_state_hash": """
WITH p AS (SELECT perception_cycle_id AS page, count(*) AS n, string_agg(concat_ws('|', coalesce(tag, ''), coalesce(role, ''), coalesce(text, '')), ';' ORDER BY row_id) AS s FROM dom_elements GROUP BY 1)
SELECT page, n, lower(lpad(to_hex(list_reduce(list_transform(string_split(s, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (h * 33 + c) & 4294967295, CAST(5381 AS BIGINT))), 8, '0')) AS hash FROM p""",
    "byte_size_label": r"""
WITH s AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN regexp_replace(printf('%.2f', n / 1024.0::DOUBLE), '\.?0+$', '') || ' KB' ELSE regexp_replace(printf('%.2f', n / 1048576.0::DOUBLE), '\.?0+$', '') || ' MB' END AS size FROM s""",
    "dom_interactive_first_200": "SELECT perception_cycle_id AS page, row_id FROM (SELECT *, row_number() OVER (PARTITION BY perception_cycle_id ORDER BY row_id) AS rn FROM dom_elements WHERE actionable) WHERE rn <= 200",
    "dom_visible_text_cap": rf"""
WITH l AS (SELECT obs_id, CAST(i - 1 AS INTEGER) AS pos, left({_SQ.format('observation."visibleText"[i]')}, 200) AS line
           FROM (SELECT obs_id, observation, unnest(range(1, len(observation."visibleText") + 1)) AS i FROM observations))
SELECT obs_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY pos) AS rn FROM l WHERE length(line) > 1) WHERE rn <= 100""",
    "dom_children": """
SELECT perception_cycle_id, parent_id, count(*) AS n_children, string_agg(target_id, ',' ORDER BY target_id) AS children
FROM (SELECT DISTINCT perception_cycle_id, parent_id, target_id FROM dom_elements WHERE target_id IS NOT NULL AND coalesce(parent_id, '') <> '') GROUP BY 1, 2""",
    "dom_parent_lookup": """
WITH f AS (SELECT perception_cycle_id AS c, target_id AS t, arg_min(struct_pack(tag := tag, role := role), row_id) AS x FROM dom_elements WHERE target_id IS NOT NULL GROUP BY 1, 2)
SELECT e.row_id, f.x.tag AS parent_tag, f.x.role AS parent_role FROM dom_elements e LEFT JOIN f ON f.c = e.perception_cycle_id AND f.t = e.parent_id""",
    "dom_interactive_ancestor": _DOM
    + f""", own AS (SELECT perception_cycle_id AS c, target_id AS t, arg_min(struct_pack(tag := tag, role := role), row_id) AS x FROM dom_elements WHERE target_id IS NOT NULL GROUP BY 1, 2),
u AS (SELECT c, t AS node, unnest(path) AS above, unnest(range(1, len(path) + 1)) AS level FROM r WHERE depth > 0)
SELECT u.c AS grp, u.node, arg_max(u.above, u.level) AS ancestor, arg_max(own.x.tag, u.level) AS ancestor_tag FROM u JOIN own ON own.c = u.c AND own.t = u.above
WHERE u.above <> u.node AND (own.x.tag IN ({_TAGS}) OR own.x.role IN ({_ROLES})) GROUP BY 1, 2""",
    "dom_search_filter": """
SELECT row_id, "semanticName", text FROM dom_elements
WHERE role = 'button' AND (contains(lower(coalesce("semanticName", '')), 'menu') OR contains(lower(coalesce(text, '')), 'menu') OR contains(lower(coalesce(tag, '')), 'menu')
      OR contains(lower(coalesce(target_id, '')), 'menu') OR contains(lower(role), 'menu'))""",
    "text_blocks": f"SELECT *, floor((0.85 + least(0.14, n_words * 0.02)) * 100 + 0.5) / 100 AS confidence FROM ({_BLOCKS})",
    "text_blocks_stats": f"""
WITH p AS (SELECT page, count(*) AS blocks, CAST(sum(n_words) AS BIGINT) AS words, avg(floor((0.85 + least(0.14, n_words * 0.02)) * 100 + 0.5) / 100) AS c FROM ({_BLOCKS}) GROUP BY 1)
SELECT obs_id AS page, coalesce(blocks, 0) AS blocks, coalesce(words, 0) AS words, floor(coalesce(c, 0.9) * 100 + 0.5) / 100 AS confidence FROM observations LEFT JOIN p ON p.page = obs_id""",
    "pii_password_fields": f"SELECT page, CAST(ord AS INTEGER) AS ord, 'ACCOUNT_IDENTIFIER' AS type, 0.99::DOUBLE AS confidence FROM ({_OBS}) WHERE lower(e.type) = 'password' AND coalesce(nullif(e.value, ''), nullif(e.text, '')) IS NOT NULL",
    "aspect_ratio_label": """
WITH e AS (SELECT row_id, bounds.width AS w, bounds.height AS h, floor(bounds.width / nullif(bounds.height, 0)::DOUBLE * 10000 + 0.5) / 10000 AS n FROM dom_elements WHERE bounds.width IS NOT NULL AND bounds.height IS NOT NULL),
g AS (SELECT *, greatest(gcd(w, h), 1) AS d FROM e)
SELECT row_id, CASE WHEN w = 0 OR h = 0 THEN '—' WHEN abs(n - 16 / 9::DOUBLE) <= 0.035 THEN 'approximately 16:9' WHEN abs(n - 1.6::DOUBLE) <= 0.035 THEN 'approximately 16:10'
  WHEN abs(n - 4 / 3::DOUBLE) <= 0.035 THEN 'approximately 4:3' WHEN abs(n - 1.5::DOUBLE) <= 0.035 THEN 'approximately 3:2' WHEN abs(n - 1.25::DOUBLE) <= 0.035 THEN 'approximately 5:4'
  WHEN abs(n - 1::DOUBLE) <= 0.035 THEN 'approximately 1:1' WHEN abs(n - 21 / 9::DOUBLE) <= 0.035 THEN 'approximately 21:9' WHEN abs(n - 32 / 9::DOUBLE) <= 0.035 THEN 'approximately 32:9'
  WHEN abs(n - 9 / 16::DOUBLE) <= 0.035 THEN 'approximately 9:16' WHEN abs(n - 9 / 21::DOUBLE) <= 0.035 THEN 'approximately 9:21'
  WHEN w // d <= 60 AND h // d <= 60 THEN (w // d) || ':' || (h // d) ELSE n || ':1' END AS ratio FROM g""",
}
