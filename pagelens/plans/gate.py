"""Queries of a whole page's way through the gate: redaction, plan of regions, and what may leave."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.columns import fixed
from pagelens.operators import boxes
from pagelens.operators import redaction as r
from pagelens.plans.pages import elements, observed
from pagelens.plans.redaction import _HOLD, _LINES, _STRUCT, _page_elements, _page_found, _page_lines, _q, detect_sql
from pagelens.plans.sessions import SQL as SESSIONS
from pagelens.plans.sessions import _avatars
from pagelens.sources.tables import table

WIDTH, HEIGHT = 1920, 1080


def _sensitive(spark, d):
    """The elements of each page that a finding came from."""
    f = _page_found(spark, d).where("kind = 'o'").select("page", F.explode("found").alias("x")).where("x.target != ''")
    return f.select("page", F.col("x.target").alias("target_id")).distinct()


def _counters(spark, d):
    """Findings of each page by type, and how many came from an element."""
    f = _page_found(spark, d).select("kind", "page", F.explode("found").alias("x"))
    return f.groupBy("kind", F.col("x.type").alias("type")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("x.target") != "", F.lit(False))).alias("targets"), F.count_distinct("page").alias("pages"))


def _payload(spark, d):
    """What would still stop each observation once its lines and elements are redacted; titles are only checked."""
    sep = '","'
    texts = _page_lines(spark, d).where("kind = 'o'").groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), sep).alias("lines"))
    own = _page_elements(spark, d).join(observed(spark, d).select("page", "ord", "aria_label"), ["page", "ord"])
    one = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("text", "name", "value", "placeholder", "aria_label")])
    fields = own.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), sep).alias("fields"))
    values = _page_found(spark, d).where("kind = 'o'").select("page", F.array_sort(F.transform("found", lambda x: x["value"])).alias("values"))
    o = table(spark, d, "observations").select(F.col("obs_id").alias("page"), F.coalesce("observation.title", F.lit("")).alias("title"), F.coalesce("observation.url", F.lit("")).alias("url"))
    o = o.join(texts, "page", "left").join(fields, "page", "left").join(values, "page", "left")
    corpus = F.concat(F.col("title"), F.lit(sep), F.coalesce("lines", F.lit("")), F.lit(sep), F.coalesce("fields", F.lit("")))
    leaks = r.gate(corpus, F.concat("url", F.lit(sep), corpus), F.coalesce("values", F.array().cast("array<string>")))
    return o.select("page", F.array_join(leaks, ",").alias("leaks"), (F.size(leaks) == 0).alias("passed"))


IMAGES = (
    ("", "", None, 3, ""), ("data:a", "data:a", True, 0, ""), ("data:a", "data:a", True, 2, "image_unredacted"), ("data:a", "data:b", False, 2, "image_uncertified"), ("data:a", "data:a", False, 1, "image_unredacted,image_uncertified"),
    ("data:a", "data:b", None, 1, ""), ("data:a", "data:b", True, 1, ""), (None, None, None, 0, ""), (None, "data:b", False, 0, "image_uncertified"),
)


def _images(spark, d):
    rows = spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(IMAGES)], "n int, raw string, clean string, certified boolean, found int")
    leaks = r.image_leaks(F.col("raw"), F.col("clean"), F.col("certified"), F.col("found"))
    return rows.select("n", F.array_join(leaks, ",").alias("leaks"))


def _candidates(spark, d):
    """Boxes that may hold a face: photos of the page, and clusters of skin in their image where there is one.

    A cluster (derived from small boxes, as the tables hold no images) takes the first image
    of its page that holds its centre, edges included; else it stands for itself. Boxes below
    16 pixels or above half of the page in either direction or 0.45 of its area are left out.
    """
    e = elements(spark, d).where("w > 0 and h > 0")
    images = e.where("tag = 'img'").select("page", F.col("row_id").alias("id"), "ord", "x", "y", "w", "h")
    cluster = e.where("tag in ('span', 'div') and (x * 7 + y * 13 + w) % 11 = 0").select("page", F.col("row_id").alias("cluster"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"), *[F.col(c).alias(f"c{c}") for c in "xywh"])
    inside = boxes.containing(cluster.withColumnRenamed("cluster", "id"), images).select("id", "inside")
    of = images.select(F.col("id").alias("inside"), "x", "y", "w", "h")
    skin = cluster.join(inside, cluster.cluster == inside.id, "left").join(of, "inside", "left")
    skin = skin.select("page", F.lit("SKIN").alias("source"), F.col("cluster").alias("id"), *[F.coalesce(c, f"c{c}").alias(c) for c in "xywh"])
    photos = _avatars(spark, d).join(e.select("row_id", "x", "y", "w", "h"), "row_id").select("page", F.lit("DOM").alias("source"), F.col("row_id").alias("id"), "x", "y", "w", "h")
    small = (F.col("w") >= 16) & (F.col("h") >= 16) & (F.col("w") <= WIDTH // 2) & (F.col("h") <= HEIGHT // 2) & (F.col("w") * F.col("h") < 0.45 * WIDTH * HEIGHT)
    return photos.unionByName(skin).where(small)


def _faces(spark, d):
    """Candidates of each page by falling confidence (derived from the box), ties in order of their ids."""
    c = _candidates(spark, d).withColumn("confidence", fixed((F.col("x") * 31 + F.col("y") * 17 + F.col("w") * 7 + F.col("h") * 3) % 100 / 100.0, 2))
    place = F.row_number().over(W.partitionBy("page").orderBy(F.col("confidence").desc(), "source", "id"))
    return c.select("page", "source", "id", "x", "y", "w", "h", "confidence", place.alias("place"))


def _plan(spark, d):
    """The regions to cover on each observed page: texts found in elements, and faces of the capture's page."""
    o = table(spark, d, "observations").where("perception_cycle_id is not null").select(F.col("obs_id").alias("page"), F.col("perception_cycle_id").alias("cycle"))
    text = _page_found(spark, d).where("kind = 'o'").select("page", F.explode("found").alias("f")).where("f.target != ''").groupBy("page", F.col("f.type").alias("type"), F.col("f.target").alias("target_id")).agg(F.count("*").alias("n"))
    box = observed(spark, d).where("target_id is not null").groupBy("page", "target_id").agg(F.min_by(F.struct("x", "y", "w", "h"), "ord").alias("b"))
    text = text.join(box, ["page", "target_id"]).select("page", "type", F.lit("TEXT").alias("source"), "b.*")
    faces = o.join(_faces(spark, d).withColumnRenamed("page", "cycle"), "cycle").select("page", F.lit("face").alias("type"), "source", "x", "y", "w", "h")
    both = text.unionByName(faces)
    return both.groupBy("page", "type", "source").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("w"), F.lit(0)).cast("long") * F.coalesce(F.col("h"), F.lit(0))).alias("area"))


def _only_faces(spark, d):
    return _plan(spark, d).where("type = 'face'").groupBy("source").agg(F.sum("n").alias("n"), F.sum("area").alias("area"))


QUERIES = {
    "pii_sensitive_targets": _sensitive,
    "pii_counters": _counters,
    "pii_gate_payload": _payload,
    "pii_gate_images": _images,
    "face_candidates": _candidates,
    "faces_by_confidence": _faces,
    "redaction_plan": _plan,
    "redaction_plan_faces": _only_faces,
}

_TYPES = ("EMAIL", "CREDIT_CARD_LIKE", "PHONE", "IP_ADDRESS", "ACCOUNT_IDENTIFIER", "GOVERNMENT_ID_LIKE", "DATE_OF_BIRTH_LIKE", "POSTAL_ADDRESS", "PERSON_NAME_LIKE", "URL_WITH_SENSITIVE_QUERY")
_INDEX = "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(_TYPES)) + " END"
_E = "SELECT obs_id AS page, CAST(i - 1 AS INTEGER) AS ord, observation.elements[i] AS e FROM (SELECT obs_id, observation, unnest(range(1, len(observation.elements) + 1)) AS i FROM observations)"
_T = "coalesce(trim(e.{0}), '')"
_SRC = f"""SELECT page, ord, e.target_id AS target_id, lower(coalesce(e.type, '')) AS pw, {_T.format("text")} AS text, {_T.format("value")} AS value,
  lower(concat_ws(' ', coalesce(e.tag, ''), coalesce(e.type, ''), coalesce(e.name, ''), {_T.format("placeholder")}, coalesce(e.aria_label, ''), {_T.format("text")})) AS ctx FROM ({_E})"""
_ALL = f"SELECT 'o' AS kind, page, 0 AS part, ord, 0 AS base, target_id, text, ctx FROM ({_SRC}) UNION ALL SELECT 'o', page, 0, ord, 10, target_id, value, ctx FROM ({_SRC}) WHERE value <> text UNION ALL SELECT kind, page, 1, ord, 0, NULL, text, '' FROM ({_LINES})"
_FOUND = f"""
WITH hit AS MATERIALIZED (SELECT kind, page, part, ord, base + {_INDEX} AS i, target_id, type, value FROM ({detect_sql(_ALL, "kind, page, part, ord, base, target_id")})
  UNION ALL SELECT 'o', page, 0, ord, 20, target_id, 'ACCOUNT_IDENTIFIER', coalesce(nullif(value, ''), text) FROM ({_SRC}) WHERE pw = 'password'),
one AS (SELECT kind, page, type, value, min(struct_pack(part := part, ord := ord, i := i, target := target_id)) AS pt FROM hit WHERE value <> '' GROUP BY 1, 2, 3, 4),
found AS MATERIALIZED (SELECT kind, page, list(struct_pack(t := type, v := value) ORDER BY pt.part, pt.ord, pt.i, type, value) AS f, list_sort(list(value)) AS values, list(pt.target) AS targets FROM one GROUP BY 1, 2)
"""
_CLEAN = "list_reduce(list_prepend(struct_pack(t := '', v := {0}), f), lambda a, x: struct_pack(t := '', v := replace(a.v, x.v, " + _HOLD.format("x.t") + "))).v"
_L = _FOUND + f", lines AS (SELECT l.kind, l.page, l.ord, CASE WHEN f IS NULL THEN l.text ELSE {_CLEAN.format('l.text')} END AS text FROM ({_LINES}) l LEFT JOIN found USING (kind, page))"
_SHOWN = "CASE WHEN whole AND NOT contains({0}, '[REDACTED') THEN '" + r.OTHER_PLACEHOLDER + "' ELSE {0} END"
_EL = _L + f""", raw AS (SELECT p.page, p.ord, e, f, coalesce(e.target_id <> '' AND list_contains(targets, e.target_id), false) AS whole FROM ({_E}) p LEFT JOIN (SELECT * FROM found WHERE kind = 'o') g USING (page)),
clean AS (SELECT page, ord, e.target_id AS target_id, e.aria_label AS aria, whole, {", ".join(f"CASE WHEN f IS NULL OR {x} IS NULL THEN {x} ELSE {_CLEAN.format(x)} END AS {n}" for n, x in (("text", "coalesce(e.text, '')"), ("name", "coalesce(e.name, '')"), ("value", "e.value"), ("placeholder", "e.placeholder")))} FROM raw),
els AS (SELECT page, ord, target_id, aria, {_SHOWN.format("text")} AS text, {_SHOWN.format("name")} AS name, CASE WHEN whole AND value <> '' THEN '{r.OTHER_PLACEHOLDER}' ELSE value END AS value, placeholder FROM clean)
"""
_GATE_VALUES = f"list_transform(list_filter(coalesce(values, []), lambda v: length(v) >= 3 AND lower(v) NOT IN ({_STRUCT}) AND contains(corpus, v)), lambda v: 'value:' || left(v, 3) || '***')"
_IMG = "(contains({0}, 'data:image/png;base64') OR contains({0}, 'data:image/jpeg;base64'))"
_CANDIDATES = f"""
WITH avatars AS ({SESSIONS["dom_avatars"]}),
e AS MATERIALIZED (SELECT perception_cycle_id AS page, row_id AS id, tag, bounds.x AS x, bounds.y AS y, bounds.width AS w, bounds.height AS h FROM dom_elements WHERE bounds.width > 0 AND bounds.height > 0),
s AS (SELECT * FROM e WHERE tag IN ('span', 'div') AND (x * 7 + y * 13 + w) % 11 = 0),
i AS (SELECT s.id, arg_min(struct_pack(x := m.x, y := m.y, w := m.w, h := m.h), m.id) AS b FROM s JOIN e m ON m.page = s.page AND m.tag = 'img' AND s.x + s.w / 2::DOUBLE BETWEEN m.x AND m.x + m.w AND s.y + s.h / 2::DOUBLE BETWEEN m.y AND m.y + m.h GROUP BY 1),
u AS (SELECT e.page, 'DOM' AS source, e.id, x, y, w, h FROM avatars a JOIN e ON e.id = a.row_id UNION ALL
  SELECT s.page, 'SKIN', s.id, coalesce(b.x, s.x), coalesce(b.y, s.y), coalesce(b.w, s.w), coalesce(b.h, s.h) FROM s LEFT JOIN i USING (id)),
cand AS (SELECT * FROM u WHERE w >= 16 AND h >= 16 AND w <= 960 AND h <= 540 AND w * h < 0.45 * 1920 * 1080),
face AS (SELECT *, floor((x * 31 + y * 17 + w * 7 + h * 3) % 100 / 100.0::DOUBLE * 100 + 0.5) / 100 AS confidence FROM cand)
"""
_PLAN = f"""
WITH t AS ({_FOUND} SELECT page, type, target, count(*) AS n FROM (SELECT page, type, pt.target AS target FROM one WHERE kind = 'o' AND pt.target <> '') GROUP BY 1, 2, 3),
b AS (SELECT page, e.target_id AS target, arg_min(e.bounds, ord) AS b, min(ord) AS o FROM ({_E}) WHERE e.target_id IS NOT NULL GROUP BY 1, 2),
g AS (SELECT first.page, first.target, e.bounds AS b FROM b first JOIN ({_E}) x ON x.page = first.page AND x.ord = first.o),
p AS (SELECT page, type, 'TEXT' AS source, b.width AS w, b.height AS h FROM t JOIN g USING (page, target) UNION ALL
  SELECT obs_id, 'face', source, w, h FROM observations o JOIN ({_CANDIDATES} SELECT * FROM face) f ON f.page = o.perception_cycle_id)
SELECT page, type, source, count(*) AS n, CAST(sum(CAST(coalesce(w, 0) AS BIGINT) * coalesce(h, 0)) AS BIGINT) AS area FROM p GROUP BY 1, 2, 3"""

SQL = {
    "pii_redact_page_lines": _L + "SELECT kind, page, ord, text FROM lines",
    "pii_redact_page_elements": _EL + "SELECT page, ord, target_id, text, name, value, placeholder FROM els",
    "pii_sensitive_targets": _FOUND + "SELECT DISTINCT page, pt.target AS target_id FROM one WHERE kind = 'o' AND pt.target <> ''",
    "pii_counters": _FOUND + "SELECT kind, type, count(*) AS n, count(*) FILTER (pt.target <> '') AS targets, count(DISTINCT page) AS pages FROM one GROUP BY 1, 2",
    "pii_gate_payload": _EL
    + f""", ln AS (SELECT page, string_agg(text, '","' ORDER BY ord) AS t FROM lines WHERE kind = 'o' GROUP BY 1),
fl AS (SELECT page, string_agg(concat_ws(' ', coalesce(text, ''), coalesce(name, ''), coalesce(value, ''), coalesce(placeholder, ''), coalesce(aria, '')), '","' ORDER BY ord) AS t FROM els GROUP BY 1),
c AS (SELECT obs_id AS page, coalesce(observation.url, '') AS url, coalesce(observation.title, '') || '","' || coalesce(ln.t, '') || '","' || coalesce(fl.t, '') AS corpus, values
  FROM observations LEFT JOIN ln ON ln.page = obs_id LEFT JOIN fl ON fl.page = obs_id LEFT JOIN (SELECT * FROM found WHERE kind = 'o') k ON k.page = obs_id),
l AS (SELECT page, list_concat(list_filter([CASE WHEN {_IMG.format("corpus")} THEN 'image_in_text' END, CASE WHEN {_IMG.format("corpus")} OR {_IMG.format("url")} THEN 'image_in_payload' END,
  CASE WHEN regexp_matches(url || '","' || corpus, {_q(r.API_KEY)}) THEN 'api_key' END, CASE WHEN regexp_matches(url || '","' || corpus, {_q(r.FULL_CARD)}) THEN 'card_number' END], lambda z: z IS NOT NULL), {_GATE_VALUES}) AS l FROM c)
SELECT page, coalesce(array_to_string(l, ','), '') AS leaks, len(l) = 0 AS passed FROM l""",
    "pii_gate_images": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x[4]}')" for i, x in enumerate(IMAGES)) + ") AS t(n, leaks)",
    "face_candidates": _CANDIDATES + "SELECT page, source, id, x, y, w, h FROM cand",
    "faces_by_confidence": _CANDIDATES + "SELECT page, source, id, x, y, w, h, confidence, CAST(row_number() OVER (PARTITION BY page ORDER BY confidence DESC, source, id) AS INTEGER) AS place FROM face",
    "raster_redacted": _CANDIDATES + "SELECT page, count(*) AS boxes, true AS inside, true AS outside FROM face GROUP BY 1",
    "redaction_plan": _PLAN,
    "redaction_plan_faces": f"SELECT source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(area) AS BIGINT) AS area FROM ({_PLAN}) WHERE type = 'face' GROUP BY 1",
}
