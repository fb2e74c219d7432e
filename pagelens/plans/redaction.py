"""Queries of the page gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.operators import redaction as r
from pagelens.plans.pages import observed
from pagelens.session import spread
from pagelens.sources.tables import table


def lines(spark, d):
    """Visible lines of observations and lines of documents, with an empty context."""
    o = table(spark, d, "observations").select(F.lit("o").alias("kind"), F.col("obs_id").alias("page"), F.posexplode("observation.visibleText").alias("ord", "text"))
    t = spread(table(spark, d, "documents")).select(F.lit("d").alias("kind"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return o.unionByName(t).where("text is not null")


def _found(df, context):
    return df.withColumn("d", F.explode(r.detections(F.col("text"), context))).select("*", "d.*").drop("d")


def _detect(spark, d):
    return _found(lines(spark, d), F.lit("")).select("kind", "page", "ord", "type", "value", "confidence")


def _counts(spark, d):
    return _detect(spark, d).groupBy("kind", "type").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"))


def _harmless(spark, d):
    return lines(spark, d).groupBy("kind", r.harmless(F.col("text"), F.lit("")).alias("harmless")).agg(F.count("*").alias("n"))


def _elements(spark, d):
    o = observed(spark, d)
    context = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("tag", "kind", "name", "placeholder", "aria_label")]))
    return _found(o.withColumn("context", context).drop("value"), F.col("context")).select("page", "ord", "target_id", "type", "value", "confidence", "x")


def _merged(spark, d):
    a = _elements(spark, d).select("page", "type", "value", "confidence", F.lit("DOM").alias("source"), (F.col("ord") * 2).alias("ord"), "x")
    b = _detect(spark, d).where("kind = 'o'").select("page", "type", "value", "confidence", F.lit("TEXT").alias("source"), (F.col("ord") * 2 + 1).alias("ord"), F.lit(None).cast("int").alias("x"))
    return r.merged(a.unionByName(b))


def _redacted(spark, d):
    """Lines of the observations with findings in their visible lines, each with these replaced.

    Its SQL asks for no more; `_page_lines` and `_page_elements` redact whole pages.
    """
    per_page = _detect(spark, d).where("kind = 'o'").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "type", "value"))).alias("found"))
    o = lines(spark, d).where("kind = 'o'").join(per_page, "page")
    return o.select("page", "ord", r.redacted(F.col("text"), F.transform("found", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value")))).alias("text"))


def _page_found(spark, d):
    """(kind, page, found): a page's findings in elements' texts and values, then in lines, each type and value once.

    found: array of type, value and target, in the order they are to be replaced in.
    """
    o = observed(spark, d)
    fields = [F.coalesce(F.trim(c), F.lit("")) for c in ("text", "value", "placeholder")]
    context = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("tag", "kind", "name")], fields[2], F.coalesce("aria_label", F.lit("")), fields[0]))
    text, value = fields[:2]
    hits = lambda t: F.transform(r.detections(t, F.col("context")), lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value")))
    # what stands in a password field is secret whatever its form
    secret = F.when(F.lower("kind") == "password", F.array(F.struct(F.lit("ACCOUNT_IDENTIFIER").alias("type"), F.coalesce(F.nullif(value, F.lit("")), text).alias("value"))))
    none = F.array().cast("array<struct<type:string,value:string>>")
    o = o.withColumn("context", context).withColumn("all", F.concat(hits(text), F.when(value != text, hits(value)).otherwise(none), F.coalesce(secret, none)))
    a = o.select(F.lit("o").alias("kind"), "page", F.lit(0).alias("part"), "ord", "target_id", F.posexplode("all").alias("i", "d"))
    lined = lines(spark, d).select("kind", "page", F.lit(1).alias("part"), "ord", F.lit(None).cast("string").alias("target_id"), F.posexplode(r.detections(F.col("text"), F.lit(""))).alias("i", "d"))
    keys = ["kind", "page", F.col("d")["type"].alias("type"), F.col("d")["value"].alias("value")]
    at = F.struct("part", "ord", "i", F.col("target_id").alias("target"))
    first = a.select(*keys, at.alias("at")).unionByName(lined.select(*keys, at.alias("at"))).where("value != ''").groupBy("kind", "page", "type", "value").agg(F.min("at").alias("at"))
    per_page = first.groupBy("kind", "page").agg(F.array_sort(F.collect_list(F.struct("at", "type", "value"))).alias("found"))
    return per_page.withColumn("found", F.transform("found", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), x["at"]["target"].alias("target"))))


def _page_lines(spark, d):
    """All lines of observations and documents with every value found on their page replaced."""
    t = lines(spark, d).join(_page_found(spark, d), ["kind", "page"], "left")
    return t.select("kind", "page", "ord", F.when(F.col("found").isNull(), F.col("text")).otherwise(r.redacted(F.col("text"), F.col("found"))).alias("text"))


def _page_elements(spark, d):
    """The four fields of all elements with every value found on their page replaced.

    An element that a finding came from shows nothing else either: its value, and a text
    or name in which nothing was replaced, go as a whole.
    """
    o = observed(spark, d).select("page", "ord", "target_id", "text", "name", "value", "placeholder")
    o = o.join(_page_found(spark, d).where("kind = 'o'").drop("kind"), "page", "left")
    clean = lambda c: F.when(F.col("found").isNull(), c).otherwise(r.redacted(c, F.col("found")))
    whole = F.coalesce((F.col("target_id") != "") & F.exists("found", lambda x: x["target"].eqNullSafe(F.col("target_id"))), F.lit(False))
    hidden = F.lit(r.OTHER_PLACEHOLDER)
    shown = lambda c: F.when(whole & ~c.contains("[REDACTED"), hidden).otherwise(c)
    text, name = (shown(clean(F.coalesce(c, F.lit("")))) for c in ("text", "name"))
    value = clean(F.col("value"))
    return o.select("page", "ord", "target_id", text.alias("text"), name.alias("name"), F.when(whole & (value != ""), hidden).otherwise(value).alias("value"), clean(F.col("placeholder")).alias("placeholder"))


def _gate(spark, d):
    """The gate over unredacted documents: which of them would be stopped, and why."""
    t = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    values = F.transform(r.detections(F.col("text"), F.lit("")), lambda x: x["value"])
    leaks = r.gate(F.col("text"), F.col("text"), values)
    return t.select("doc_id", F.array_join(leaks, ",").alias("leaks"), (F.size(leaks) == 0).alias("passed"))


TRUTH = (
    ("Contact: ana@example.com", "", "EMAIL", 0.92, "ana@example.com"), ("ana@example.com", "input email", "EMAIL", 0.98, "ana@example.com"), ("Card 4111 1111 1111 1111", "", "CREDIT_CARD_LIKE", 0.99, "4111 1111 1111 1111"),
    ("4111111111111111", "", None, None, None), ("4111111111111111", "card number", "CREDIT_CARD_LIKE", 0.99, "4111111111111111"), ("Card 4111 1111 1111 1112", "", None, None, None), ("Card 4111 1111 1111 1112", "card", "CREDIT_CARD_LIKE", 0.89, "4111 1111 1111 1112"),
    ("Visa****-****-****-4242", "card", "CREDIT_CARD_LIKE", 0.94, "****-****-****-4242"), ("Visa ****-****-****-4242", "card", None, None, None), ("+1 (663) 555-6869", "", "PHONE", 0.91, "+1 (663) 555-6869"), ("ring (663) 555-6869", "", "PHONE", 0.86, "(663) 555-6869"),
    ("663-555-6869", "", None, None, None), ("663-555-6869", "tel", "PHONE", 0.96, "663-555-6869"), ("host 152.143.123.131", "", "IP_ADDRESS", 0.92, "152.143.123.131"), ("127.0.0.1", "", None, None, None), ("IBAN GB82WEST12345698765432", "", "ACCOUNT_IDENTIFIER", 0.96, "GB82WEST12345698765432"),
    ("Account #: ACC-99812-XY", "", "ACCOUNT_IDENTIFIER", 0.93, "ACC-99812-XY"), ("SSN 078-05-1120", "", "GOVERNMENT_ID_LIKE", 0.97, "078-05-1120"), ("1234 5678 9012", "aadhaar", "GOVERNMENT_ID_LIKE", 0.94, "1234 5678 9012"), ("PAN: ABCDE1234F", "", "GOVERNMENT_ID_LIKE", 0.93, "ABCDE1234F"),
    ("ABCDE1234F", "", None, None, None), ("DOB: 04/07/1988", "", "DATE_OF_BIRTH_LIKE", 0.95, "04/07/1988"), ("DOB: 04/07/2001", "", None, None, None), ("DOB: 04/07/2001", "dob", "DATE_OF_BIRTH_LIKE", 0.95, "04/07/2001"), ("DOB: 04/07/2001", "profile page", "DATE_OF_BIRTH_LIKE", 0.95, "04/07/2001"),
    ("Ship to address 221 Baker Street", "", "POSTAL_ADDRESS", 0.91, "221 Baker Street"), ("221 Baker Street", "", None, None, None), ("zip: 94107-1234", "", "POSTAL_ADDRESS", 0.89, "94107-1234"), ("Patient name: Maria Lopez", "", "PERSON_NAME_LIKE", 0.88, "Maria Lopez"),
    ("https://x.example.com/a?token=abc123&b=1", "", "URL_WITH_SENSITIVE_QUERY", 0.97, "abc123"), ("Invoice 2026-09-04 sent to ana@example.com", "", None, None, None), ("Qty: 12", "", None, None, None), ("$29.99", "", None, None, None), ("a@b.co, c@d.co", "", "EMAIL", 0.92, "a@b.co"),
)


def _truth(spark, d):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(TRUTH)], "n int, text string, context string")
    return rows.withColumn("d", F.explode_outer(r.detections(F.col("text"), F.col("context")))).select("n", "d.type", "d.value", "d.confidence")


QUERIES = {
    "pii_detect_counts": _counts,
    "pii_detect_lines": _detect,
    "pii_detect_elements": _elements,
    "pii_harmless_suppression": _harmless,
    "pii_dedup_sources": _merged,
    "pii_redact_lines": _redacted,
    "pii_redact_page_lines": _page_lines,
    "pii_redact_page_elements": _page_elements,
    "pii_leak_gate": _gate,
    "pii_detectors_truth_table": _truth,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _x(pattern: str, group: int = 0, text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, {group}), '')"


_DIG = r"regexp_replace({0}, '\D', '', 'g')"
_LUHN = (
    f"(length({_DIG}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIG}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIG}), i, 1) AS INTEGER) "
    f"ELSE CASE WHEN 2 * CAST(substr(reverse({_DIG}), i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(reverse({_DIG}), i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(reverse({_DIG}), i, 1) AS INTEGER) END END)) % 10 = 0)"
)
_HARMLESS = f"""(text IS NULL OR text = '' OR (regexp_matches(trim(text), {_q(r.PRICE)}) AND NOT contains(ctx, 'card') AND NOT contains(ctx, 'account')) OR regexp_matches(trim(text), {_q(r.QUANTITY)})
 OR (regexp_matches(trim(text), {_q(r.SKU)}) AND NOT contains(ctx, 'account') AND NOT contains(ctx, 'ssn')) OR regexp_matches(trim(text), {_q(r.LABEL)}) OR (regexp_matches(trim(text), {_q(r.DATE)}) AND NOT regexp_matches(ctx, {_q(r.BIRTH)})))"""


def detect_sql(source: str, keys: str) -> str:
    """Detections of a source with keys, text and ctx (lower case)."""
    x = f"SELECT *, {_x(r.EMAIL)} AS email, coalesce({_x(r.CARD)}, {_x(r.MASKED_CARD)}) AS card, {_x(r.PHONE)} AS phone, {_x(r.IP)} AS ip, {_x(r.IBAN)} AS iban, {_x(r.ACCOUNT, 1)} AS account, {_x(r.SSN)} AS ssn, CASE WHEN regexp_matches(ctx, '{r.ID_WORDS}') THEN {_x(r.AADHAAR)} END AS aadhaar, {_x(r.PAN)} AS pan, {_x(r.DOB, 1)} AS dob, CASE WHEN regexp_matches(lower(ctx || ' ' || text), '{r.ADDRESS_WORDS}') THEN {_x(r.STREET)} END AS street, {_x(r.ZIP, 1)} AS zip, coalesce({_x(r.NAME_A, 1)}, {_x(r.NAME_B, 1)}) AS name, {_x(r.SECRET_URL, 1)} AS url, regexp_matches(ctx, '{r.CARD_WORDS}') AS pays, regexp_matches(ctx, '{r.PHONE_WORDS}') AS calls FROM ({source}) WHERE NOT {_HARMLESS}"
    one = lambda kind, value, score, where: f"SELECT {keys}, '{kind}' AS type, {value} AS value, CAST({score} AS DOUBLE) AS confidence FROM x WHERE {where}"
    luhn = _LUHN.replace("{0}", "card")
    masked = "contains(card, '*')"
    parts = [
        one("EMAIL", "email", "CASE WHEN contains(ctx, 'email') THEN 0.98 ELSE 0.92 END", "email IS NOT NULL"),
        one("CREDIT_CARD_LIKE", "card", f"CASE WHEN NOT {masked} AND {luhn} THEN 0.99 WHEN {masked} THEN 0.94 ELSE 0.89 END", f"card IS NOT NULL AND ((NOT {masked} AND {luhn}) OR ({masked} AND pays) OR (pays AND length({_DIG.format('card')}) >= 15))"),
        one("PHONE", "phone", "CASE WHEN calls THEN 0.96 WHEN starts_with(phone, '+') THEN 0.91 ELSE 0.86 END", f"length({_DIG.format('phone')}) >= 10 AND (calls OR starts_with(phone, '+') OR contains(phone, '('))"),
        one("IP_ADDRESS", "ip", "0.92", "ip NOT IN ('0.0.0.0', '127.0.0.1')"),
        one("ACCOUNT_IDENTIFIER", "coalesce(iban, account)", "CASE WHEN iban IS NOT NULL THEN 0.96 ELSE 0.93 END", "coalesce(iban, account) IS NOT NULL"),
        one("GOVERNMENT_ID_LIKE", "coalesce(ssn, aadhaar, pan)", "CASE WHEN ssn IS NOT NULL THEN 0.97 WHEN aadhaar IS NOT NULL THEN 0.94 ELSE 0.93 END", "coalesce(ssn, aadhaar, pan) IS NOT NULL"),
        one("DATE_OF_BIRTH_LIKE", "dob", "0.95", "dob IS NOT NULL"),
        one("POSTAL_ADDRESS", "coalesce(street, zip)", "CASE WHEN street IS NOT NULL THEN 0.91 ELSE 0.89 END", "coalesce(street, zip) IS NOT NULL"),
        one("PERSON_NAME_LIKE", "name", "0.88", "name IS NOT NULL"),
        one("URL_WITH_SENSITIVE_QUERY", "url", "0.97", "url IS NOT NULL"),
    ]
    return f"WITH x AS ({x}) " + " UNION ALL ".join(parts)


_OLINES = "SELECT 'o' AS kind, obs_id AS page, CAST(i - 1 AS INTEGER) AS ord, observation.\"visibleText\"[i] AS text, '' AS ctx FROM (SELECT obs_id, observation, unnest(range(1, len(observation.\"visibleText\") + 1)) AS i FROM observations)"
_DLINES = "SELECT 'd' AS kind, doc_id AS page, CAST(i - 1 AS INTEGER) AS ord, l[i] AS text, '' AS ctx FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_LINES = f"SELECT * FROM ({_OLINES} UNION ALL {_DLINES}) WHERE text IS NOT NULL"
_DETECT = detect_sql(_LINES, "kind, page, ord")
_ELEMENTS = "SELECT page, ord, e.target_id AS target_id, e.text AS text, e.bounds.x AS x, lower(concat_ws(' ', coalesce(e.tag, ''), coalesce(e.type, ''), coalesce(e.name, ''), coalesce(e.placeholder, ''), coalesce(e.aria_label, ''))) AS ctx FROM (SELECT obs_id AS page, CAST(i - 1 AS INTEGER) AS ord, observation.elements[i] AS e FROM (SELECT obs_id, observation, unnest(range(1, len(observation.elements) + 1)) AS i FROM observations))"
_ELEM = detect_sql(_ELEMENTS, "page, ord, target_id, x")
_HOLD = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in r.PLACEHOLDERS.items()) + f" ELSE '{r.OTHER_PLACEHOLDER}' END"
_IMG = "(contains(text, 'data:image/png;base64') OR contains(text, 'data:image/jpeg;base64'))"
_STRUCT = ", ".join(f"'{s}'" for s in r.STRUCTURAL)

SQL = {
    "pii_detect_lines": _DETECT,
    "pii_detect_counts": f"SELECT kind, type, count(*) AS n, count(DISTINCT page) AS pages FROM ({_DETECT}) GROUP BY 1, 2",
    "pii_detect_elements": _ELEM,
    "pii_harmless_suppression": f"SELECT kind, {_HARMLESS} AS harmless, count(*) AS n FROM ({_LINES}) GROUP BY 1, 2",
    "pii_dedup_sources": f"""
WITH f AS (SELECT page, type, value, confidence, 'DOM' AS source, ord * 2 AS o, x FROM ({_ELEM}) UNION ALL SELECT page, type, value, confidence, 'TEXT', ord * 2 + 1, NULL FROM ({_DETECT}) WHERE kind = 'o'),
s AS (SELECT page, type, value, source, min(o) AS o FROM f GROUP BY 1, 2, 3, 4)
SELECT f.page, f.type, f.value, arg_min(f.confidence, f.o) AS confidence, (SELECT string_agg(s.source, '+' ORDER BY s.o) FROM s WHERE s.page = f.page AND s.type = f.type AND s.value = f.value) AS sources,
  arg_min(f.x, f.o) FILTER (f.x IS NOT NULL) AS x FROM f GROUP BY 1, 2, 3""",
    "pii_redact_lines": f"""
WITH p AS (SELECT page, list(struct_pack(o := ord, t := type, v := value) ORDER BY ord, type, value) AS found FROM ({_DETECT}) WHERE kind = 'o' GROUP BY 1)
SELECT l.page, l.ord, list_reduce(p.found.list_transform(lambda f: struct_pack(o := f.o, t := f.t, v := f.v)), lambda a, f: struct_pack(o := 0, t := replace(a.t, f.v, {_HOLD.format('f.t')}), v := ''), struct_pack(o := 0, t := l.text, v := '')).t AS text
FROM ({_OLINES}) l JOIN p USING (page) WHERE l.text IS NOT NULL""",
    "pii_leak_gate": f"""
WITH d AS ({detect_sql("SELECT doc_id, text, '' AS ctx FROM documents WHERE text IS NOT NULL", "doc_id, text")}),
v AS (SELECT doc_id, list('value:' || left(value, 3) || '***' ORDER BY CASE type {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(("EMAIL", "CREDIT_CARD_LIKE", "PHONE", "IP_ADDRESS", "ACCOUNT_IDENTIFIER", "GOVERNMENT_ID_LIKE", "DATE_OF_BIRTH_LIKE", "POSTAL_ADDRESS", "PERSON_NAME_LIKE", "URL_WITH_SENSITIVE_QUERY")))} END) AS l
  FROM d WHERE length(value) >= 3 AND lower(value) NOT IN ({_STRUCT}) AND contains(text, value) GROUP BY 1),
g AS (SELECT doc_id, list_filter([CASE WHEN {_IMG} THEN 'image_in_text' END, CASE WHEN {_IMG} THEN 'image_in_payload' END, CASE WHEN regexp_matches(text, {_q(r.API_KEY)}) THEN 'api_key' END, CASE WHEN regexp_matches(text, {_q(r.FULL_CARD)}) THEN 'card_number' END], lambda z: z IS NOT NULL) AS a FROM documents WHERE text IS NOT NULL)
SELECT g.doc_id, coalesce(array_to_string(list_concat(a, coalesce(l, [])), ','), '') AS leaks, len(a) + len(coalesce(l, [])) = 0 AS passed FROM g LEFT JOIN v USING (doc_id)""",
    "pii_detectors_truth_table": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {_q(t) if t else 'CAST(NULL AS VARCHAR)'}, {_q(v) if v else 'CAST(NULL AS VARCHAR)'}, {f'CAST({c} AS DOUBLE)' if c else 'CAST(NULL AS DOUBLE)'})" for i, (_, _, t, c, v) in enumerate(TRUTH))
    + ") AS t(n, type, value, confidence)",
}
