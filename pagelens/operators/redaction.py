"""The page gate: contextual detectors with suppression, typed redaction and a fail-closed leak check.

Each detector gives at most one hit a text (the first match). Word edges are those of
ASCII words, written as look-arounds, so an accented letter beside a value is an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, words and scores of the detectors. \b is replaced by ASCII edges.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD = r"\b(?:\d{4}[-\s]?){3}\d{1,4}\b"
MASKED_CARD = r"\b(?:[*]{4}[-\s]?){3}\d{4}\b"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
ACCOUNT = r"(?i)(?:account|routing|iban|wallet|acct)\s*(?:#|no|id)?[:\s]+([A-Z0-9-]*\d[A-Z0-9-]{4,33})"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
AADHAAR = r"\b\d{4}\s\d{4}\s\d{4}\b"
PAN = r"\b[A-Z]{5}\d{4}[A-Z]\b"
DOB = r"(?i)(?:dob|date of birth|born|birthdate)[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"
STREET = r"(?i)\b\d{1,5}\s+[A-Za-z0-9\s.,]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Suite|Ste|Apt)\b"
ZIP = r"(?i)(?:zip|postal)[:\s]+(\d{5}(?:-\d{4})?)"
NAME_A = r"(?i)(?:full\s+name|first\s+name|last\s+name|patient\s+name|customer\s+name|employee\s+name)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"
NAME_B = r"(?i)(?:name|customer|patient|passenger|employee)[:]\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"
SECRET_URL = r"(?i)https?://[^\s]+(?:\?|&)(?:token|apikey|api_key|auth|secret|password|access_token)=([^&\s]+)"
API_KEY = r"\b(?:AIza[0-9A-Za-z_-]{30,35}|sk-[a-zA-Z0-9]{20,})\b"
FULL_CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
CARD_WORDS = "card|credit|debit|visa|mastercard|amex|exp|cvv|cvc|billing"
PHONE_WORDS = "phone|tel|mobile|call|contact|fax|cel|whatsapp"
ID_WORDS = "aadhaar|uidai|identity|gov"
ADDRESS_WORDS = "address|shipping|billing|residence|location"
PRICE = r"(?i)^\$?\s*\d+(?:\.\d{1,2})?\s*(?:USD|EUR|GBP|INR|CAD|AUD|\$)?$"
QUANTITY = r"(?i)^(?:qty|quantity|items?|units?)?[:\s]*\d{1,4}$"
SKU = r"(?i)^(?:sku|item|product|order|part)?[-#\s]*[A-Z0-9]{3,10}$"
LABEL = (
    "(?i)^(?:nav|navigation|menu|settings|profile|account|sign in|log in|submit|confirm|continue|checkout|cart|add to cart|search|filter|sort|next|previous|home|explore|notifications|"
    "repositories|repository|issues|pull requests|pulls|actions|projects|wiki|security|insights|commits|files|code)$"
)
DATE = r"\b(?:20\d\d[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]20\d\d)\b"
BIRTH = r"(?:dob|birth|born|age)\b"
PLACEHOLDERS = {
    "EMAIL": "[REDACTED_EMAIL]", "PHONE": "[REDACTED_PHONE]", "CREDIT_CARD_LIKE": "[REDACTED_CREDIT_CARD]", "ACCOUNT_IDENTIFIER": "[REDACTED_ACCOUNT]", "IP_ADDRESS": "[REDACTED_IP]",
    "POSTAL_ADDRESS": "[REDACTED_ADDRESS]", "DATE_OF_BIRTH_LIKE": "[REDACTED_DOB]", "GOVERNMENT_ID_LIKE": "[REDACTED_GOV_ID]", "PERSON_NAME_LIKE": "[REDACTED_PERSON]", "URL_WITH_SENSITIVE_QUERY": "[REDACTED_SECRET_URL]",
    "face": "[REDACTED_FACE]",
}
OTHER_PLACEHOLDER = "[REDACTED_SENSITIVE]"
STRUCTURAL = ("nav", "navigation", "button", "input", "select", "textarea", "link", "div", "span", "header", "footer", "main", "section", "article", "aside", "form", "label", "menu")


def edges(pattern: str) -> str:
    """The pattern with ASCII word edges where it has \\b: at its start before a word sign, else after one."""
    head, _, rest = pattern.partition(r"\b") if pattern.startswith((r"\b", r"(?i)\b")) else ("", "", pattern)
    if head or pattern.startswith((r"\b", r"(?i)\b")):
        # before the masked card's stars an edge means a word sign before them
        left = r"(?<=[A-Za-z0-9_])" if rest.startswith("(?:[*]") else r"(?<![A-Za-z0-9_])"
        rest = left + rest
    return head + rest.replace(r"\b", r"(?![A-Za-z0-9_])")


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match (or its group), null if there is none."""
    return F.nullif(F.regexp_extract(text, edges(pattern), group), F.lit(""))


def luhn(value: Column) -> Column:
    """Whether the 13 to 19 digits of a value pass the Luhn check."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.coalesce(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), F.lit(False))


def harmless(text: Column, context: Column) -> Column:
    """Prices, quantities, product numbers, labels and dates: texts in which nothing is looked for."""
    t, c = F.trim(text), F.lower(F.coalesce(context, F.lit("")))
    has = lambda *w: F.lit(False) if not w else F.reduce(F.array(*[c.contains(x) for x in w]), F.lit(False), lambda a, x: a | x)
    whole = lambda p: t.rlike(p.removesuffix("$") + r"\z")  # noqa: E731  ($ would also match before a line end)
    return (
        F.when(text.isNull() | (text == ""), True)
        .when(whole(PRICE) & ~has("card", "account"), True)
        .when(whole(QUANTITY), True)
        .when(whole(SKU) & ~has("account", "ssn"), True)
        .when(whole(LABEL), True)
        .when(t.rlike(edges(DATE)) & ~c.rlike(r"(?:dob|birth|born|age)(?![a-z0-9_])"), True)
        .otherwise(False)
    )


def detections(text: Column, context: Column) -> Column:
    """array<struct(type, value, confidence)> of one text in its context, in the detectors' order."""
    c = F.lower(F.coalesce(context, F.lit("")))

    def hit(kind: str, value: Column, confidence: Column | float, accept: Column | None = None) -> Column:
        score = confidence if isinstance(confidence, Column) else F.lit(confidence)
        ok = value.isNotNull() if accept is None else value.isNotNull() & accept
        return F.when(ok, F.struct(F.lit(kind).alias("type"), value.alias("value"), score.cast("double").alias("confidence")))

    email = first(text, EMAIL)
    card = F.coalesce(first(text, CARD), first(text, MASKED_CARD))
    masked, pays = card.contains("*"), c.rlike(CARD_WORDS)
    is_luhn = ~masked & luhn(card)
    phone = first(text, PHONE)
    calls, plus = c.rlike(PHONE_WORDS), phone.startswith("+")
    ip = first(text, IP)
    iban, account = first(text, IBAN), first(text, ACCOUNT, 1)
    ssn, aadhaar, pan = first(text, SSN), first(text, AADHAAR), first(text, PAN)
    aadhaar = F.when(c.rlike(ID_WORDS), aadhaar)
    street, zip_code = first(text, STREET), first(text, ZIP, 1)
    street = F.when(F.lower(F.concat_ws(" ", c, text)).rlike(ADDRESS_WORDS), street)
    name = F.coalesce(first(text, NAME_A, 1), first(text, NAME_B, 1))
    found = F.array_compact(
        F.array(
            hit("EMAIL", email, F.when(c.contains("email"), 0.98).otherwise(0.92)),
            hit("CREDIT_CARD_LIKE", card, F.when(is_luhn, 0.99).when(masked, 0.94).otherwise(0.89), is_luhn | (masked & pays) | (pays & (F.length(F.regexp_replace(card, r"\D", "")) >= 15))),
            hit("PHONE", phone, F.when(calls, 0.96).when(plus, 0.91).otherwise(0.86), (F.length(F.regexp_replace(phone, r"\D", "")) >= 10) & (calls | plus | phone.contains("("))),
            hit("IP_ADDRESS", ip, 0.92, ~ip.isin("0.0.0.0", "127.0.0.1")),
            hit("ACCOUNT_IDENTIFIER", F.coalesce(iban, account), F.when(iban.isNotNull(), 0.96).otherwise(0.93)),
            hit("GOVERNMENT_ID_LIKE", F.coalesce(ssn, aadhaar, pan), F.when(ssn.isNotNull(), 0.97).when(aadhaar.isNotNull(), 0.94).otherwise(0.93)),
            hit("DATE_OF_BIRTH_LIKE", first(text, DOB, 1), 0.95),
            hit("POSTAL_ADDRESS", F.coalesce(street, zip_code), F.when(street.isNotNull(), 0.91).otherwise(0.89)),
            hit("PERSON_NAME_LIKE", name, 0.88),
            hit("URL_WITH_SENSITIVE_QUERY", first(text, SECRET_URL, 1), 0.97),
        )
    )
    return F.when(harmless(text, context), F.array().cast("array<struct<type:string,value:string,confidence:double>>")).otherwise(found)


def placeholder(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair]), kind), F.lit(OTHER_PLACEHOLDER))


def merged(found: DataFrame) -> DataFrame:
    """found (page, type, value, confidence, source, ord, x) to one row for each page, type and value.

    The first in order wins; its box is replaced by the first real one (x not null);
    sources are joined in the order they first appear.
    """
    first_of = found.groupBy("page", "type", "value", "source").agg(F.min("ord").alias("o"), F.min_by("confidence", "ord").alias("c"), F.min_by("x", F.when(F.col("x").isNotNull(), F.col("ord"))).alias("bx"), F.min(F.when(F.col("x").isNotNull(), F.col("ord"))).alias("bo"))
    return first_of.groupBy("page", "type", "value").agg(F.min_by("c", "o").alias("confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "source"))), lambda s: s["source"]), "+").alias("sources"), F.min_by("bx", "bo").alias("x"))


def redacted(text: Column, found: Column) -> Column:
    """text with each value of array<struct(type, value)> replaced literally, in order."""
    return F.aggregate(found, text, lambda acc, d: F.replace(acc, d["value"], placeholder(d["type"])))


def image_leaks(raw: Column, clean: Column, certified: Column, n_sensitive: Column) -> Column:
    """array<string> of what is wrong with the image of a payload; null where nothing is, and for no image.

    raw: the capture as taken; clean: the image to be sent; certified: whether it is marked
    as cleaned (null where the image is a plain text, which can't be marked).
    """
    some = lambda c: F.coalesce(c != "", F.lit(False))
    return F.array_compact(
        F.array(
            F.when(some(clean) & some(raw) & (n_sensitive > 0) & (raw == clean), F.lit("image_unredacted")),
            F.when(some(clean) & (certified == F.lit(False)), F.lit("image_uncertified")),
        )
    )


def gate(corpus: Column, payload: Column, values: Column) -> Column:
    """array<string> of leaks: empty means the payload may leave.

    corpus is the text a reader sees, payload the whole JSON, values the raw values found.
    """
    image = lambda c: c.contains("data:image/png;base64") | c.contains("data:image/jpeg;base64")
    left = F.filter(values, lambda v: (F.length(v) >= 3) & ~F.lower(v).isin(*STRUCTURAL) & F.contains(corpus, v))
    return F.concat(
        F.array_compact(
            F.array(
                F.when(image(corpus), F.lit("image_in_text")),
                F.when(image(payload), F.lit("image_in_payload")),
                F.when(payload.rlike(edges(API_KEY)), F.lit("api_key")),
                F.when(payload.rlike(edges(FULL_CARD)), F.lit("card_number")),
            )
        ),
        F.transform(left, lambda v: F.concat(F.lit("value:"), F.left(v, F.lit(3)), F.lit("***"))),
    )
