"""Personal information in free text by bootstrapped contextual extraction.

One pass over the texts emits candidates: spans whose shape allows a type, with the
lexical patterns they stand in (the words before and after, the shape of a number, the
parts of a name). A few seeds are labelled by unmistakable contexts - a title before a
name, an international prefix, "passport no." or "order no." before a number. From them
Spark scores the graph of patterns and instances in rounds: a pattern is as good as the
share of its instances that are labelled with a type, an instance takes the type its
patterns agree on, and so confident patterns label instances no seed stands beside.

Scoring works on signatures (equal candidates counted once), which are few compared to
the texts. Addresses are bootstrapped in a pass of their own: from a few street words the
contexts of addresses are learned, and from these further street words, whose places in
the texts then count as addresses. E-mail addresses are told by their shape alone.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.session import kept

ROUNDS = 3
#: A part of a name is known from this evidence on (labelled / (labelled + 0.5)); a context
#: of names is confident from this share of instances with a known given name on.
KNOWN, CONTEXT = 0.6, 0.6

# Words that seed the patterns, by type.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "mlle", "monsieur", "madame", "senor", "senora", "sr", "sra", "signor", "signora", "sig", "pan", "pani", "господин", "госпожа", "пользователю", "meneer", "mevrouw", "dhr", "mevr", "senhor", "senhora"}
PHONE_WORDS = {"tel", "phone", "telephone", "telefon", "telefonisch", "telefoon", "mobile", "cell", "call", "sms", "appelez", "llame"}
ID_WORDS = {"ssn", "passport", "dni", "nie", "ausweis", "ausweisnummer", "personalausweis", "pesel", "identiteitsnummer", "cidadao", "identidad", "dowodu", "удостоверения", "identita", "sociale", "security", "identite"}
OTHER_WORDS = {"order", "ref", "sku", "build", "ts", "bbox", "cycle", "sha", "px"}
#: Words no name starts with or consists of, in the languages of the texts.
FUNCTION_WORDS = frozenset(
    "a an and are as at by das de dem den der des die do du een ein eine einen el en er es for from het i il im in is it je la las le les lo los mit na nach no non o of on or os para por que se si the to u un una und une von was we wir y you z zu"
    " der die das ein eine dieser this that our both why when once please there step some nobody someone before after according thanks last".split()
)

_LETTER = "A-Za-zÀ-ɏЀ-ӿ\u0300-\u036f"
_CAP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĘĚŁŃŇŐŘŚŠŤŮŰŸŹŻŽА-ЯЁ"
# Patterns start with a plain class of signs and look behind it, which is what re finds fast.
_AT = re.compile(r"[@＠%&\[({](?:(?<=[@＠])|(?<=%)40|(?<=&)(?:#64|#x40|commat);|(?<=[\[({])\s?[aA][tT]\s?[\])}])")
_DOT = r"(?:\.|\s{0,2}[\[({]\s?[dD][oO][tT]\s?[\])}]\s{0,2})"
_LOCAL = re.compile(r"[\w.+\u0300-\u036f-]")
_DOMAIN = re.compile(rf"[^\W_][\w\u0300-\u036f-]*(?:{_DOT}[\w\u0300-\u036f-]+)*{_DOT}[A-Za-z][A-Za-z-]+(?!\w)")
_FILE = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|css|js|html?|json|zip|pdf|mp4)$", re.I)
# A street's name and number stand in one of four forms, of which the words tell the street:
# 1 number name word, 2 number word name, 3 word name number, 4 name with an ending, number.
STREET_SEEDS = frozenset(
    [("1", w) for w in ("street", "st", "avenue", "road", "lane")]
    + [("2", w) for w in ("rue", "avenue", "boulevard")]
    + [("3", w) for w in ("calle", "c", "avda", "plaza", "rua", "travessa", "avenida", "via", "viale", "piazza", "ul", "al", "ул")]
    + [("4", w) for w in ("sse", "str", "weg", "atz", "aat", "cht", "aan")]
)
STREET_ROUNDS = 2
#: A context is one of addresses from this many known ones and this share of its candidates on; a word
#: is a street's from this many ways in such contexts and this share of its ways on.
CONTEXT_LEAST, CONTEXT_SHARE, WORD_LEAST, WORD_SHARE = 2, 0.2, 3, 0.6
#: Words in fewer than 1 / RAREST of all known ways aren't kept, so there are at most RAREST.
RAREST = 20_000
#: Abbreviations to which their full stop belongs.
DOTTED = frozenset(("st",))
_L = r"[^\W\d_]"
_OWN = rf"[{_CAP}](?:{_L}|['’\u0300-\u036f-])*"
_HOUSE = re.compile(r"\d(?<![\w./-]\d)\d{0,4}(?:[a-z](?!\w)|\s?(?:bis|ter)(?!\w))?,?\s+(?=[^\W\d_])", re.I)
_STREET_WORD = re.compile(rf"({_L}(?:{_L}|['’\u0300-\u036f-])*)(\.?)(\s*)")
_LINK = re.compile(r"\s+(?:(?:de\s+la|des|du|de)\s+|[dl]['’])?", re.I)
_OWN_WORD = re.compile(_OWN)
_LAST = re.compile(r"\d(?<=[\s.°º]\d)\d{0,3}[a-zа-я]?(?![\w-])")
_DOOR = r",?\s+(?i:n\.?\s?[º°]\s?|(?:д\.|дом)\s*)?$"
_ENDING = re.compile(rf"({_OWN})(\.?)\s+$")
_PARTS = r"(?:(?:d[aeo]s?|del(?:la)?|de\s+la)\s+)?"
_AHEAD = [re.compile(rf"(?<!\w)(?:({_L}+)\s+)?({_L}{{1,10}})(?:\.\s*|/\s*|\s+){_PARTS}{_OWN}{_DOOR}"), re.compile(rf"(?<!\w)({_L}{{1,10}})(?:\.\s*|/\s*|\s+){_PARTS}({_OWN})\s+{_OWN}{_DOOR}")]
_COMMA = re.compile(rf",\s+[{_CAP}]")
_NUMBER = re.compile(r"[\d+(](?<![\w.,:/=+#-][\d+(])(?<!\d \d)(?:(?<=\d)|\d)(?:(?:\r\n|[-./\s]|\s?\(|\)\s?-?)?\d){6,}")
_NUMBER_AFTER = re.compile(r"(?<==)\d(?:[-\s]?\d)*")
_ALNUM = re.compile(r"[A-Z0-9](?<![\w.-][A-Z0-9])(?:(?<=[A-Z])[A-Z]\s?\d{6}\s?[A-Z]|[A-Z0-9]{7,11})(?![\w-])")
_WORD = rf"[{_CAP}](?:[{_LETTER}'’]+)"
_SURNAME = rf"(?:(?:von|van|de|di|da|del|der|du|dos|la|VON|VAN|DE|DI|DA|DEL|DER|DU|DOS|LA)\s+)?{_WORD}(?:-{_WORD})?"
_START = rf"[{_CAP}](?<![\w'’-][{_CAP}])"
_REST = rf"[{_LETTER}'’]+"
_NAME = re.compile(rf"{_START}(?=({_REST})\s+((?:[{_CAP}]\.\s+)?)({_SURNAME})(?![\w]))")
_REVERSED = re.compile(rf"{_START}(?=({_REST}(?:-{_WORD})?),\s+({_WORD})((?:\s+[{_CAP}]\.)?)(?![\w'’-]))")
_INITIAL = re.compile(rf"{_START}(?=(\.)\s{{0,2}}((?:[{_CAP}]\.\s{{0,2}})?)({_SURNAME})(?![\w]))")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_MARKS = re.compile("[̀-ͯ]")
_DIGITS = re.compile(r"\d+")


@functools.lru_cache(100_000)
def plain(word: str) -> str:
    """Lower case without accents, digits as 0."""
    word = word.casefold()
    if not word.isascii():
        word = _MARKS.sub("", unicodedata.normalize("NFKD", word)).replace("ł", "l")
    return _DIGITS.sub("0", word)


def _around(text: str, start: int, end: int) -> tuple[list[str], str]:
    """The tokens before (four at most) and the two after, all plain."""
    before = [plain(t) for t in _TOKEN.findall(text[max(0, start - 40) : start])]
    if start > 40 and before and text[start - 41].isalnum():
        before = before[1:]
    after = [plain(t) for t in _TOKEN.findall(text[end : end + 40])][:2]
    return before[-4:], " ".join(after) or "$"


def streets(t: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, form, word, other) of whatever may be an address, with the word that would tell it.

    other: a word beside it that explains the candidate away if it is a street's itself.
    """
    for m in _HOUSE.finditer(t):
        one = last = _STREET_WORD.match(t, m.end())
        for _ in range(4):
            if not last[0][0].isupper() or last[2] or not last[3] or not (w := _STREET_WORD.match(t, last.end())):
                break
            word = plain(w[1])
            yield m.start(), w.end(2 if word in DOTTED else 1), "1", word, plain(last[1])
            last = w
        if (link := _LINK.match(t, one.end(1))) and (own := _OWN_WORD.match(t, link.end())):
            yield m.start(), own.end(), "2", plain(one[1]), plain(own[0])
    for m in _LAST.finditer(t):
        sign = t[m.start() - 2 : m.start() - 1]
        if not (sign.isalpha() or sign in ",.\u00ba\u00b0" or sign.isspace()):
            continue
        lead = max(0, m.start() - 80)
        before = t[lead : m.start()]
        last = before.rstrip().rsplit(None, 1)[-1:]  # the word before must be a name, or "no." or "д." before a door
        if not last or not (last[0] != last[0].lower() or last[0][0] in "nд\u00ba\u00b0" or "." in last[0]):
            continue
        if (w := _ENDING.search(before, len(before.rstrip()) - len(last[0]))) and len(end := plain(w[1])) > 5 and (end[-3:] == "str") == bool(w[2]):
            yield lead + w.start(), m.end(), "4", end[-3:], ""
        if w := _AHEAD[0].search(before):
            yield lead + w.start(2), m.end(), "3", plain(w[2]), plain(w[1] or "")
        if w := _AHEAD[1].search(before):
            yield lead + w.start(), m.end(), "3", plain(w[1]), plain(w[2])


def _told(form: str, word: str, other: str, known: frozenset) -> bool:
    return (form, word) in known and ("1" if form == "2" else form, other) not in known


def candidates(text: str, known: frozenset = STREET_SEEDS) -> Iterator[tuple]:
    """(start, end, kind, form, a, b, left, right, seed) of each candidate in a text.

    kind: EMAIL, ADDRESS, NUM or NAME; a and b: given and family name (plain), or the shape
    of a number and the two words before it; form: "strict" for a name with a comma, a
    middle initial or a particle, of which both parts, or the given name and the words on
    either side, must be known; seed: a type or NONE where the context is unmistakable, else ''.
    known: forms and words of streets.
    """
    t = text.replace("\\n", "\x00\x00").replace("\\t", "\x00\x00").replace("\\r", "\x00\x00") if "\\" in text else text
    taken: list[tuple[int, int]] = []
    for m in _AT.finditer(t):
        bracket = m[0][0] in "[({"  # which may stand apart by a blank or a line break on either side
        before, after = m.span()
        while bracket and m.start() - before < 2 and t[before - 1 : before].isspace():
            before -= 1
        while bracket and after - m.end() < 2 and t[after : after + 1].isspace():
            after += 1
        domain = _DOMAIN.match(t, after)
        if not domain or _FILE.search(domain[0]):
            continue
        start = end = before - (t[before - 1 : before] == "\n")
        while start and _LOCAL.match(t[start - 1]):
            start -= 1
        if start < end and t[end - 1] != ".":
            taken.append((start, domain.end()))
            yield (start, domain.end(), "EMAIL", "plain", "", "", "", "", "EMAIL")
    mask = bytearray(len(t))  # the signs that belong to a finding
    for start, end in taken:
        mask[start:end] = b"\x01" * (end - start)
    numbers = _DIGITS.search(t)
    found = [(start, end) for start, end, *rest in streets(t) if _told(*rest, known)] if numbers else []
    for start, end in sorted(found, key=lambda x: (x[0] - x[1], x[0])):  # the longest first
        if mask.find(1, start, end) < 0:
            mask[start:end] = b"\x01" * (end - start)
            taken.append((start, end))
            yield (start, end, "ADDRESS", "plain", "", "", "", "", "ADDRESS")
    if taken:
        pieces, upto = [], 0
        for a, b in sorted(taken):
            pieces += [t[upto:a], "\x01" * (b - max(a, upto))]
            upto = max(b, upto)
        t = "".join([*pieces, t[upto:]])
    mask = bytearray(len(t))  # the signs of numbers so far
    for pattern in (_NUMBER, _NUMBER_AFTER, _ALNUM) if numbers else ():
        for m in pattern.finditer(t):
            start, end = m.span()
            if "\n" in m[0] and t[end : end + 1] in (".", ")") and len(m[0].rsplit("\n", 1)[1]) <= 3:
                end = start + m[0].rindex("\n")  # what follows the line break numbers the next line
            value = t[start:end].rstrip()
            end = start + len(value)
            digits = sum(c.isdigit() for c in value)
            if pattern is _ALNUM and (digits < 2 or digits == len(value) or not re.search(r"\d\d", value)):
                continue
            if pattern is not _ALNUM and not 7 <= digits <= 15 or end < len(t) and (t[end].isalnum() or t[end] == "_") or mask.find(1, start, end) >= 0:
                continue
            mask[start:end] = b"\x01" * (end - start)
            shape = re.sub(r"\s+", " ", re.sub("[A-Za-z]", "A", re.sub(r"\d", "9", value)))
            before, right = _around(t, start, end)
            words = set(before[-3:])
            seed = ""
            if words & ID_WORDS:
                seed = "ID_NUMBER"
            elif words & OTHER_WORDS or right.startswith("px"):
                seed = "NONE"
            elif value[0] == "+" or words & PHONE_WORDS:
                seed = "PHONE"
            yield start, end, "NUM", "plain", shape, " ".join(before[-2:]) or "^", " ".join(before[-3:]) or "^", right, seed
    for pattern, direct in ((_NAME, True), (_INITIAL, True), (_REVERSED, False))[: 3 if _COMMA.search(t) else 2]:
        for m in pattern.finditer(t):
            one, two, three = m[0] + m[1], m[2], m[3]
            given, family, end = (one, three, m.end(3)) if direct else (two, one, m.end(3) if three else m.end(2))
            last = family.rsplit(None, 1)[-1].split("-")[0]
            g, f = plain(given), plain(last)
            if g in FUNCTION_WORDS or f in FUNCTION_WORDS or g in TITLES or f in TITLES or len(f) < 3:
                continue
            before, right = _around(t, m.start(), end)
            form = "plain" if direct and (pattern is _INITIAL or not two and " " not in family) else "strict"
            title = [w for w in before if w != "."][-1:]
            counted = title == ["ms"] and before[-2:-1] == ["0"]  # milliseconds
            seed = "NAME" if title and title[0] in TITLES and not counted and pattern is _NAME else ""
            yield m.start(), end, "NAME", form, "initial" if pattern is _INITIAL else g, f, " ".join(before[-2:]) or "^", right, seed


#: What a text must have to hold a candidate: a digit, a sign of an address, or two capitals.
MAY_HOLD = r"(?s)[\p{Nd}@＠%&\[({]|\p{Lu}.*\p{Lu}"
UNIT = "table_name string, row_id long, field string, part int, text string"
CANDIDATE = "table_name string, row_id long, field string, part int, start int, stop int, value string, kind string, form string, a string, b string, l string, r string, seed string"
_NAMES = [c.split()[0] for c in CANDIDATE.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 8]


def street_words(units: DataFrame, rounds: int = STREET_ROUNDS) -> frozenset:
    """(form, word) of the words that tell streets: the seeds, and those learned from the contexts they share.

    Different ways to stand in a text are counted, not rows. The words learned are at most RAREST.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # of this batch; distinct again below
        known: set[str] = set()  # texts that were read before

        for batch in batches:
            for text in set(batch.column(0).to_pylist()) - known:
                if len(text) < 400 and len(known) < 100_000:
                    known.add(text)
                for start, end, form, word, other in streets(text):
                    before, right = _around(text, start, end)
                    seen.add((form, word, other, " ".join(before[-2:]), "" if right == "$" else right))
            columns = list(zip(*seen, strict=True)) if seen else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["form", "word", "other", "l", "r"])
            seen.clear()

    ways = kept(units.select("text").where(F.col("text").rlike("[0-9]")).mapInArrow(run, "form string, word string, other string, l string, r string").distinct())
    spark = units.sparkSession
    seeds = spark.createDataFrame(sorted(STREET_SEEDS), "form string, word string")
    known = seeds
    for _ in range(rounds):
        mine = known.select("form", "word", F.lit(True).alias("told"))
        beside = known.select(F.col("form").alias("x"), F.col("word").alias("other"), F.lit(True).alias("away"))
        live = ways.withColumn("x", F.when(F.col("form") == "2", "1").otherwise(F.col("form"))).join(beside, ["x", "other"], "left").where("away is null").join(mine, ["form", "word"], "left")
        live = live.select("form", "word", "told", F.xxhash64("form", "word", "other", "l", "r").alias("w"), F.explode(F.array(F.concat(F.lit("l"), "l"), F.concat(F.lit("r"), "r"))).alias("c")).where(F.length("c") > 1)
        contexts = live.groupBy("c").agg(F.count("*").alias("all"), F.count("told").alias("near")).where("all >= 3")
        contexts = contexts.select("c", ((F.col("near") >= CONTEXT_LEAST) & (F.col("near") >= CONTEXT_SHARE * (F.col("all") + 1))).alias("good"))
        each = live.join(contexts, "c").groupBy("form", "word", "w").agg(F.max("good").alias("good"))
        words = each.groupBy("form", "word").agg(F.count("*").alias("all"), F.count_if("good").alias("good"))
        words = kept(words.where((F.col("good") >= WORD_LEAST) & (F.col("good") >= WORD_SHARE * (F.col("all") + 1))))
        total = words.agg(F.sum("good")).first()[0] or 0
        known = seeds.union(words.where(F.col("good") * RAREST >= total).select("form", "word")).distinct()
    return frozenset((r.form, r.word) for r in known.collect())


def extract(units: DataFrame, words: frozenset = STREET_SEEDS) -> DataFrame:
    """Candidates of all units; short texts that repeat are read once in a task. words: of streets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple]] = {}
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, text in enumerate(batch.column(4).to_pylist()):
                spans = known.get(text)
                if spans is None:
                    spans = [(s, e, " ".join(text[s:e].split()), *rest) for s, e, *rest in candidates(text, words)]
                    if len(text) < 400 and len(known) < 100_000:
                        known[text] = spans
                if spans:
                    rows += spans
                    at += [i] * len(spans)
            own = [batch.column(c).take(pa.array(at, pa.int32())) for c in range(4)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES[4:]]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(columns, _KINDS[4:], strict=True)]], _NAMES)

    return units.where(F.col("text").rlike(MAY_HOLD)).mapInArrow(run, CANDIDATE)


def units_of(documents: DataFrame | None = None, elements: DataFrame | None = None, observations: DataFrame | None = None) -> DataFrame:
    """(table_name, row_id, field, part, text) of every text; null and empty ones have none."""

    def one(df: DataFrame, table: str, key: str, field: str, text: Column, part: Column | None = None) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.col(key).cast("long").alias("row_id"), F.lit(field).alias("field"), (F.lit(0) if part is None else part).alias("part"), text.alias("text")).where(F.length("text") > 0)

    parts = []
    if documents is not None:
        parts.append(one(documents, "documents", "doc_id", "text", F.col("text")))
    if elements is not None:
        parts += [one(elements, "dom_elements", "row_id", f, F.col(f)) for f in ("text", "semanticName")]
    if observations is not None:
        lines = observations.select("obs_id", F.posexplode("observation.visibleText").alias("pos", "line"))
        parts.append(one(lines, "observations", "obs_id", "visibleText", F.col("line"), F.col("pos")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


ROLES = ("a", "b", "l", "r")
TYPES = ("NAME", "PHONE", "ID_NUMBER", "NONE")


def _things(sig: DataFrame) -> DataFrame:
    """sig with `thing`: whether a pair is likely the name of a thing, as its first word keeps to one second word.

    Ways to stand in a text are counted, not rows, so copies of a text have no say. Where
    a title stands before both words (together or each in another name) it is a person.
    """
    names = sig.where("kind = 'NAME'")
    titled = lambda part: F.max(F.col("seed") == "NAME").alias(f"{part}_titled")
    givens = names.groupBy("kind", "a").agg(F.count("*").alias("g_ways"), titled("a"))
    families = names.groupBy("kind", "b").agg(titled("b"))
    pairs = names.groupBy("kind", "a", "b").agg(F.count("*").alias("p_ways"))
    keeps = (F.col("a") != "initial") & (F.col("p_ways") >= 5) & (F.col("p_ways") > 0.2 * F.col("g_ways")) & ~(F.col("a_titled") & F.col("b_titled"))
    sig = sig.withColumn("_a", F.when(F.col("a") == "initial", F.concat(F.lit("\0"), F.pmod(F.xxhash64("b"), F.lit(1000)))).otherwise(F.col("a")))  # "initial" matches none and would be hot
    both = sig.join(givens.withColumnRenamed("a", "_a"), ["kind", "_a"], "left").join(families, ["kind", "b"], "left").join(pairs, ["kind", "a", "b"], "left")
    return both.select("kind", "form", *ROLES, "n", "seed", F.coalesce(keeps, F.lit(False)).alias("thing"))


def scored(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, a, b, l, r, label) of each signature after the rounds of scoring."""
    sig = found.where(F.col("kind").isin("NUM", "NAME")).groupBy("kind", "form", *ROLES).agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    sig = kept(_things(kept(sig)).withColumn("label", F.col("seed")))
    sums = [F.sum(F.when(F.col("label") == t, F.col("n")).otherwise(0)).alias(t) for t in TYPES]
    for _ in range(rounds):
        # given names first: a context is judged by the share of its instances that start with a known one
        is_named = F.sum(F.when(F.col("label") == "NAME", F.col("n")).otherwise(0))
        givens = sig.where("kind = 'NAME'").groupBy(F.lit("NAME").alias("kind"), "a").agg(is_named.alias("g_name"))
        base = sig.join(givens, ["kind", "a"], "left")
        base = base.withColumn("given", F.coalesce((F.col("a") != "initial") & (F.col("g_name") / (F.col("g_name") + 0.5) >= KNOWN), F.lit(False))).withColumn("known", F.col("given") & ~F.col("thing"))
        base = kept(base)
        each = base.select("kind", "n", "label", "known", F.explode(F.array(*[F.struct(F.lit(x).alias("role"), F.col(x).alias("pattern")) for x in ROLES])).alias("p")).select("kind", "n", "label", "known", "p.*")
        graph = each.groupBy("kind", "role", "pattern").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("known") | (F.col("label") == "NAME"), F.col("n")).otherwise(0)).alias("near"), *sums)
        # a name's part counts by its labelled instances, its context by their share; a number's pattern by the share of each type among labelled ones
        # a word like "order" explains its number; the number's shape is hardly to blame
        none = F.when((F.col("kind") == "NUM") & (F.col("role") == "a"), F.col("NONE") * 0.1).otherwise(F.col("NONE"))
        graph = graph.withColumn("NONE", none)
        told = F.col("PHONE") + F.col("ID_NUMBER") + F.col("NONE") + 0.5
        name = F.when(F.col("role") == "b", F.col("NAME") / (F.col("NAME") + 0.5)).otherwise(F.col("near") / (F.col("total") + 2))
        graph = graph.select("kind", "role", "pattern", F.when(F.col("kind") == "NAME", name).otherwise(0.0).alias("NAME"), *[(F.col(t) / told).alias(t) for t in TYPES[1:]])
        edge = (F.col("kind") == "NUM") & F.col("pattern").isin("^", "$")  # the end of a text says nothing of a number
        edge = edge | (F.col("kind") == "NAME") & (F.col("role") == "a")  # given names were judged above
        graph = kept(graph.where("NAME + PHONE + ID_NUMBER + NONE > 0").where(~edge))
        far = base.withColumn("_i", F.xxhash64("kind", "form", *ROLES))
        each = far.select("_i", "kind", F.explode(F.array(*[F.struct(F.lit(x).alias("role"), F.col(x).alias("pattern")) for x in ROLES])).alias("p")).select("_i", "kind", "p.*").where(~edge)
        told = each.join(graph, ["kind", "role", "pattern"]).groupBy("_i").agg(*[F.max(F.when(F.col("role") == x, F.col(t))).alias(f"{x}_{t}") for x in ROLES for t in TYPES])
        step = far.join(told, "_i", "left")
        s = lambda role, t: F.coalesce(F.col(f"{role}_{t}"), F.lit(0.0))
        family = s("b", "NAME") >= KNOWN
        context = F.greatest(s("l", "NAME"), s("r", "NAME")) >= CONTEXT
        both = (s("l", "NAME") >= CONTEXT) & (s("r", "NAME") >= CONTEXT)
        plain_form = F.col("form") == "plain"
        one_side = (F.col("known") & family) | (plain_form & ((F.col("known") & context) | (family & ((F.col("a") == "initial") | context))))
        is_name = (both & (plain_form | F.col("given"))) | (~F.col("thing") & one_side)
        votes = {t: 1.5 * s("a", t) + 1.5 * s("l", t) + 0.5 * s("r", t) + 0.5 * s("b", t) for t in TYPES[1:]}
        best = F.greatest(*votes.values())
        number = F.when(best < 0.5, "").when(votes["NONE"] == best, "NONE").when(votes["ID_NUMBER"] == best, "ID_NUMBER").otherwise("PHONE")
        new = F.when(F.col("seed") != "", F.col("seed")).when(F.col("kind") == "NAME", F.when(is_name, "NAME").otherwise("")).otherwise(number)
        sig = kept(step.select("kind", "form", *ROLES, "n", "seed", "thing", new.alias("label")))
    return sig.select("kind", "form", *ROLES, "label")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each name of a text that no better one overlaps: direct before reversed, longer, earlier."""
    for batch in batches:
        rows = []
        for *key, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ranks = [("," in x["value"], x["start"] - x["stop"], x["start"]) for x in names]
            longest = max(x["stop"] - x["start"] for x in names)
            worse = set()
            for i, x in enumerate(names):  # by start, so those that overlap stand near
                j = i - 1
                while j >= 0 and names[j]["start"] > x["start"] - longest:
                    if names[j]["stop"] > x["start"]:
                        worse.add(i if ranks[j] < ranks[i] else j)
                    j -= 1
            rows += [(*key, x["start"], x["stop"], x["value"], x["label"]) for i, x in enumerate(names) if i not in worse]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["table_name", "row_id", "field", "part", "start", "stop", "value", "label"])


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their findings replaced, each text built once from its pieces."""
    for batch in batches:
        out = []
        for text, found in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            pieces, at = [], 0
            for x in sorted(found or (), key=lambda x: (x["start"], x["stop"])):
                if x["start"] >= at:
                    pieces += [text[at : x["start"]], f"[{x['pii_type']}]"]
                    at = x["stop"]
            out.append("".join([*pieces, text[at:]]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.string())], ["table_name", "row_id", "field", "part", "text"])


def spans(units: DataFrame) -> DataFrame:
    """(table_name, row_id, field, part, start, stop, value, pii_type) of every finding.

    Where a name in either order overlaps one in direct order, the latter stays.
    """
    found = kept(extract(units, street_words(units)))
    labels = scored(found).where(~F.col("label").isin("", "NONE"))
    sure = found.where(F.col("kind").isin("EMAIL", "ADDRESS")).withColumn("label", F.col("kind"))
    told = found.where(F.col("kind").isin("NUM", "NAME")).join(labels, ["kind", "form", *ROLES])
    by = ["table_name", "row_id", "field", "part"]
    named = told.where("kind = 'NAME'").groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("start", "stop", "value", "label"))).alias("s"))
    names = named.mapInArrow(_apart, "table_name string, row_id long, field string, part int, start int, stop int, value string, label string")
    columns = ["table_name", "row_id", "field", "part", "start", "stop", "value", "label"]
    return sure.select(*columns).unionAll(told.where("kind = 'NUM'").select(*columns)).unionAll(names.select(*columns)).withColumnRenamed("label", "pii_type")


def found(units: DataFrame) -> DataFrame:
    """One row for each distinct value in a field of a row."""
    return spans(units).select("table_name", "row_id", "field", "pii_type", F.col("value").alias("pii_value")).distinct()


def redacted(units: DataFrame) -> DataFrame:
    """(table_name, row_id, field, part, text): findings replaced by [TYPE], all else as it was."""
    by = ["table_name", "row_id", "field", "part"]
    lists = spans(units).groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("start", "stop", "pii_type"))).alias("s"))
    joined = units.select(*by, "text").join(lists, by, "left")
    return joined.mapInArrow(_rewritten, UNIT)
