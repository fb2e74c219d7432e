"""Document and segment languages: averaged hashed subword embeddings, linear softmax.

A sentence is the average of the embeddings of its words' subwords (the word and its
letter 2- to 5-grams, hashed into `BUCKETS` rows); a linear softmax gives a probability
for each language. Both are trained by stochastic gradient descent in numpy, on the
driver, over a bounded sample of labelled rows (about `SAMPLE_DOCS` documents of each
language). Labels are noisy: a first fit, which sees only 1- to 3-grams and so can't learn
single sentences by heart, rejects sentences, and these are left out of the second. A temperature fitted on held-out sentences calibrates the confidence, and
sentences below `ACCEPT` are rejected: they divide nothing.

Applied to the corpus the product of embeddings and softmax is one table of fixed size,
so a word costs one look-up; documents are read where they lie, without a shuffle.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.session import stored

BUCKETS, DIM = 1 << 16, 12
#: Labelled documents of each language to learn from; fewer leave a rare language to noise.
SAMPLE_DOCS = 600
#: Longer documents are not learned from (all are read).
SAMPLE_CHARS = 20_000
EPOCHS, BATCH, RATE = 4, 128, 0.4
#: A small sample is gone through more often, for this many steps.
LEAST_STEPS = 150
#: Share of held-out labels that may be wrong where the temperature is fitted.
NOISE = 0.02
#: Confidence from which a sentence counts, and from which it does in a text with no surer one.
ACCEPT, ACCEPT_ALONE = 0.99, 0.6
#: Words that a sentence beside others needs to count.
LEAST_BESIDE = 6
#: Words in small letters that a sentence needs, or words if all are in capitals.
MIN_WORDS, MIN_CAPITALS = 3, 5

# Languages by two-letter code with the other spellings of their labels.
SPELLINGS = {
    "en": "en eng english anglais englisch",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french francais français",
    "es": "es spa spanish espanol español castellano",
    "pt": "pt por portuguese portugues português",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
}
LANGS = tuple(SPELLINGS)


def label_of(label: Column) -> Column:
    """The two-letter code a label names in any spelling, with or without a region; else null."""
    clean = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    base = F.regexp_extract(clean, r"^(\p{L}+)", 1)
    spelled = F.create_map(*[F.lit(x) for code, words in SPELLINGS.items() for w in words.split() for x in (w, code)])
    return F.when(clean.rlike(r"^\p{L}+([-_ (].*)?$"), F.try_element_at(spelled, base))


_TAG_BREAK = re.compile(r"<(?:/?(?:p|div|li|ul|ol|h\d|tr|td|table|br|hr)\b)[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_NOTE = re.compile(r'"[A-Za-z_]+":\s*"((?:[^"\\]|\\.)*)"', re.S)
_MARK = re.compile(r"^[ \t]*(?:>[ \t]*|#+[ \t]|[-*•→][ \t]+|\d{1,4}[.)][ \t]+|\[[\d:.]+\][ \t]*(?:#\d+[ \t]*)?|(?:user|agent|assistant|system)[ \t]*:[ \t]*|M\d[ \t]+\d+[ \t]?ms[ \t]*\|[ \t]*)+", re.M | re.I)
_QUOTED = re.compile(r"\"[^\"\n]{1,80}\"|“[^”“\n]{1,80}[”“]|„[^“”\n]{1,80}[“”]|«[^»\n]{1,80}»|『[^』\n]{1,80}』|‘[^’\n]{1,80}’")
_CODE = re.compile(r"https?://\S+|\S*[@＠_=\d§$#{}\[\]\\/%]\S*")
# One of these stands wherever the two above can match.
_QUOTE, _SIGN = re.compile("[\"“„«『‘]"), re.compile(r"[@＠_=\d§$#{}\[\]\\/%]")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»“)\]]*\s+(?=[^\W\da-z_]|[¿¡\"'“„«(\[{<\d$§@#])|\n\s*\n|\s\|\s|\x00")
_WORDS = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]+")


def _value(m: re.Match) -> str:
    """A JSON field's text as a part of its own."""
    try:
        return f"\x00{json.loads(f'"{m[1]}"', strict=False)}\x00"
    except ValueError:
        return "\x00" + m[1].replace('\\"', '"') + "\x00"


def sentences(text: str) -> list[list[str]]:
    """The words (lower case) of each sentence of a text, without code and captions.

    A part with fewer than three words in small letters is a heading, a caption, a name
    or the like and no sentence; one all in capitals needs five words.
    """
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _HIDDEN.sub("", t))
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if '": "' in t:
        t = _NOTE.sub(_value, t)
    if "\\" in t:
        t = t.replace("\\n", "\n").replace('\\"', '"')
    if "<" in t:
        t = _TAG.sub("", _TAG_BREAK.sub("\x00", t))
    if "&" in t:
        t = html.unescape(t)
    t = _MARK.sub("\x00", t)
    t = re.sub(r"(?<=[^\W\d_])-\n(?=[^\W\d_])", "", t)
    t = re.sub(r"(?<=[.!?:)…\"”»])\n", "\x00", t)
    out = []
    for part in _SPLIT.split(t):
        if _QUOTE.search(part):
            part = _QUOTED.sub(" ", part)
        if _SIGN.search(part):
            part = _CODE.sub(" ", part)
        words = _WORDS.findall(part)
        small = len([1 for w in words if w[0].islower()])
        if small >= MIN_WORDS or not small and len(words) >= MIN_CAPITALS and all(w.isupper() for w in words):
            out.append([w.casefold() for w in words])
    return out


def subwords(word: str, sizes: tuple[int, ...] = (2, 3, 4, 5)) -> list[int]:
    """The hashed rows of a word: itself and its 2- to 5-grams with edges."""
    import xxhash

    w = f"<{word}>"
    grams = [w] * (len(sizes) > 3) + [w[i : i + n] for n in sizes for i in range(len(w) - n + 1)]
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in grams]


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums) of the rows of values by their place."""
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    return at[order][cuts], np.add.reduceat(values[order], cuts, axis=0)


class Fit:
    """Sentences as word numbers, words as subword rows; trained by SGD."""

    def __init__(self, texts: list[list[str]], labels: np.ndarray, coarse: bool = False) -> None:
        number: dict[str, int] = {}
        self.flat = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
        self.starts = np.cumsum([0, *(len(t) for t in texts)])
        subs = [subwords(w, (1, 2, 3) if coarse else (2, 3, 4, 5)) for w in number]
        self.rows, self.sub = np.unique(np.array([x for s in subs for x in s], np.int64), return_inverse=True)
        self.sub_n = np.array([len(s) for s in subs], np.int64)
        self.sub_at = np.cumsum(np.r_[0, self.sub_n])[:-1]
        self.labels = labels

    def train(self, chosen: np.ndarray, epochs: int, balance: float) -> np.ndarray:
        """The table (BUCKETS x languages) after SGD over the chosen sentences.

        balance: 0 weighs sentences alike, 1 languages.
        """
        amount = np.bincount(self.labels[chosen], minlength=len(LANGS))
        weight = (amount.max() / np.maximum(amount, 1)) ** balance
        weight *= len(chosen) / max(1e-9, (weight * amount).sum())
        rng = np.random.default_rng(7)
        emb = rng.normal(0, 1 / DIM, (len(self.rows), DIM))
        out = np.zeros((DIM, len(LANGS)))
        seen_emb, seen_out = np.zeros(len(emb)), np.full(out.shape, 1e-8)  # sums of squared gradients
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(BATCH, len(chosen))))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(chosen)
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                words = self.flat[_spans(self.starts[part], self.starts[part + 1] - self.starts[part])]
                owner = np.repeat(np.arange(len(part)), self.starts[part + 1] - self.starts[part])
                unique, inverse = np.unique(words, return_inverse=True)
                rows = self.sub[_spans(self.sub_at[unique], self.sub_n[unique])]
                cuts = np.cumsum(np.r_[0, self.sub_n[unique]])[:-1]
                vectors = np.add.reduceat(emb[rows], cuts, axis=0)
                count = np.bincount(owner, self.sub_n[words], len(part))[:, None]
                edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                mean = np.add.reduceat(vectors[inverse], edges, axis=0) / count
                error = _softmax(mean @ out)
                error[np.arange(len(part)), self.labels[part]] -= 1
                error *= weight[self.labels[part]][:, None]
                back = (error @ out.T / count)[owner]
                _, grad = _summed(inverse, back)
                step = mean.T @ error
                seen_out += step**2
                out -= rate * step / np.sqrt(seen_out)
                touched, full = _summed(rows, np.repeat(grad, self.sub_n[unique], axis=0))
                seen_emb[touched] += (full**2).mean(axis=1)
                emb[touched] -= rate * full / np.sqrt(seen_emb[touched] + 1e-12)[:, None]
        table = np.zeros((BUCKETS, len(LANGS)))
        table[self.rows] = emb @ out
        return table

    def logits(self, table: np.ndarray) -> np.ndarray:
        vectors = np.add.reduceat(table[self.rows[self.sub]], self.sub_at, axis=0)
        sums = np.add.reduceat(vectors[self.flat], self.starts[:-1], axis=0)
        return sums / np.add.reduceat(self.sub_n[self.flat], self.starts[:-1])[:, None]


def fit(docs: list[tuple[str, str]]) -> tuple[np.ndarray, float]:
    """(table, temperature) from (text, language) pairs."""
    votes: dict[tuple[str, ...], dict[str, int]] = {}
    for text, lang in docs:
        for words in sentences(text):
            one = votes.setdefault(tuple(words), {})
            one[lang] = one.get(lang, 0) + 1
    texts, labels, fold = [], [], []
    for words, count in votes.items():  # a repeated sentence has the label most of its copies have
        best = sorted(count.values())
        if len(best) > 1 and best[-1] == best[-2]:
            continue
        lang = max(count, key=count.get)
        bare = [_bare(w) for w in words]
        for t in [list(words)] + [bare] * (bare != list(words)):
            texts.append(t)
            labels.append(LANGS.index(lang))
            fold.append(len(words) + sum(map(len, words)))
    if not texts:
        return np.zeros((BUCKETS, len(LANGS))), 1.0
    y = np.array(labels)
    model = Fit(texts, y)
    held = np.array(fold) % 10 == 0
    everything = np.arange(len(y))
    coarse = Fit(texts, y, coarse=True)
    prob = _softmax(coarse.logits(coarse.train(everything, EPOCHS // 2, 0.5)))
    right = prob[everything, y] >= 0.5  # the others' labels are wrong, or they are in a mixed text
    table = model.train(everything[right & ~held], EPOCHS, 0.8)
    logits, truth = model.logits(table)[held & right], y[held & right]
    temperature = 1.0
    if len(truth):
        scales = np.geomspace(0.25, 4, 33)
        # some labels are wrong still: the sentences that fit theirs least don't count
        own = _softmax(logits)[np.arange(len(truth)), truth]
        sure = np.argsort(own, kind="stable")[int(np.ceil(NOISE * len(own))) % len(own) :]
        loss = [-np.log(_softmax(logits[sure] * s)[np.arange(len(sure)), truth[sure]] + 1e-12).mean() for s in scales]
        temperature = float(scales[int(np.argmin(loss))])
    return table, temperature


def learn(df: DataFrame, key: str, text: str, label: str) -> tuple[np.ndarray, float]:
    """Fit on about SAMPLE_DOCS labelled documents of each language, chosen by a hash of their key.

    The fit is kept in the shared folder by the sample's fingerprint and used again.
    """
    labelled = df.select(F.col(key).alias("k"), F.col(text).alias("t"), label_of(F.col(label)).alias("c")).where(F.length("t").between(1, SAMPLE_CHARS) & F.col("c").isNotNull())
    counts = {r.c: r.n for r in labelled.groupBy("c").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return fit([])
    share = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(min(1.0, SAMPLE_DOCS / n)))])
    chosen = labelled.where(F.pmod(F.xxhash64("k"), F.lit(1_000_003)) < F.try_element_at(share, F.col("c")) * 1_000_003)
    rows = sorted((r.k, r.t, r.c) for r in chosen.limit(2 * SAMPLE_DOCS * len(LANGS)).collect())  # a bounded sample

    def made() -> bytes:
        table, scale = fit([(t, c) for _, t, c in rows])
        return np.append(table.astype("<f4").ravel(), np.float32(scale)).tobytes()

    mark = hashlib.sha256(repr((BUCKETS, DIM, EPOCHS, BATCH, RATE, LANGS, rows)).encode()).hexdigest()[:32]
    body = np.frombuffer(stored(df.sparkSession, f"languages-{mark}", made), "<f4")
    return body[:-1].reshape(BUCKETS, len(LANGS)), float(body[-1])


class Reader:
    """The fitted table at work: a word's row is looked up once in a task, texts are read many at a time."""

    def __init__(self, table: np.ndarray, temperature: float) -> None:
        self.table, self.scale = table.astype(np.float32), temperature
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(LANGS) + 1), np.float32)  # sums of rows, and how many they are

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            subs = [subwords(w) for w in new]
            n = np.array([len(s) for s in subs])
            sums = np.add.reduceat(self.table[np.concatenate([np.array(s) for s in subs])], np.cumsum(n) - n, axis=0)
            first = len(self.known)
            while first + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[first : first + len(new)] = np.column_stack([sums, n])
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        return np.array([self.known[w] for w in words])

    def read(self, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
        """(language, confidence, sentences) of each maximal stretch of accepted sentences of each text."""
        if len(self.known) > 500_000:
            self._forget()
        parts = [sentences(t) if t else [] for t in texts]
        flat = [s for p in parts for s in p]
        if not flat:
            return [[] for _ in texts]
        size = np.array([len(s) for s in flat])
        numbers = self._numbers([w for s in flat for w in s])
        total = np.add.reduceat(self.vectors[numbers], np.cumsum(size) - size, axis=0)
        p = _softmax(total[:, :-1] / total[:, -1:] * self.scale)
        each = iter(zip([LANGS[i] for i in p.argmax(axis=1)], p.max(axis=1).tolist(), size.tolist(), strict=True))
        return [self._joined([next(each) for _ in s]) for s in parts]

    def _joined(self, each: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
        surer = any(c >= ACCEPT and n >= LEAST_BESIDE for _, c, n in each)
        out: list[list] = []
        for lang, c, n in each:
            if not (c >= ACCEPT and n >= LEAST_BESIDE) and (surer or c < ACCEPT_ALONE):
                continue
            if out and out[-1][0] == lang:
                out[-1][1] += c
                out[-1][2] += 1
            else:
                out.append([lang, c, 1])
        return [(lang, c / n, n) for lang, c, n in out]

    def segments(self, text: str | None) -> list[tuple[str, float, int]]:
        return self.read([text])[0]


SEGMENT = "seg_no long, seg_lang string, confidence double, n_sentences long"


def segments(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model=None) -> DataFrame:
    """(key, label_lang, seg_no, seg_lang, confidence, n_sentences): the segments of each document.

    label_lang is the language the document's label names, null if none. Documents
    without any sentence (null, empty, blank or code only) have no row.
    """
    table, scale = model or learn(df, key, text, label)
    shipped = df.sparkSession.sparkContext.broadcast((table.astype(np.float32), scale))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        names = [key, "label_lang", "seg_no", "seg_lang", "confidence", "n_sentences"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
        for batch in batches:
            reader = reader or Reader(*shipped.value)
            rows: list[tuple] = []
            ids, texts, labels = (x.to_pylist() for x in batch.columns)
            for lo in range(0, len(ids), 200):
                for k, c, found in zip(ids[lo : lo + 200], labels[lo : lo + 200], reader.read(texts[lo : lo + 200]), strict=True):
                    rows += [(k, c, i, *s) for i, s in enumerate(found, 1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)

    rows = df.where(F.length(text) > 0).select(F.col(key).cast("long"), F.col(text).cast("string").alias("t"), label_of(F.col(label)).alias("c"))
    return rows.mapInArrow(run, f"{key} long, label_lang string, {SEGMENT}")


def documents(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model=None) -> DataFrame:
    """(key, lang, confidence, mixed) of every document: the language of most sentences, 'und' without any."""
    parts = segments(df, key, text, label, model)
    by_lang = parts.groupBy(key, "seg_lang").agg(F.sum("n_sentences").alias("n"), F.sum(F.col("confidence") * F.col("n_sentences")).alias("c"))
    one = by_lang.groupBy(key).agg(F.max(F.struct("n", "c", "seg_lang")).alias("b"), F.sum("n").alias("all"), (F.count("*") > 1).alias("mixed"))
    one = one.select(F.col(key).alias("_k"), F.col("b.seg_lang").alias("lang"), (F.col("b.c") / F.col("all")).alias("confidence"), "mixed")
    keys = df.select(key)
    return keys.join(one, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("mixed", F.lit(False)).alias("mixed"))


def found(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model=None) -> DataFrame:
    """(key, seg_no, seg_lang) of documents with a missing or wrong label or several languages."""
    parts = segments(df, key, text, label, model)
    wrong = parts.groupBy(key).agg(F.max((F.col("label_lang").isNull() | (F.col("label_lang") != F.col("seg_lang")) | (F.col("seg_no") > 1)).cast("int")).alias("w"), F.collect_list(F.struct("seg_no", "seg_lang")).alias("s"))
    return wrong.where("w = 1").select(key, F.explode("s").alias("x")).select(key, "x.seg_no", "x.seg_lang")
