"""Evaluation passages in training text: CGK walks, bit-sampling LSH, exact edit check.

Texts are read as a reader sees them (no markup, escapes, zero-width signs, line marks,
case, accents or punctuation) and become sequences of word hashes. A CGK random walk
writes a window as a longer sequence in which few edits of words are few differing
places; sampled places form a key, so windows within a small edit distance share one of
several keys with high probability. Candidates are then verified exactly by edit
distance, so a row of the result is never wrong, and the tests measure the recall by length.

Windows follow the length of the item. Half of a long item (`LONG` words) holds many
windows of about 13 words, so they start at every third word of a document and a leak
shares many keys. A shorter item is searched by windows as long as the stretch that any
of its leaks must hold unchanged, at every word, and one shared key is enough. Only the
kinds of windows that some item needs are computed.

One pass over the documents. The items' keys go to the tasks as one table while these have
fewer than `MOST_WORDS` words (counted by Spark); beyond, keys are joined by a shuffle.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.session import cut_lineage

#: Walks over a window and samples of each: a window has WALKS * SAMPLES keys.
WALKS, SAMPLES = 3, 4
#: Windows of long items: steps of a walk (about twice the words it spans), places of a sample, stride.
STEPS, PLACES, STRIDE = 26, 8, 3
#: Words in half of an item from which it is long.
LONG = 30
#: Width of the bands of diagonals in which shared keys are counted; bands overlap by half.
BAND = 32
#: Words of items that every task may hold (8 bytes each, and about 15 times that for their keys).
MOST_WORDS = 1_000_000
PAD = 16
MASK = (1 << 64) - 1

_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]+")
_ESCAPE = re.compile(r"\\(?:[uU]([0-9a-fA-F]{4})|([nrtNRT\"/]))")
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|code|mark|font|small|sub|sup|kbd|tt|big|abbr|cite|q)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_LINE_MARK = re.compile(r"^[ \t]*(?:(?:>[ \t]*)+|\[\d\d?:\d\d(?::\d\d)?(?:[.,]\d+)?\][ \t]*)+", re.M)
_BROKEN = re.compile(r"(?<=\w)[-\u2010\u2011]\s*\n\s*(?=\w)")
_INNER = re.compile(r"(?<=\w)[-\u2010-\u2015'\u2019\u02bc\u2212](?=\w)")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]+")
_WORD = re.compile(r"[^\W_]+")


def _unescape(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16)) if not 0xD800 <= int(m[1], 16) < 0xE000 else " "
    return "\n" if m[2] in "nN" else m[2] if m[2] in '"/' else " "


def words_of(text: str | None) -> list[str]:
    """The words a reader sees, in order, without case, accents and punctuation."""
    if not text:
        return []
    t = text
    if "\\" in t:
        t = _ESCAPE.sub(_unescape, t)
    if "<" in t:
        t = _TAG.sub(" ", _INLINE.sub("", t))
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = _HIDDEN.sub("", t)
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
    if ">" in t or "[" in t:
        t = _LINE_MARK.sub("", t)
    if "\n" in t:
        t = _BROKEN.sub("", t)
    t = _INNER.sub("", t)
    return _WORD.findall(t.casefold())


class Hasher(dict):
    """Word to 64-bit hash; the same on all machines."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word) or 1
        if len(self) < 1_000_000:
            self[word] = h
        return h


def _fixed(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, MASK, n, dtype=np.uint64) | np.uint64(1)


class Windows:
    """One kind of windows: how they are walked and sampled. kind 0 is that of long items, else the words of a window."""

    def __init__(self, kind: int) -> None:
        self.kind, self.stride = kind, 1 if kind else STRIDE
        self.steps = 2 * kind + 2 if kind else STEPS
        self.places = PLACES if not kind or kind >= 5 else self.steps  # of few words every place counts
        self.walks, self.samples = (WALKS, SAMPLES) if self.places < self.steps else (1, 1)
        self.turn = _fixed(self.steps * self.walks, 1 + kind).reshape(self.walks, self.steps)
        shape = (self.walks, self.samples, self.places)
        self.mix = _fixed(self.walks * self.samples * self.places, 101 + kind).reshape(shape)
        chosen = [np.sort(np.random.default_rng(1000 * kind + 100 + i).choice(self.steps, self.places, replace=False)) for i in range(self.walks * self.samples)]
        self.at = np.stack(chosen).reshape(shape)  # the sampled steps of each key, in order
        self.salt = (np.arange(self.walks * self.samples, dtype=np.uint64) + np.uint64(64 * kind)) * np.uint64(0x9E3779B97F4A7C15)

    def starts(self, words: int, stride: int) -> np.ndarray:
        if self.kind:
            return np.arange(0, words - self.kind + 1, stride)
        return np.arange(0, max(1, words - STEPS // 2 + 1) if stride == 1 else max(1, words), stride)

    def keys(self, stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The LSH keys (starts x walks * samples) of the windows of a padded stream of hashes."""
        out = np.zeros((len(starts), self.walks * self.samples), np.uint64)
        for w in range(self.walks):
            at = starts.copy()
            for step in range(self.steps):
                sign = stream[at]
                if self.kind:
                    sign = np.where(at - starts < self.kind, sign, np.uint64(0))
                for s, p in np.argwhere(self.at[w] == step):
                    out[:, w * self.samples + s] += sign * self.mix[w, s, p]
                at += ((sign * self.turn[w, step]) >> np.uint64(63)).astype(at.dtype)
        return out ^ self.salt


@functools.cache
def windows(kind: int) -> Windows:
    return Windows(kind)


@functools.cache
def demand(n: int) -> tuple[int, int]:
    """(kind of windows, keys that a leak of an item of n words must share).

    A run of L words of which a tenth may be changed holds an unchanged stretch of at
    least (L - L // 10) / (L // 10 + 1) words; a short item's windows are as long as the
    least of these, so that every leak shares whole windows. For long items the number
    follows from the windows in half of the item: a tenth of the keys of those that a
    stride leaves. (Of 120 random leaks of each length none shared less than 1.3 times that.)
    """
    half = (n + 1) // 2
    if half >= LONG:
        return 0, (half - STEPS // 2) * 2 // 5
    return min(-(-(size - size // 10) // (size // 10 + 1)) for size in range(half, n + 1)), 1


def leaked(item: np.ndarray, part: np.ndarray, may: np.ndarray | None = None) -> bool:
    """Whether `part` holds a run of at least half of the item's words, a tenth changed at most.

    For each start in the item (that `may` begin a run) at once: edit distance to any stretch of `part`, word by
    word of the item; a run is accepted at the first length where its edits are few enough.
    """
    n, m = len(item), len(part)
    half = (n + 1) // 2
    ramp = np.arange(m + 1, dtype=np.int32)
    cost = np.empty((0, m + 1), np.int32)
    begun = np.empty(0, np.int64)  # the starts that can still lead to a run
    for i in range(n):
        if i <= n - half and (may is None or may[i]):
            cost = np.concatenate([cost, np.zeros((1, m + 1), np.int32)])
            begun = np.append(begun, i)
        elif not len(begun):
            if i > n - half:
                return False
            continue
        step = cost + 1
        np.minimum(step[:, 1:], cost[:, :-1] + (part != item[i]), out=step[:, 1:])
        step -= ramp
        np.minimum.accumulate(step, axis=1, out=step)
        step += ramp
        edits, length = step.min(axis=1), i + 1 - begun
        if ((length >= half) & (edits * 10 <= length)).any():
            return True
        live = edits * 10 <= n - begun  # edits never get fewer
        cost, begun = (step, begun) if live.all() else (step[live], begun[live])
    return False


def item_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of all windows of an item."""
    kind = windows(demand(len(words))[0])
    starts = kind.starts(len(words), 1)
    found = kind.keys(np.concatenate([words, np.zeros(STEPS + PAD, np.uint64)]), starts)
    return found.ravel(), np.repeat(starts, found.shape[1])


class Stream:
    """Some documents as one padded stream of hashes, and the places where windows start."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        gap = np.zeros(STEPS + PAD, np.uint64)
        self.sizes = [len(d) for d in docs]
        self.offsets = np.cumsum([0, *(n + len(gap) for n in self.sizes)])
        self.hashes = np.concatenate([x for d in docs for x in (d, gap)]) if docs else gap

    def keys(self, kind: int, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the stream, keys) of the windows of a kind, some at a time."""
        w = windows(kind)
        parts = [o + w.starts(n, w.stride) for o, n in zip(self.offsets, self.sizes, strict=False) if n]
        starts = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        for lo in range(0, len(starts), most):
            yield starts[lo : lo + most], w.keys(self.hashes, starts[lo : lo + most])


class Index:
    """Items and the keys of all their windows."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.items = items
        self.need = np.array([demand(len(words))[1] for _, words in items], np.int64)
        self.kinds = sorted({demand(len(words))[0] for _, words in items})
        made = [item_keys(words) for _, words in items]
        flat = np.concatenate([k for k, _ in made]) if made else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys = flat[order]
        self.whose = np.repeat(np.arange(len(made)), [len(k) for k, _ in made])[order] if made else np.empty(0, np.int64)
        self.place = np.concatenate([p for _, p in made])[order] if made else np.empty(0, np.int64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def search(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(document's place, item_id) of each leak."""
        stream = Stream(docs)
        codes, counts = [], []
        for kind in self.kinds:
            for at, keys in stream.keys(kind):
                row, col = np.nonzero(self.seen[(keys >> np.uint64(42)).astype(np.int64)])
                hit = keys[row, col]
                first = np.searchsorted(self.keys, hit, "left")
                count = np.searchsorted(self.keys, hit, "right") - first
                row, first, count = row[count > 0], first[count > 0], count[count > 0]
                each = np.repeat(np.arange(len(row)), count)
                entry = np.repeat(first, count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                place = at[row][each]
                doc = np.searchsorted(stream.offsets, place, "right") - 1
                begin = place - stream.offsets[doc] - self.place[entry]
                pair = doc * len(self.items) + self.whose[entry]
                for shift in (0, BAND // 2):  # a band by its first diagonal
                    band = (begin + shift) // BAND * BAND - shift
                    found, shared = np.unique((pair << 32) + (band + (1 << 31)), return_counts=True)
                    codes.append(found)
                    counts.append(shared)
        if not codes:
            return
        found, where = np.unique(np.concatenate(codes), return_inverse=True)
        shared = np.bincount(where, np.concatenate(counts), len(found))
        pair, band = found >> 32, (found & ((1 << 32) - 1)) - (1 << 31)
        enough = shared >= self.need[pair % max(1, len(self.items))]
        bands: dict[int, list[int]] = {}
        for p, x in zip(pair[enough].tolist(), band[enough].tolist(), strict=True):
            bands.setdefault(p, []).append(x)
        for p, begins in bands.items():
            d, k = divmod(p, len(self.items))
            if verified(docs[d], self.items[k][1], begins):
                yield d, self.items[k][0]


def verified(doc: np.ndarray, item: np.ndarray, begins: list[int]) -> bool:
    """The exact check of every stretch of the document that a band points to.

    First a condition that every leak meets: of some half of the item's words in a
    row, four fifths stand near their place. (A run of up to twice that half has at
    most a fifth of the half's words changed in all.)
    """
    n, half = len(item), (len(item) + 1) // 2
    slack = n // 8 + 4  # a tenth of the words can be inserted or left out
    for b in sorted(begins):
        lo, hi = b - slack, b + BAND + n + slack
        part = doc[max(0, lo) : max(0, hi)]
        padded = np.concatenate([np.zeros(max(0, -lo), np.uint64), part, np.zeros(hi - max(0, lo) - len(part), np.uint64)])
        wide = np.lib.stride_tricks.sliding_window_view(padded, BAND + 2 * slack)[:n]
        near = np.cumsum(np.r_[0, (wide == item[:, None]).any(axis=1)])
        may = (near[half:] - near[:-half]) * 5 >= 4 * half
        if may.any() and leaked(item, part, may):
            return True
    return False


def hashed_words(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(name, words): the word hashes of each text as bytes; texts without a word have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        for batch in batches:
            rows = [(k, np.array([hashed[w] for w in words], np.uint64).tobytes()) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (words := words_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], [name, "words"])

    return df.where(F.length(text) > 0).select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"{name} long, words binary")


_LAST: list = [None, None]


def _index(model) -> Index:
    """The index of a broadcast, made once in a Python worker."""
    if _LAST[0] != model.value[0]:
        _LAST[:] = model.value[0], Index([(i, np.frombuffer(w, np.uint64)) for i, w in model.value[1]])
    return _LAST[1]


def _searched(docs: DataFrame, items: DataFrame, key: str, item_key: str, text: str) -> DataFrame:
    """Every document against all items, which each task holds."""
    rows = sorted((r[0], bytes(r[1])) for r in items.toLocalIterator())
    model = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashed = _index(model), Hasher()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(ids), 500):
                places: dict[str, list[int]] = {}  # a text that repeats is searched once
                for i, t in zip(ids[lo : lo + 500], texts[lo : lo + 500], strict=True):
                    places.setdefault(t, []).append(i)
                owners = list(places.values())
                streams = [np.array([hashed[w] for w in words_of(t)], np.uint64) for t in places]
                rows = [(i, item) for d, item in index.search(streams) for i in owners[d]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(2)], [key, item_key])

    return docs.where(F.length(text) > 0).select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"{key} long, {item_key} long")


def _joined(docs: DataFrame, items: DataFrame, key: str, item_key: str, text: str) -> DataFrame:
    """The same by a shuffle on the keys: for items of any number, none of which is collected."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(w, np.uint64)
                keys, place = item_keys(words)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), i)), pa.array(place.astype(np.int32)), pa.array(np.full(len(keys), demand(len(words))[1]), pa.int32())], ["k", "item", "place", "need"])

    keyed = items.mapInArrow(own, "k long, item long, place int, need int")
    kind_of = F.udf(lambda n: demand(n)[0], "int")  # one call for each length that occurs
    lengths = items.select((F.octet_length("words") / 8).cast("int").alias("n")).distinct()
    kinds = sorted(r[0] for r in lengths.select(kind_of("n")).distinct().collect())  # ten at most

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), [np.frombuffer(w, np.uint64) for w in batch.column(1).to_pylist()]
            stream = Stream(words)
            for kind in kinds:
                for at, keys in stream.keys(kind):
                    doc = np.searchsorted(stream.offsets, at, "right") - 1
                    n = keys.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[doc], n)), pa.array(np.repeat((at - stream.offsets[doc]).astype(np.int32), n)), pa.array(keys.ravel().view(np.int64))], ["doc", "at", "k"])

    texts = cut_lineage(hashed_words(docs, key, text, "doc"))
    hits = texts.mapInArrow(windowed, "doc long, at int, k long").join(keyed, "k")
    shifts = F.explode(F.array(F.lit(0), F.lit(BAND // 2)))
    begin = (F.floor((F.col("at") - F.col("place") + F.col("shift")) / BAND) * BAND - F.col("shift")).cast("int")
    bands = hits.withColumn("shift", shifts).groupBy("doc", "item", begin.alias("begin")).agg(F.count("*").alias("shared"), F.first("need").alias("need")).where("shared >= need")
    pairs = bands.groupBy("doc", "item").agg(F.collect_set("begin").alias("begins"))
    whole = pairs.join(texts.withColumnRenamed("words", "dw"), "doc").join(items.withColumnRenamed(item_key, "item").withColumnRenamed("words", "iw"), "item")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [verified(np.frombuffer(d, np.uint64), np.frombuffer(i, np.uint64), b) for b, d, i in zip(*(batch.column(c).to_pylist() for c in range(2, 5)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = whole.select("doc", "item", "begins", "dw", "iw").mapInArrow(check, "doc long, item long")
    return out.toDF(key, item_key)


def found(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, item_id): each document with each item that leaked into it.

    Null, empty and blank documents or items match nothing; repeated documents match
    under each id. Any number of items may match a document, and a text is searched to
    its end. Whether the items fit into a task is told by their words, which Spark counts.
    """
    listed = cut_lineage(hashed_words(items, item_key, text, item_key))
    size = listed.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if not size:
        return docs.sparkSession.createDataFrame([], f"{key} long, {item_key} long")
    way = _searched if size <= 8 * most_words else _joined
    return way(docs, listed, key, item_key, text)
