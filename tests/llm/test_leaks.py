from __future__ import annotations

import random

import numpy as np
import pytest

from pagelens.llm import leaks

WORDS = [f"w{i}" for i in range(400)]


def item(r, n=60):
    return [r.choice(WORDS) for _ in range(n)]


def changed(r, run, share):
    out = list(run)
    for i in r.sample(range(len(out)), int(len(out) * share)):
        out[i] = "changed"
    return out


def cases(seed=4, n=120):
    """Documents with a run of an item, edited little or much, or with none; and brute force's answer."""
    r = random.Random(seed)
    items = [item(r, r.randrange(40, 90)) for _ in range(12)]
    docs = []
    for _ in range(n):
        k = r.randrange(len(items))
        size = int(len(items[k]) * r.choice([0.3, 0.45, 0.55, 0.7, 1.0]))
        start = r.randrange(len(items[k]) - size + 1)
        run = changed(r, items[k][start : start + size], r.choice([0, 0.05, 0.09, 0.2]))
        docs.append(item(r, r.randrange(40)) + run + item(r, r.randrange(40)))
    return items, docs


def test_recall_and_precision_against_brute_force(spark):
    items, docs = cases()
    h = leaks.Hasher()
    code = lambda ws: np.array([h[w] for w in ws], np.uint64)
    want = {(d, i) for d, doc in enumerate(docs) for i, it in enumerate(items) if leaks.leaked(code(it), code(doc))}
    d = spark.createDataFrame([(i, " ".join(x), "x") for i, x in enumerate(docs)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(98, None), (99, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.found(d, b).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 20


def test_exact_check_matches_a_plain_edit_distance():
    r = random.Random(9)

    def distance(a, b):
        row = [0] * (len(b) + 1)  # the run may start anywhere in b
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(60):
        it = [r.randrange(8) for _ in range(12)]
        doc = [r.randrange(8) for _ in range(r.randrange(25))]
        if r.random() < 0.6:
            doc += it[r.randrange(6) :] + doc[:3]
        half = 6
        want = any(10 * distance(it[a:b], doc) <= b - a for a in range(12) for b in range(a + half, 13))
        assert leaks.leaked(np.array(it, np.uint64), np.array(doc, np.uint64)) == want


def test_texts_are_read_as_a_reader_sees_them():
    want = ["suppose", "quozilm", "has", "deja", "lunite", "fin"]
    for t in ("Suppose quozil-M has déjà l'unité ﬁn", "Sup-\npose quo​zil-M has <b>deja</b> l’unite fin", "> suppose quozil-m\n> has d\\u00e9j\\u00E0\\nL'UNITÉ &nbsp;FIN!", "[00:01:02] Suppose QUOZIL-M\n[00:01:03] has déjà l'unité fin"):
        assert leaks.words_of(t) == want, t
    assert leaks.words_of(None) == leaks.words_of(" ") == []


def edited(r, run, share):
    """A share of the words replaced, left out or put in before."""
    out = list(run)
    for i in sorted(r.sample(range(len(out)), int(len(out) * share)), reverse=True):
        out[i : i + 1] = r.choice([["other"], [], [out[i], "more"]])
    return out


@pytest.mark.parametrize("share", [0, 0.1])
@pytest.mark.parametrize("part", [0.5, 1])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 13, 15, 20, 30, 40, 60, 100])
def test_recall_by_length(n, part, share):
    r = random.Random(n)
    words = [f"v{i}" for i in range(5000)]
    h = leaks.Hasher()
    code = lambda ws: np.array([h[w] for w in ws], np.uint64)
    items = [[r.choice(words) for _ in range(n)] for _ in range(40)]
    docs = []
    for it in items:
        size = int(np.ceil(n * part))
        at = r.randrange(n - size + 1)
        docs.append(code([*(r.choice(words) for _ in range(r.randrange(40))), *edited(r, it[at : at + size], share), *(r.choice(words) for _ in range(r.randrange(40)))]))
    coded = [code(it) for it in items]
    want = {(d, i) for d, doc in enumerate(docs) for i, it in enumerate(coded) if leaks.leaked(it, doc)}
    got = set(leaks.Index(list(enumerate(coded))).search(docs))
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 36


def test_both_ways_give_the_same_rows(spark):
    items, docs = cases(seed=8, n=60)
    short = [it[:n] for it, n in zip(items, (3, 5, 9, 14, 21, 40), strict=False)]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)] + [(900, " ".join(docs[0])), (901, None), (902, "")], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items + short)] + [(98, None), (99, " ")], "item_id long, text string")
    one = sorted(map(tuple, leaks.found(d, b).collect()))
    assert one == sorted(map(tuple, leaks.found(d, b, most_words=0).collect())) and len(one) > 30


def test_nothing_to_search(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "text")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert leaks.found(d, b).count() == 0
    assert leaks.found(d, spark.createDataFrame([(1, None), (2, " ")], b.schema)).count() == 0
    assert leaks.found(d.limit(0), spark.createDataFrame([(1, "a text")], b.schema), most_words=0).count() == 0
