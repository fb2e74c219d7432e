from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.llm import languages as L

SAID = {
    "en": ["The agent clicked the button near the footer", "Please check whether the menu is still visible", "Nobody expected the page to move after the redirect", "It took some time until the dialog appeared"],
    "de": ["Der Agent hat die Schaltfläche unter der Kopfzeile angeklickt", "Bitte prüfen Sie, ob man das Menü noch sehen kann", "Niemand hatte damit gerechnet, dass die Seite sich verschiebt", "Es dauerte lange, bis das Fenster erschien"],
    "fr": ["L'agent a cliqué sur un lien dans la colonne de gauche", "Veuillez vérifier que le menu reste visible sous la page", "Personne ne pensait que la fenêtre bougerait avant la fin", "Il a fallu du temps pour que le panier apparaisse"],
}


def model():
    docs = [(". ".join(s[i:] + s[:i]) + ".", lang) for lang, s in SAID.items() for i in range(4)] * 6
    return L.fit(docs)


def test_labels_in_any_spelling(spark):
    labels = ["en", " EN\n", "English", "eng", "en-US", "de_AT", "German", "deu", "Français", "pt-PT", "und", "n/a", "", None, "unknown", "xx", "русский"]
    want = ["en"] * 5 + ["de"] * 3 + ["fr", "pt"] + [None] * 6 + ["ru"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    assert [r.c for r in df.orderBy("i").select(L.label_of(F.col("x")).alias("c")).collect()] == want


def test_segments_wrong_labels_and_mixed_texts(spark):
    e, d, f = (SAID[x] for x in ("en", "de", "fr"))
    texts = [
        (1, f"{e[0]}. {e[1]}.", "en"), (2, f"{d[0]}. {d[1]}.", "fr"), (3, f"{e[0]}. {d[1]}. {d[2]}. {e[3]}.", "en"), (4, f"{f[0]}.", None), (5, f"{e[0]} \"Niemand\". {e[1]}. §5.5 x=1", "English"),
        (6, None, "en"), (7, "", None), (8, "12 45 99\n33", None), (9, "{\"step\": 1, \"note\": \"" + e[2] + ".\"}\n{\"step\": 2, \"note\": \"" + f[1] + ".\"}", "en"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    out = {(r.doc_id, r.seg_no): r.seg_lang for r in L.found(df, model=model()).collect()}
    assert out == {(2, 1): "de", (3, 1): "en", (3, 2): "de", (3, 3): "en", (4, 1): "fr", (9, 1): "en", (9, 2): "fr"}
    whole = {r.doc_id: (r.lang, r.mixed) for r in L.documents(df, model=model()).collect()}
    assert whole[1] == ("en", False) and whole[3][1] and whole[6] == ("und", False) and len(whole) == 9


def test_held_out_accuracy(spark, data):
    from pagelens.sources.tables import table

    docs = table(spark, data, "documents").where("text is not null").select("doc_id", "text", L.label_of(F.col("lang")).alias("c")).where("c is not null").orderBy("doc_id").collect()
    table_, scale = L.fit([(r.text, r.c) for i, r in enumerate(docs) if i % 5])
    reader = L.Reader(table_, scale)
    seen = [(r.c, s) for i, r in enumerate(docs) if not i % 5 and len(s := reader.segments(r.text)) == 1]
    assert sum(c == s[0][0] for c, s in seen) >= 0.7 * len(seen)  # a tenth of the labels is wrong, and the table is tiny


def test_a_fit_is_kept_and_used_again(spark, monkeypatch):
    docs = [(i, ". ".join(s) + ".", lang) for i, (lang, s) in enumerate(list(SAID.items()) * 3)] + [(99, "x" * (L.SAMPLE_CHARS + 1), "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    table, scale = L.learn(df, "doc_id", "text", "lang")
    monkeypatch.setattr(L, "fit", None)  # a second fit would fail
    again, same = L.learn(df, "doc_id", "text", "lang")
    assert (table == again).all() and scale == same


def test_one_wrong_label_leaves_the_temperature():
    docs = [(". ".join(s[i:] + s[:i]) + ".", lang) for lang, s in SAID.items() for i in range(4)] * 6
    want = L.fit(docs)[1]
    assert L.fit([*docs, ("The panel opened before the agent had read the text.", "de")])[1] == want


def test_long_words_and_empty_texts():
    reader = L.Reader(*model())
    assert reader.read([None, "", SAID["en"][0] + " " + "q" * 5000 + "."])[:2] == [[], []]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.found(df).count() == 0
