from __future__ import annotations

import os

import pytest

from pagelens.llm import plans, tokens
from tests.compare import connect, same

pytest.importorskip("tokenizers")
if not os.path.exists(tokens.vocabulary_path()):
    pytest.skip("no vocabulary here", allow_module_level=True)

TEXTS = [
    None, "", " ", "\n\n  x", "Hello world, it's we'll I'd 'S", "a" * 5000, "tab\tand\r\nline  end  ", "<|endoftext|> is text", "日本語 текст ñ é é ﬁ", "​  x　y\u0085z", "🙂🙂 1234567 12.5%", "the the the",
    "Ünï—“quotes” …", "\x00\x01", "٣٤ ०१", "the the the",
]


def frame(spark, texts):
    return spark.createDataFrame([(i * 7, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, word string, k string")


def test_ids_match_the_library_and_decode(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary_path())
    own.encode_special_tokens = True
    df = frame(spark, TEXTS)
    ids = tokens.encode(df)
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert got == {i * 7: own.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokens.decode(ids).collect()} == {i * 7: t or "" for i, t in enumerate(TEXTS)}


def test_hot_and_cold_pieces_give_the_same(spark):
    df = frame(spark, TEXTS)
    want = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    for hot in (0, 20, 10**9):
        assert {r.doc_id: list(r.ids) for r in tokens.encode(df, hot=hot).collect()} == want


def test_odd_ids_decode(spark):
    df = spark.createDataFrame([("a", [-1, 10**6, 15496]), ("b", None), ("c", [220, 182])], "key string, ids array<int>")
    assert {r.key: r.text for r in tokens.decode(df, key="key").collect()} == {"a": "Hello", "b": "", "c": " \ufffd"}


def test_empty_table(spark):
    assert tokens.encode(frame(spark, [])).count() == 0


def test_round_trip_of_the_corpus(spark, data):
    same(plans.QUERIES["p6_decoded"](spark, data), connect(data), plans.SQL["p6_decoded"])
