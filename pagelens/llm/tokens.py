"""Encoding a corpus with a public byte-level BPE: each distinct word is encoded once.

Pre-tokens are split on the JVM once and kept; exploded, their distinct ones are counted
and encoded once. Ids come back by joins: the frequent pre-tokens, whose number and size
are bounded by counting (`HOT`), go to all tasks, which look up whole texts at a time;
only the rare ones are exploded with their positions, joined by a shuffle, and put into
their texts' ids by position. No rare word is a hot key, and a text without one never moves.
"""

from __future__ import annotations

import importlib.util
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.session import kept

#: White space as Unicode has it, and the split pattern of the vocabulary.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: A pre-token is hot if it makes up more than 1 / HOT of all, or max(1, length / 8) times that for long
#: ones; so there are fewer than HOT, of fewer than 8 * HOT characters together.
HOT = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The folder is PAGELENS_TOKENIZERS, or that of the installed package."""
    folder = os.environ.get("PAGELENS_TOKENIZERS")
    if not folder:
        found = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, name)


def vocabulary(pieces: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of each distinct pre-token."""
    with open(path, encoding="utf-8") as f:
        model = pieces.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = None
        for batch in batches:
            if own is None:
                own = Tokenizer.from_str(model.value)
                own.encode_special_tokens = True
            ids = [e.ids for e in own.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return pieces.groupBy("word").agg(F.count("*").alias("n")).mapInArrow(run, "word string, n long, ids array<int>")


def _looked_up(split: DataFrame, hot: DataFrame) -> DataFrame:
    """(k, ids, rare) of (k, words): the ids of the hot words, and where the others stand."""
    table = hot.toArrow().combine_chunks()  # bounded, see HOT
    lists = table["ids"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    words = table["word"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64) if len(lists) else np.empty(0, np.int64)
    model = split.sparkSession.sparkContext.broadcast((words, np.append(sizes, 0), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)))
    rare = pa.struct([("pos", pa.int32()), ("at", pa.int32()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size_of, values = model.value
        begin_of = np.append(np.cumsum(size_of[:-1]) - size_of[:-1], 0)
        for batch in batches:
            flat = batch.column(1).flatten()
            owner = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            index = pc.fill_null(pc.index_in(flat, value_set=known.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
            size = size_of[index]  # the last entry, 0, for a rare word
            upto = np.cumsum(size)
            before = upto - size
            ids = values[np.repeat(begin_of[index] - before, size) + np.arange(upto[-1] if len(upto) else 0)]
            ends = np.cumsum(np.bincount(owner, size, len(batch))).astype(np.int32)
            first = np.append(0, ends[:-1])
            at = np.flatnonzero(index < 0)
            whose = owner[at]
            count = np.bincount(owner, minlength=len(batch))
            pos = at - (np.cumsum(count) - count)[whose]
            struct = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array((before[at] - first[whose]).astype(np.int32)), flat.take(pa.array(at))], fields=list(rare))
            cuts = np.append(0, np.cumsum(np.bincount(whose, minlength=len(batch)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids, pa.int32())), pa.ListArray.from_arrays(pa.array(cuts), struct)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["k", "ids", "rare"])

    schema = T.StructType([split.schema["k"], T.StructField("ids", T.ArrayType(T.IntegerType()))]).add("rare", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("word", T.StringType())])))
    return split.mapInArrow(run, schema)


def _filled(whole: DataFrame) -> DataFrame:
    """(k, ids) of (k, ids, r): the rare words' ids put in where they belong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, rare = batch.column(1), batch.column(2).flatten()
            size = known.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(batch)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((rare.field("pos").to_numpy(), owner))
            lists = rare.field("ids").take(pa.array(order))
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat((first[owner] + rare.field("at").to_numpy())[order], length)
            ids = np.insert(known.flatten().to_numpy(zero_copy_only=False).astype(np.int32), at, lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(size + np.bincount(owner[order], length, len(batch)).astype(np.int64))
            whole_ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), whole_ids], ["k", "ids"])

    return whole.select("k", "ids", "r").mapInArrow(run, T.StructType([whole.schema["k"], whole.schema["ids"]]))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, hot: int = HOT) -> DataFrame:
    """(key, ids) of every row: its token ids, an empty list for a null or empty text.

    Special tokens' strings are ordinary text. `key` must be unique. The order of ids
    is by position; a text of any length is one row of the result.
    """
    pieces = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(PATTERN), F.lit(0))
    split = kept(df.select(F.col(key).alias("k"), pieces.alias("words")))
    words = kept(vocabulary(split.select(F.explode("words").alias("word")), path or vocabulary_path()))
    total = words.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * hot > F.lit(total) * F.greatest(F.lit(1.0), F.length("word") / 8)
    parts = kept(_looked_up(split, words.where(is_hot).select("word", "ids")))
    open_ = parts.where(F.size("rare") > 0)
    each = open_.select("k", F.explode("rare").alias("x")).select("k", "x.*").join(words.where(~is_hot).select("word", "ids"), "word")
    lists = each.groupBy("k").agg(F.collect_list(F.struct("pos", "at", "ids")).alias("r"))
    done = parts.where(F.size("rare") == 0).select("k", "ids")
    return done.unionAll(_filled(open_.select("k", "ids").join(lists, "k"))).withColumnRenamed("k", key)


def byte_table(path: str) -> list[bytes | None]:
    """The bytes of each token by its id, from the vocabulary of fixed size."""
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(c in byte_of for c in token):
            out[i] = bytes(byte_of[c] for c in token)
    return out


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) of rows of ids, by a join with the token-byte table of fixed size; '' for no ids.

    Ids of no token are left out; bytes that are no UTF-8 come out as replacement signs.
    """
    model = df.sparkSession.sparkContext.broadcast(byte_table(path or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            texts = [b"".join(table[i] or b"" for i in x or () if i is not None and 0 <= i < len(table)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("text", T.StringType())])
    return df.select(F.col(key).alias("k"), F.col(ids).cast("array<int>")).mapInArrow(run, schema).withColumnRenamed("k", key)
