from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagelens.streaming import streams as s

SCHEMA = "k string, n long, v string"


def files(spark, folder, *parts):
    for i, rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/t.parquet/part={i}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/t.parquet")


A, B, C = [("a", 1, "x"), ("b", 2, None)], [("a", 3, None), ("b", 4, "y")], [("a", 5, "z"), ("c", 6, "w"), (None, 7, "q")]


def test_a_named_query_goes_on_where_it_stopped(spark, tmp_path):
    name = uuid.uuid4().hex
    run = lambda: sorted(map(tuple, s.last_values(stream(spark, tmp_path), "k", F.col("n"), ["v"], name).collect()))
    newest = lambda: sorted(r.n for r in s.history(stream(spark, tmp_path), [F.col("n").desc()], 3, name).collect())
    files(spark, tmp_path, (1, A), (2, B))
    assert run() == [("a", "x"), ("b", "y")] and newest() == [2, 3, 4]
    assert run() == [("a", "x"), ("b", "y")] and newest() == [2, 3, 4]  # nothing new to read
    files(spark, tmp_path, (3, C))
    assert run() == [("a", "z"), ("b", "y"), ("c", "w")] and newest() == [5, 6, 7]
    assert len(s._epochs(spark, f"{s.place(spark, 'history', name)}/state")) <= 2  # older ones are removed
    s.reset(spark, "last", name)
    assert run() == [("a", "z"), ("b", "y"), ("c", "w")]  # read anew from the start


def test_relay_passes_each_row_once(spark, tmp_path):
    name = uuid.uuid4().hex
    files(spark, tmp_path, (1, A), (2, B))
    assert s.relayed(stream(spark, tmp_path), name).count() == 4
    files(spark, tmp_path, (3, C))
    assert s.relayed(stream(spark, tmp_path), name).count() == 7


def test_bodies_are_measured_in_bytes(spark, tmp_path):
    files(spark, tmp_path, (1, [("a", 1, '"ab"'), ("b", 2, '"äb"'), ("c", 3, "no"), ("d", 4, None)]))
    good, bad = s.ingested(stream(spark, tmp_path), "v", most=4)
    assert [r.k for r in good.collect()] == ["a"] and sorted(r.k for r in bad.collect()) == ["b", "c", "d"]


def test_empty_stream(spark, tmp_path):
    files(spark, tmp_path, (1, []))
    assert s.last_values(stream(spark, tmp_path), "k", F.col("n"), ["v"]).count() == 0
    assert s.history(stream(spark, tmp_path), [F.col("n")]).count() == 0
