from __future__ import annotations

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.operators import messages

IDS = st.one_of(st.none(), st.sampled_from(["", " ", "evt-1767578092944-f1172", " EVT-1767578092944-F1172\n", "evt-0000000000000-00000", "evt-9999999999999-zzzzz", "evt-1-a", "Ä", "ä"]), st.from_regex(r"evt-[0-9]{13}-[0-9a-z]{5}", fullmatch=True))


def normal(x):
    return x.strip().lower() if x is not None and x.strip() else None


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(IDS, min_size=0, max_size=30))
def test_counts_match_brute_force(spark, ids):
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, copies int")
    got = {r.id: r.copies for r in messages.repeated(df).collect()}
    want = {k: n for k, n in Counter(normal(i) for i in ids).items() if k is not None and n > 1}
    assert got == want


def test_permutation_is_exact(spark):
    ids = [f"evt-{n:013d}-{s}" for n in (0, 1, 10**13 - 1, 1767578092944) for s in ("00000", "zzzzz", "a0b1c", "00001")]
    ids += ["0", "00", "7", "007", "999999999999999999", "1234567890123456789", "00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff", "8c3b51f0-9d5e-4d0a-8a51-0d2f3a9be001"]
    ids += ["f" * 32, "0" * 32, "8c3b51f09d5e4d0a8a510d2f3a9be001", "evt-1-a", "ä", "8c3b51f0-9d5e"]
    df = spark.createDataFrame([(i,) for i in ids], "k string")
    keys = df.select("k", messages.quotient_key(F.col("k")).alias("x")).select("k", "x.*")
    assert keys.select(*messages.KEY).distinct().count() == len(ids)
    back = keys.select("k", messages.identifier(*[F.col(c) for c in messages.KEY]).alias("b")).collect()
    assert [x.k for x in back] == [x.b for x in back]


def test_a_task_that_begins_its_table_anew_counts_the_same(spark, monkeypatch):
    ids = [("hot",)] * 500 + [(str(i % 700),) for i in range(1400)]
    df = spark.createDataFrame(ids, "id string").coalesce(1)
    got = {r.id: r.copies for r in messages.repeated(df).collect()}
    assert got == {"hot": 500, **{str(i): 2 for i in range(700)}}
    plan = messages.repeated(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # by quotient alone


def test_one_copy_keeps_every_row_without_id(spark):
    rows = [("a", 3, 1), (" A ", 2, 1), (None, 1, 1), (None, 1, 1), ("", 1, 1), ("b", 1, 5), ("b", 1, 4)]
    df = spark.createDataFrame(rows, "id string, received_at int, `_k` int")
    out = messages.one_copy(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(" A ", 2, 1), (None, 1, 1), (None, 1, 1), ("", 1, 1), ("b", 1, 4)], key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "id string, received_at int")
    assert messages.repeated(df).count() == 0 == messages.one_copy(df).count()
