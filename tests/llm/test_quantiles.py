from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import plans, quantiles
from tests.compare import connect, same


def ranks(values, answer):
    v = np.sort(values)
    return np.searchsorted(v, answer, "left") + 1, np.searchsorted(v, answer, "right")


@pytest.mark.parametrize("kind", ["uniform", "ties", "sorted", "long tail"])
def test_error_stays_within_the_bound(kind):
    rng = np.random.default_rng(5)
    n = 400_000
    values = {"uniform": rng.random(n), "ties": rng.integers(0, 20, n).astype(float), "sorted": np.arange(n, dtype=float), "long tail": rng.pareto(0.7, n)}[kind]
    parts = np.array_split(values, 37)
    sketches = []
    for p in parts:
        s = quantiles.Sketch()
        for chunk in np.array_split(p, 5):
            s.add(chunk)
        sketches.append(quantiles.Sketch.of(*s.row(())))  # through its bytes
    whole = quantiles.Sketch()
    for s in sketches:
        whole.merge(s)
    assert whole.n == n and whole.bound() < 0.005 * n
    for p, a in zip((0.01, 0.5, 0.9, 0.99, 1.0), whole.quantiles((0.01, 0.5, 0.9, 0.99, 1.0)), strict=True):
        lo, hi = ranks(values, a)
        want = int(np.ceil(p * n - 1e-9))
        assert lo - whole.bound() <= want <= hi + whole.bound()


def test_small_groups_are_exact_and_empty_ones_null():
    s = quantiles.Sketch()
    assert s.quantiles((0.5,)) == [None] and quantiles.Sketch.of(*s.row(())).n == 0
    s.add(np.array([3.0, 1.0, 2.0, 2.0]))
    assert s.quantiles((0.25, 0.5, 0.75, 1.0)) == [1.0, 2.0, 2.0, 3.0] and s.bound() == 0


def test_query_matches_sql(spark, data):
    same(plans.QUERIES["p2_percentiles"](spark, data), connect(data), plans.SQL["p2_percentiles"])


def test_bad_values_and_null_groups(spark):
    from pyspark.sql import functions as F

    from pagelens.session import cut_lineage

    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", inf), ("a", -1.0), ("a", None), (None, 5.0), ("b", None)], "g string, v double")
    parts = quantiles.partials("m", df, F.col("g"), F.lit("d"), F.col("v"))
    out = {(r.grp, r.day): (r.n, r.p50) for r in quantiles.per_day_and_all([parts], cut_lineage).collect()}
    assert out == {("a", "d"): (1, 1.0), ("a", "all"): (1, 1.0), (None, "d"): (1, 5.0), (None, "all"): (1, 5.0), ("b", "d"): (0, None), ("b", "all"): (0, None)}
    assert quantiles.per_day_and_all([parts.where("false")], cut_lineage).count() == 0


def test_many_groups_in_a_task(spark, monkeypatch):
    rows = [(f"g{i % 1500}", float(i)) for i in range(4500)]
    df = spark.createDataFrame(rows, "g string, x double").coalesce(1)
    parts = quantiles.partials("m", df, F.col("g"), F.lit("d"), F.col("x"))
    out = {r.grp: (r.n, r.p50) for r in quantiles.percentiles(quantiles.merged(parts)).collect()}
    assert out == {f"g{i}": (3, float(i + 1500)) for i in range(1500)}
