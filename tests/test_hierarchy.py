from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagelens.operators import hierarchy as h

SCHEMA = "perception_cycle_id string, target_id string, parent_id string"


def brute(rows):
    nodes = {}
    for g, n, p in rows:
        if n is not None:
            old = nodes.get((g, n))
            p = p or None
            nodes[g, n] = p if old is None else old if p is None else min(old, p)
    out = {}
    for g, n in nodes:
        way, x = [n], nodes[g, n]
        while x is not None and (g, x) in nodes and x not in way:
            way.append(x)
            x = nodes[g, x]
        lost = x is not None and (g, x) in nodes
        out[g, n] = ("", -1) if lost else (way[-1], len(way) - 1)
    full = {}
    for g, n in nodes:
        root, depth = out[g, n]
        below = -1
        if depth >= 0:
            below = 0
            for g2, m in nodes:
                x, seen = nodes[g2, m], set()
                while g2 == g and x is not None and (g, x) in nodes and x not in seen:
                    if x == n:
                        below += 1
                        break
                    seen.add(x)
                    x = nodes[g, x]
        full[g, n] = (root, depth, below)
    return full


def some(seed, n=60):
    r = random.Random(seed)
    rows = [(r.choice(["g", "h", None]), f"n{r.randrange(25)}" if r.random() > 0.05 else None, r.choice([None, "", "gone", *[f"n{i}" for i in range(25)]])) for _ in range(n)]
    return [*rows, rows[0], ("g", "self", "self")]


def got(df, **kw):
    return {(r.grp, r.node): (r.root, r.depth, r.descendants) for r in h.hierarchy(df, **kw).collect()}


def test_local_distributed_and_doubling_agree_with_brute_force(spark):
    for seed in (1, 2):
        rows = some(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        want = brute(rows)
        assert got(df) == want
        assert got(df, max_local=8) == want  # components, and doubling for those beyond 8 nodes
        assert got(df, max_local=0) == want  # doubling for all


def test_paths_and_back_edges(spark):
    rows = [("g", "a", None), ("g", "b/1", "a"), ("g", "c", "b/1"), ("g", "x", "y"), ("g", "y", "x"), ("g", "z", "y"), ("g", "self", "self"), (None, "q", "p"), (None, "p", "r"), (None, "r", "q"), (None, "s", "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (500_000, 3, 0):
        out = {r.node: r for r in h.hierarchy(df, max_local=most).collect()}
        assert out["c"].path == ["a", "b/1", "c"] and out["c"].depth == 2 and out["z"].path is None
        assert {n for n, r in out.items() if r.on_cycle} == {"x", "y", "self", "p", "q", "r"}
        assert out["z"].on_cycle is False and out["z"].cycle == "x" and out["s"].cycle == "p" and out["a"].on_cycle is None
        ends = {(r.grp, r.node, r.parent, r.length) for r in h.cycles(df, max_local=most).collect()}
        assert ends == {("g", "x", "y", 2), ("g", "self", "self", 1), (None, "p", "r", 3)}
        pairs = {(r.node, r.descendant) for r in h.descendants(df, max_local=most).collect()}
        assert pairs == {("a", "b/1"), ("a", "c"), ("b/1", "c")}


def test_nearest_marked_ancestor(spark):
    rows = [("g", "a", None, "link"), ("g", "b", "a", None), ("g", "c", "b", None), ("g", "d", "c", "button"), ("g", "e", "d", None), ("g", "x", "x", "link")]
    df = spark.createDataFrame(rows, SCHEMA + ", kind string")
    for most in (500_000, 3, 0):
        out = {r.node: (r.near, r.near_mark) for r in h.hierarchy(df, max_local=most, mark=F.max("kind")).collect()}
        assert out == {"a": (None, None), "b": ("a", "link"), "c": ("a", "link"), "d": ("a", "link"), "e": ("d", "button"), "x": (None, None)}


def test_deep_chain_and_empty(spark):
    rows = [("g", str(i), str(i - 1) if i else None) for i in range(3000)]
    out = got(spark.createDataFrame(rows, SCHEMA))
    assert out["g", "2999"] == ("0", 2999, 0) and out["g", "0"] == ("0", 0, 2999)
    assert h.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
