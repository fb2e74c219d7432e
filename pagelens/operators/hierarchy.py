"""Parent-child links to full hierarchies: components, then depth-first traversal.

Links never leave their group (a capture), so one shuffle by group co-locates whole
components. A task finds the components of a group by union-find and walks each of them
depth first with coloured nodes: from its root, or from the least node of its cycle where
it has no root; a link to a grey node is the back-edge that closes the cycle. A group of
more than `MAX_LOCAL` nodes is split by a distributed search for its components, and a
single component beyond that size is solved by pointer doubling, whose rounds grow with
the logarithm of its depth. All ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.session import kept

#: Nodes that one task may hold at once (about 400 bytes each).
MAX_LOCAL = 500_000
WHITE, GREY, BLACK = 0, 1, 2


def nodes_of(df: DataFrame, group: str, node: str, parent: str, mark: Column | None = None) -> DataFrame:
    """(grp, node, up, mark): each distinct node once, up its parent's id, null for a root.

    Rows without a node id are not nodes. Where rows of one node name different
    parents the least non-empty one is taken; null and empty parents make a root only
    if no row names another. A parent that names no node of the group makes a root.
    A null group is a group of its own. mark: an aggregate over a node's rows, a text.
    """
    rows = df.where(F.col(node).isNotNull()).groupBy(F.col(group).cast("string").alias("grp"), F.col(node).cast("string").alias("node"))
    up = F.col(parent).cast("string")
    return rows.agg(F.min(F.when(up != "", up)).alias("up"), (F.lit(None) if mark is None else mark).cast("string").alias("mark"))


def components_of(up: dict[str, str | None]) -> Iterator[str]:
    """A node of each component to start from: its root, or a node of its cycle."""
    label = {n: n for n in up}

    def find(n: str) -> str:
        while label[n] != n:
            label[n] = n = label[label[n]]
        return n

    roots: dict[str, str] = {}
    for n, p in up.items():
        if p is not None and p in up:
            a, b = find(n), find(p)
            label[max(a, b)] = min(a, b)
    for n, p in up.items():
        if p is None or p not in up:
            roots[find(n)] = n
    for n in up:
        if label[n] == n:
            if n in roots:
                yield roots[n]
                continue
            colour = {}
            while n not in colour:  # up to the first node met again, then once around
                colour[n] = GREY
                n = up[n]
            least, first = n, n
            while (n := up[n]) != first:
                least = min(least, n)
            yield least


def traverse(up: dict[str, str | None], with_paths: bool = False, marks: dict[str, str] | None = None) -> Iterator[tuple]:
    """(node, root, depth, descendants, path, near, near_mark, cycle, on_cycle, length) of each node of a group.

    path: the nodes from the root to this one. near: the nearest node above with a mark.
    Nodes of a component without a root have root '', depth -1, descendants -1, no path,
    and cycle, the least node of their cycle; the link from that node to its parent is
    the back-edge, and only its row has the cycle's length.
    """
    marks = marks or {}
    children: dict[str, list[str]] = {}
    for n, p in up.items():
        if p is not None and p in up:
            children.setdefault(p, []).append(n)
    colour = dict.fromkeys(up, WHITE)
    for start in components_of(up):
        lost = up[start] is not None and up[start] in up
        ring: set[str] = set()
        trail, below, nears, ways = [start], [0], [None], [iter(children.get(start, ()))]
        colour[start] = GREY
        while trail:
            n = trail[-1]
            c = next(ways[-1], None)
            if c is not None and colour[c] == GREY:
                ring = set(trail)  # a back-edge
            elif c is not None:
                colour[c] = GREY
                nears.append(n if n in marks else nears[-1])
                trail.append(c)
                below.append(0)
                ways.append(iter(children.get(c, ())))
            else:
                ways.pop()
                size, near = below.pop(), nears.pop()
                if lost:
                    yield n, "", -1, -1, None, None, None, start, n in ring, len(ring) if n == start else None
                else:
                    yield n, start, len(trail) - 1, size, trail.copy() if with_paths else None, near, marks[near] if near is not None else None, None, None, None
                colour[n] = BLACK
                trail.pop()
                if below:
                    below[-1] += size + 1


OUT = "grp string, node string, root string, depth long, descendants long, path array<string>, near string, near_mark string, cycle string, on_cycle boolean, length long"
NAMES = [c.split()[0] for c in OUT.split(", ")]
KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]


def _local(nodes: DataFrame, key: str, with_paths: bool) -> DataFrame:
    """Groups of bounded size: one shuffle, whole groups within a task, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], NAMES)
            rows.clear()
            return batch

        def groups() -> Iterator[tuple]:
            up: dict[str, str | None] = {}
            marks: dict[str, str] = {}
            now: object = up  # differs from every key
            for batch in batches:
                for k, g, n, u, m in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if (k, g) != now:
                        if up:
                            yield now, up, marks
                        up, marks, now = {}, {}, (k, g)
                    up[n] = u
                    if m is not None:
                        marks[n] = m
            if up:
                yield now, up, marks

        for (_, g), up, marks in groups():
            for row in traverse(up, with_paths, marks):
                rows.append((g, *row))
                size += len(row[4]) if with_paths and row[4] else 1
                if size >= 100_000:
                    yield full()
                    size = 0
        yield full()

    rows = nodes.select(F.col(key).alias("k"), "grp", "node", "up", "mark").repartition("k", "grp").sortWithinPartitions("k", "grp")
    return rows.mapInArrow(run, OUT)


def components(nodes: DataFrame) -> DataFrame:
    """nodes with `comp` and `ring`, by pointer jumping: the root or the least node of the cycle of its
    component, and the latter again or null.

    A component has one root or one cycle. Every round a node looks twice as far up, so
    the rounds grow with the logarithm of the longest chain (of the number of nodes, if
    there is a cycle): nodes that still look at a node once that is passed hang on a
    cycle, and the least node seen from there is the cycle's. A round is one join on a key that is
    unique on one side, which adaptive skew splitting divides where one parent is hot;
    its result is written, so a lost executor costs one round.
    """
    step = nodes.select("grp", "node", F.col("up").alias("jump"), F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.col("node").alias("least"))
    state = kept(step)
    total, span = state.count(), 1
    while span <= 2 * total and not state.where("jump is not null").isEmpty():
        above = state.select("grp", F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("root").alias("root2"), F.col("least").alias("least2"))
        step = state.join(above, ["grp", "jump"], "left")
        state = kept(step.select("grp", "node", F.col("jump2").alias("jump"), F.coalesce("root", "root2").alias("root"), F.least("least", "least2").alias("least")))
        span *= 2
    ends = state.where("root is null").select("grp", F.col("node").alias("jump"), F.col("least").alias("ring"))
    labels = state.join(ends, ["grp", "jump"], "left").select("grp", "node", F.coalesce("root", "ring").alias("comp"), "ring")
    return nodes.join(labels, ["grp", "node"])


def doubling(nodes: DataFrame, with_paths: bool = False) -> DataFrame:
    """The rows of OUT for the nodes of `components` of any size, by pointer doubling.

    After round k a node knows its ancestor 2^k above (null: its root is nearer), the
    descendants less than 2^k below it, the nearest marked of its next 2^k ancestors and
    the least of itself and those before the ancestor. A node that still has an ancestor
    once 2^k exceeds the number of nodes is on or below a cycle, and that ancestor is on
    it. Joins go from the many (nodes) to the few on a key unique on the other side, so
    adaptive skew splitting applies.
    """
    known = nodes.select("grp", F.col("node").alias("p"), F.col("mark").alias("m"))
    state = nodes.alias("n").join(known.alias("k"), F.expr("n.grp <=> k.grp and n.up = k.p"), "left").select("n.grp", "n.node", "n.ring", F.col("k.p").alias("up"), F.col("k.m").alias("m"))
    state = state.select(
        "grp",
        "node",
        F.col("up").alias("jump"),
        F.when(F.col("up").isNull(), F.col("node")).alias("root"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(1).cast("long").alias("size"),
        F.when(F.lit(with_paths) & F.col("ring").isNull(), F.array("node")).alias("path"),
        F.when(F.col("m").isNotNull(), F.struct(F.col("up").alias("id"), F.col("m").alias("mark"))).alias("near"),
        F.col("node").alias("least"),
    )
    state = kept(state)
    total, span = state.count(), 1
    columns = ["grp", "node", "jump", "root", "depth", "size", "path", "near", "least"]
    while span <= 2 * total:
        above = state.select(F.col("grp").alias("g"), F.col("node").alias("j"), *[F.col(c).alias(f"{c}2") for c in ("jump", "root", "depth", "path", "near", "least")])
        added = state.where("jump is not null").groupBy("grp", F.col("jump").alias("node")).agg(F.sum("size").alias("more"))
        ended = F.col("jump").isNull()
        step = state.join(above, F.expr("grp <=> g and jump = j"), "left").select(
            "grp",
            "node",
            F.col("jump2").alias("jump"),
            F.coalesce("root", "root2").alias("root"),
            F.when(ended, F.col("depth")).otherwise(F.lit(span) + F.col("depth2")).alias("depth"),
            "size",
            F.when(ended | F.col("path").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path"),
            F.coalesce("near", "near2").alias("near"),
            F.least("least", "least2").alias("least"),
        )
        state = kept(step.alias("s").join(added.alias("d"), F.expr("s.grp <=> d.grp and s.node = d.node"), "left").select("s.grp", "s.node", "jump", "root", "depth", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), "path", "near", "least"))
        span *= 2
        if state.where("jump is not null").isEmpty():
            break
    state = state.select(*columns)
    lost = F.col("root").isNull()
    null = F.lit(None)
    trees = state.where(~lost).select("grp", "node", "root", "depth", (F.col("size") - 1).alias("descendants"), "path", F.col("near.id").alias("near"), F.col("near.mark").alias("near_mark"), null.cast("string").alias("cycle"), null.cast("boolean").alias("on_cycle"), null.cast("long").alias("length"))
    rest = state.where(lost)
    rings = rest.select(F.col("grp").alias("g"), F.col("jump").alias("j")).distinct()
    rings = rings.join(rest.select("grp", "node", "least"), F.expr("g <=> grp and j = node")).select("g", "j", F.col("least").alias("cycle"))
    sizes = rings.groupBy(F.col("g").alias("g3"), F.col("cycle").alias("c3")).agg(F.count("*").alias("length"))
    told = rest.select("grp", "node", "jump").join(rings, F.expr("grp <=> g and jump = j")).drop("g", "j")
    told = told.join(rings.select(F.col("g").alias("g2"), F.col("j").alias("j2")), F.expr("grp <=> g2 and node = j2"), "left").join(sizes, F.expr("grp <=> g3 and node = c3"), "left")
    empty = null.cast("string")
    told = told.select("grp", "node", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(-1).cast("long").alias("descendants"), null.cast("array<string>").alias("path"), empty.alias("near"), empty.alias("near_mark"), "cycle", F.col("j2").isNotNull().alias("on_cycle"), "length")
    return trees.unionByName(told)


def hierarchy(df: DataFrame, group: str = "perception_cycle_id", node: str = "target_id", parent: str = "parent_id", with_paths: bool = True, max_local: int = MAX_LOCAL, mark: Column | None = None) -> DataFrame:
    """The rows of OUT, one for each distinct node; paths are arrays, so ids may hold any sign.

    An empty table gives an empty result. The sizes of the groups are counted first
    (with pre-aggregation, two columns read) to find the groups that are too large for
    one task; usually there are none and the rest is one shuffle.
    """
    nodes = nodes_of(df, group, node, parent, mark)
    large = df.where(F.col(node).isNotNull()).groupBy(F.col(group).cast("string").alias("grp")).agg(F.count("*").alias("n")).where(F.col("n") > max_local).select("grp")
    large = kept(large)
    if large.isEmpty():
        return _local(nodes.withColumn("k", F.lit(0)), "k", with_paths)
    nodes = kept(nodes)
    is_large = F.expr("n.grp <=> l.grp")
    small = nodes.alias("n").join(large.alias("l"), is_large, "left_anti")
    big = nodes.alias("n").join(large.alias("l"), is_large, "left_semi").withColumn("grp", F.coalesce("grp", F.lit("\0null")))
    known = big.select("grp", F.col("node").alias("up"), F.lit(1).alias("there"))
    big = big.join(known, ["grp", "up"], "left").select("grp", "node", F.when(F.col("there") == 1, F.col("up")).alias("up"), "mark")
    parts = kept(components(big))
    huge = parts.groupBy("grp", "comp").agg(F.count("*").alias("n")).where(F.col("n") > max_local).select("grp", "comp")
    huge = kept(huge)
    out = _local(small.withColumn("k", F.lit(0)), "k", with_paths)
    split = _local(parts.join(huge, ["grp", "comp"], "left_anti"), "comp", with_paths)
    if not huge.isEmpty():
        split = split.unionAll(doubling(parts.join(huge, ["grp", "comp"], "left_semi").select("grp", "node", "up", "mark", "ring"), with_paths))
    return out.unionAll(split.withColumn("grp", F.when(F.col("grp") != "\0null", F.col("grp"))))


def found(df: DataFrame) -> DataFrame:
    rows = hierarchy(df, with_paths=False)
    return rows.select(F.col("grp").alias("perception_cycle_id"), F.col("node").alias("target_id"), F.col("root").alias("root_id"), "depth", F.col("descendants").alias("n_descendants"))


def paths(df: DataFrame, **kwargs) -> DataFrame:
    """(grp, node, root, depth, descendants, path): the path as text, ids joined by '/'."""
    return hierarchy(df, with_paths=True, **kwargs).select("grp", "node", "root", "depth", "descendants", F.array_join("path", "/").alias("path"))


def descendants(df: DataFrame, **kwargs) -> DataFrame:
    """(grp, node, descendant): each pair of a node and one below it, from the paths.

    As many rows as the depths add up to. Nodes on or below a cycle have none.
    """
    rows = hierarchy(df, with_paths=True, **kwargs).where("depth > 0")
    above = F.slice("path", F.lit(1), F.size("path") - 1)
    return rows.select("grp", F.explode(above).alias("above"), F.col("node").alias("descendant")).withColumnRenamed("above", "node")


def cycles(df: DataFrame, group: str = "perception_cycle_id", node: str = "target_id", parent: str = "parent_id", **kwargs) -> DataFrame:
    """(grp, node, parent, length): the back-edge of each cycle, from its least node, and the cycle's nodes."""
    rows = hierarchy(df, group, node, parent, with_paths=False, mark=F.min(F.when(F.col(parent) != "", F.col(parent))), **kwargs)
    ends = rows.where("length is not null").select("grp", "node", "length")
    ups = nodes_of(df, group, node, parent).select(F.col("grp").alias("g"), F.col("node").alias("n"), F.col("up").alias("parent"))
    return ends.join(ups, F.expr("grp <=> g and node = n")).select("grp", "node", "parent", "length")
