"""Deeply nested records to flat, linked tables: single-pass tagged emission.

One depth-first visitor walks each JSON payload once and emits rows of all tables
together, each with the tag of its table, a primary key, its parent's key and its
payload. Writing partitions the rows by tag; reading a table applies its schema.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.session import shared_folder

TAGS = ("packet", "element", "state", "spatial", "interactive_ancestor", "metadata", "warning")
SCHEMA = "record_id long, tag string, pk string, parent_pk string, perception_cycle_id string, target_id string, link string, payload string"
#: The schema each table's payload gets when it is read.
TABLES = {
    "packet": "type string, status string",
    "element": "tag string, role string, semanticName string, text string",
    "state": "visibility string, enabled boolean, checked boolean, editable boolean",
    "spatial": "x long, y long, width long, height long",
    "interactive_ancestor": "target_id string, tag string, role string, name string",
    "metadata": "tabId string",
    "warning": "code string, target_id string, detail string",
}


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not valid JSON")


#: One sign or plain value of JSON; a string is scanned from its opening quote.
_TOKEN = re.compile(r"[ \t\r\n]*(?:([\[\]{},:\"])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))")
_PLAIN = {"true": True, "false": False, "null": None}


def _pushdown(text: str):
    """json.loads with a stack of its own, for texts nested too deeply for recursion."""
    whole: list = []
    stack: list = [whole]
    keys: list = [None]
    want, pos = "value", 0  # or "first" (value or end), "key", "first key", "colon", "after"
    while text[pos:].strip(" \t\r\n") if len(stack) == 1 else True:
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"no JSON at {pos}")
        pos, sign = m.end(), m[1]
        if sign == '"' or m[2] or m[3] or sign in ("[", "{"):
            if sign == '"':
                v, pos = scanstring(text, pos)
            else:
                v = {} if sign == "{" else [] if sign == "[" else _PLAIN[m[3]] if m[3] else float(m[2]) if set(m[2]) & set(".eE") else int(m[2])
            if want in ("key", "first key") and isinstance(v, str):
                keys[-1], want = v, "colon"
                continue
            if want not in ("value", "first"):
                raise ValueError(f"no value wanted before {pos}")
            if isinstance(stack[-1], dict):
                stack[-1][keys[-1]] = v
            else:
                stack[-1].append(v)
            want = "after"
            if sign in ("[", "{"):
                stack.append(v)
                keys.append(None)
                want = "first key" if sign == "{" else "first"
        elif sign == ":" and want == "colon":
            want = "value"
        elif sign == "," and want == "after" and len(stack) > 1:
            want = "key" if isinstance(stack[-1], dict) else "value"
        elif sign in ("]", "}") and want in ("after", "first" if sign == "]" else "first key") and len(stack) > 1 and isinstance(stack[-1], list if sign == "]" else dict):
            stack.pop()
            keys.pop()
            want = "after"
        else:
            raise ValueError(f"{sign} before {pos}")
    if len(whole) != 1 or want != "after":
        raise ValueError("no JSON")
    return whole[0]


def parsed(text: str):
    """The value of a JSON text, however deep; a ValueError if it isn't one."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _pushdown(text)


def dumped(v) -> str:
    """The JSON text of a value, however deep."""
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list = [(v, "")]
    while stack:
        x, lead = stack.pop()
        out.append(lead)
        if isinstance(x, dict) and x:
            stack.append((_END, "}"))
            stack += [(w, f"{', ' if i else '{'}{json.dumps(str(k), ensure_ascii=False)}: ") for i, (k, w) in reversed(list(enumerate(x.items())))]
        elif isinstance(x, list) and x:
            stack.append((_END, "]"))
            stack += [(w, ", " if i else "[") for i, w in reversed(list(enumerate(x)))]
        elif x is not _END:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


_END = object()


def _whole(v) -> int | None:
    """A number in whole pixels, half up; also from text like "12" or "12px"."""
    try:
        x = float(v.strip().removesuffix("px") if isinstance(v, str) else v)
        return int(x // 1 + (x % 1 >= 0.5))
    except (TypeError, ValueError, OverflowError):
        return None


def _box(v) -> list[int | None]:
    """x, y, width, height of a box in any of its forms."""
    if isinstance(v, str):
        try:
            v = parsed(v)
        except ValueError:
            v = v.split(",")
    while isinstance(v, dict) and isinstance(v.get("bbox", v.get("box")), (dict, list)) and not ({"width", "right"} & v.keys()):
        v = v.get("bbox", v.get("box"))
    if isinstance(v, list):
        return [_whole(x) for x in [*v, None, None, None, None][:4]]
    if not isinstance(v, dict):
        return [None] * 4
    one = lambda *names: next((w for n in names if (w := _whole(v.get(n))) is not None), None)
    x, y, w, h = one("x", "left"), one("y", "top"), one("width", "w"), one("height", "h")
    if w is None and x is not None and (right := one("right")) is not None:
        w = right - x
    if h is None and y is not None and (bottom := one("bottom")) is not None:
        h = bottom - y
    return [x, y, w, h]


def _text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return v if isinstance(v, str) else dumped(v)


def _opened(v):
    """A value that was written as JSON text inside the JSON."""
    if isinstance(v, str) and v.strip()[:1] in ("{", "["):
        try:
            return parsed(v)
        except ValueError:
            return v
    return v


_OWN = frozenset(("children", "state", "spatial", "interactive_ancestor"))


def visit(payload: str | None) -> Iterator[tuple[str, str, str, str | None, str, str, object]]:
    """(tag, pk, parent_pk, cycle, target_id, link, value) of every part, depth first.

    A null, empty or broken payload emits nothing. A packet is any object with a
    perceptionCycleId, however deep its wrapping; its elements stand in a list or by
    target_id, flat with parent ids or nested as children; a packet inside another one's
    fields is a packet of its own. Parser, stack and writer are explicit, so nesting isn't
    bounded by Python's recursion. A part's value keeps all its fields but the parts that
    are rows of their own.
    """
    if payload is None or not payload.strip():
        return
    try:
        root = parsed(payload)
    except ValueError:
        return
    n_packets = n_elements = 0
    # a task: (value, kind, packet key, cycle, parent element's target_id, target_id by key)
    stack: list[tuple] = [(root, "any", "", None, "", "")]
    while stack:
        v, kind, pkey, cycle, above, name = stack.pop()
        if kind == "any":
            v = _opened(v)
            if isinstance(v, list):
                stack += [(x, "any", pkey, None, "", "") for x in reversed(v)]
            elif isinstance(v, dict) and "perceptionCycleId" not in v:
                stack += [(x, "any", pkey, None, "", "") for x in reversed(v.values()) if isinstance(x, (dict, list, str))]
            elif isinstance(v, dict):
                n_packets += 1
                pkey = f"p{n_packets}"
                cycle = None if v["perceptionCycleId"] is None else _text(v["perceptionCycleId"])
                yield "packet", pkey, "", cycle, "", "", {k: x for k, x in v.items() if k not in ("tree", "elements", "metadata")}
                meta = _opened(v.get("metadata"))
                if meta:
                    inner = meta if isinstance(meta, dict) else {}
                    yield "metadata", f"{pkey}/m", pkey, cycle, "", _text(inner.get("tabId")), {k: x for k, x in inner.items() if k != "warnings"} if inner else meta
                    warnings = _opened(inner.get("warnings")) or []
                    for i, w in enumerate(warnings if isinstance(warnings, list) else [warnings]):
                        w = w if isinstance(w, dict) else {"code": w}
                        yield "warning", f"{pkey}/m/{i}", f"{pkey}/m", cycle, _text(w.get("target_id")), _text(w.get("code")), w
                stack += [(x, "any", pkey, None, "", "") for k, x in reversed(v.items()) if k not in ("tree", "elements", "metadata") and isinstance(x, (dict, list, str))]
                for part in ("tree", "elements"):
                    stack.append((_opened(v.get(part)), "elements", pkey, cycle, "", ""))
        elif kind == "elements":
            if isinstance(v, dict):
                stack += [(x, "element", pkey, cycle, above, k) for k, x in reversed(v.items())]
            elif isinstance(v, list):
                stack += [(x, "element", pkey, cycle, above, "") for x in reversed(v)]
        elif isinstance(v, dict):
            n_elements += 1
            key = f"{pkey}/e{n_elements}"
            tid = _text(v.get("target_id")) or name
            hierarchy = v.get("hierarchy") if isinstance(v.get("hierarchy"), dict) else {}
            parent = above or _text(hierarchy.get("parent_id", v.get("parent_id")))
            yield "element", key, pkey, cycle, tid, parent, {k: x for k, x in v.items() if k not in _OWN}
            if state := _opened(v.get("state")):
                yield "state", f"{key}/s", key, cycle, tid, _text(state.get("visibility")) if isinstance(state, dict) else _text(state), state
            if spatial := v.get("spatial"):
                box = _box(spatial)
                yield "spatial", f"{key}/b", key, cycle, tid, ",".join(_text(x) for x in box), dict(spatial if isinstance(spatial, dict) else {}, **dict(zip(("x", "y", "width", "height"), box, strict=True)))
            if near := _opened(v.get("interactive_ancestor")) or _opened(hierarchy.get("interactive_ancestor")):
                yield "interactive_ancestor", f"{key}/a", key, cycle, tid, _text(near.get("target_id")) if isinstance(near, dict) else _text(near), near
            if v.get("children"):
                stack.append((v["children"], "elements", pkey, cycle, tid, ""))


def shred(df: DataFrame, id_column: str = "record_id", payload_column: str = "payload") -> DataFrame:
    """All parts of all payloads as tagged rows of SCHEMA.

    No shuffle: every input row is visited where it is read, and batches are put out as
    they fill, so a task holds one payload's parts at a time. Repeated payloads under
    other ids come out under each id. Extra columns are not read.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(out)], names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for rid, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for tag, pk, parent, cycle, tid, link, value in visit(payload):
                    for c, x in zip(out, (rid, tag, f"{rid}/{pk}", f"{rid}/{parent}" if parent else None, cycle, tid, link, dumped(value)), strict=True):
                        c.append(x)
                    if len(out[0]) >= 8192:
                        yield full()
        if out[0]:
            yield full()

    return df.select(F.col(id_column).cast("long"), F.col(payload_column).cast("string")).mapInArrow(run, SCHEMA)


def write_tables(rows: DataFrame, path: str) -> None:
    """Write tagged rows once, a folder for each table."""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One written table, its payload under its schema, and the whole payload beside it.

    Only the table's own folder is read. A field whose value doesn't fit its type is null;
    the row stays. A table without rows is empty.
    """
    own = all_tables(spark, path).where(F.col("tag") == tag)
    return own.select("record_id", "pk", "parent_pk", "perception_cycle_id", F.col("target_id").alias("element_id"), "link", F.from_json("payload", TABLES[tag]).alias("v"), "payload").select("record_id", "pk", "parent_pk", "perception_cycle_id", "element_id", "link", "v.*", "payload")


def all_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def tables(df: DataFrame) -> str:
    """The folder of the shared place that holds the tables of all payloads of `df`, written in one pass."""
    path = f"{shared_folder(df.sparkSession)}/records-{uuid.uuid4().hex}"
    write_tables(shred(df), path)
    return path


def found(df: DataFrame) -> DataFrame:
    """(record_id, perception_cycle_id, kind, target_id, link) of every child row, from the written tables."""
    rows = all_tables(df.sparkSession, tables(df))
    return rows.where(F.col("tag") != "packet").select("record_id", "perception_cycle_id", F.col("tag").alias("kind"), "target_id", "link")


def one_table(df: DataFrame, tag: str) -> DataFrame:
    return read_table(df.sparkSession, tables(df), tag)


def links(df: DataFrame) -> DataFrame:
    """(tag, keys_unique, orphans): each table's primary keys, and its rows whose parent key no parent row has."""
    rows = all_tables(df.sparkSession, tables(df)).select("tag", "pk", "parent_pk")
    has = rows.select(F.col("tag").alias("up"), F.col("pk").alias("key"))
    up = F.when(F.col("tag").isin("element", "metadata"), "packet").when(F.col("tag") == "warning", "metadata").when(F.col("tag") != "packet", "element")
    child = rows.withColumn("up", up)
    lost = child.where("up is not null").join(has, (child.up == has.up) & (child.parent_pk == has.key), "left_anti").groupBy("tag").agg(F.count("*").alias("orphans"))
    keys = rows.groupBy("tag", "pk").agg(F.count("*").alias("n")).groupBy("tag").agg((F.max("n") == 1).alias("keys_unique"))
    return keys.join(lost, "tag", "left").select("tag", "keys_unique", F.coalesce("orphans", F.lit(0)).alias("orphans"))
