from __future__ import annotations

import json

from pagelens.operators import nested

PACKET = {
    "perceptionCycleId": "c1",
    "elements": [
        {"target_id": "a", "state": {"visibility": "VISIBLE"}, "spatial": [1, 2, 3, 4], "hierarchy": {"parent_id": ""}, "children": [{"target_id": "b", "spatial": {"left": 1.6, "top": "2", "right": 11, "bottom": 12}, "interactive_ancestor": {"target_id": "a"}}]},
        {"target_id": "c", "state": {}, "spatial": {"bbox": [5, 6, 7, 8]}, "interactive_ancestor": None, "hierarchy": {"parent_id": "a", "interactive_ancestor": {"target_id": "b"}}},
    ],
    "metadata": json.dumps({"tabId": 7, "warnings": [{"code": "STALE", "target_id": "b"}]}),
}
WANT = {
    ("c1", "element", "a", ""), ("c1", "state", "a", "VISIBLE"), ("c1", "spatial", "a", "1,2,3,4"), ("c1", "element", "b", "a"), ("c1", "spatial", "b", "2,2,9,10"), ("c1", "interactive_ancestor", "b", "a"),
    ("c1", "element", "c", "a"), ("c1", "spatial", "c", "5,6,7,8"), ("c1", "interactive_ancestor", "c", "b"), ("c1", "metadata", "", "7"), ("c1", "warning", "b", "STALE"),
}


def frame(spark, payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "record_id long, payload string, tag string")


def test_all_layouts_give_the_same_rows(spark):
    by_id = dict(PACKET, elements={"a": {k: v for k, v in PACKET["elements"][0].items() if k != "target_id"}, "c": PACKET["elements"][1]})
    tree = {("tree" if k == "elements" else k): v for k, v in PACKET.items()}
    layouts = [PACKET, [PACKET], {"event": "E", "payload": PACKET}, {"envelope": {"v": 2}, "data": {"payload": PACKET}}, by_id, tree, {"data": json.dumps(PACKET)}]
    out = nested.found(frame(spark, [json.dumps(x) for x in layouts])).collect()
    for i in range(len(layouts)):
        assert {(r.perception_cycle_id, r.kind, r.target_id, r.link) for r in out if r.record_id == i} == WANT


def test_broken_empty_null_and_deep(spark):
    deep = json.dumps({"perceptionCycleId": None, "elements": []})
    chain = {"target_id": "0"}
    for i in range(1, 400):
        chain = {"target_id": str(i), "children": [chain]}
    payloads = [None, "", "  ", "{", '{"perceptionCycleId": NaN}', "[]", "3", deep, json.dumps({"perceptionCycleId": 5, "tree": [chain]})]
    out = nested.found(frame(spark, payloads)).collect()
    assert {r.record_id for r in out} == {8} and len(out) == 400 and {r.perception_cycle_id for r in out} == {"5"}


def test_any_depth_in_any_form(spark):
    deep = '{"perceptionCycleId": "c", "elements": [' + '{"target_id": "e", "children": [' * 20000 + "]}" * 20000 + "]}"
    wrapped = '{"a": ' * 20000 + json.dumps({"perceptionCycleId": "w"}) + "}" * 20000
    inside = json.dumps({"data": deep})
    field = '{"perceptionCycleId": "f", "elements": [{"target_id": "x", "other": ' + "[" * 20000 + "]" * 20000 + "}]}"
    broken = "[" * 20000
    out = nested.shred(frame(spark, [deep, wrapped, inside, field, broken, '{"a": [1,]}' + " "])).groupBy("record_id", "tag").count().collect()
    assert {(r.record_id, r.tag): r["count"] for r in out} == {(0, "packet"): 1, (0, "element"): 20000, (1, "packet"): 1, (2, "packet"): 1, (2, "element"): 20000, (3, "packet"): 1, (3, "element"): 1}


def test_pushdown_reads_what_json_reads():
    good = ['{"a": [1, -2.5e3, "x\\n\\u00e9", true, false, null, {}, []], "b": {"c": {}}}', " [ ] ", "3", '"s"', "[[1], [2, [3]]]", json.dumps(PACKET)]
    for t in good:
        assert nested._pushdown(t) == json.loads(t) and json.loads(nested.dumped(json.loads(t))) == json.loads(t)
    for t in ("", "[1,]", "[1 2]", '{"a"}', '{"a": 1,}', "{1: 2}", "[", "]", "1 2", "NaN", "[01]", '{"a" 1}', "tru", '["a]', "[1}", "1,", '{"a": 1 "b": 2}'):
        try:
            nested._pushdown(t)
        except ValueError:
            continue
        raise AssertionError(t)


def test_inner_packets_and_single_warnings(spark):
    packet = {"perceptionCycleId": "c", "metadata": {"warnings": "SLOW"}, "details": {"inner": {"perceptionCycleId": "i", "metadata": {"warnings": {"code": "ONE"}}}}}
    out = {(r.perception_cycle_id, r.kind, r.link) for r in nested.found(frame(spark, [json.dumps(packet)])).collect()}
    assert out == {("c", "metadata", ""), ("c", "warning", "SLOW"), ("i", "metadata", ""), ("i", "warning", "ONE")}


def test_written_tables_keep_their_links(spark, tmp_path):
    rows = nested.shred(frame(spark, [json.dumps([PACKET, PACKET])]))
    nested.write_tables(rows, str(tmp_path / "t"))
    elements = nested.read_table(spark, str(tmp_path / "t"), "element")
    boxes = nested.read_table(spark, str(tmp_path / "t"), "spatial")
    assert elements.count() == 6 and boxes.select("x", "y", "width", "height").where("element_id = 'b'").distinct().first() == (2, 2, 9, 10)
    first = elements.where("element_id = 'c'").first()
    assert json.loads(first.payload) == {"target_id": "c", "hierarchy": {"parent_id": "a", "interactive_ancestor": {"target_id": "b"}}}
    assert boxes.join(elements, boxes.parent_pk == elements.pk).count() == boxes.count()
