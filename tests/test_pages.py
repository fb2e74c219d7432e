from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.functions import columns as c
from pagelens.operators import boxes, pages, raster, redaction, trajectory
from pagelens.plans.redaction import TRUTH
from pagelens.sources import markup, png


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers(spark):
    assert one(spark, c.js_round(F.lit(-0.5))) == 0 and one(spark, c.js_round(F.lit(2.5))) == 3
    assert one(spark, c.falsy(F.lit(0.0), F.lit(3.0))) == 3.0
    assert one(spark, c.rolling_hash(F.lit("button||Add to cart|sig"))) == "944973ce"
    assert one(spark, c.ratio_label(F.lit(1920), F.lit(1080))) == "approximately 16:9" and one(spark, c.ratio_label(F.lit(50), F.lit(7))) == "50:7"


@pytest.mark.parametrize(
    ("box", "size", "want"),
    [
        ((100, 100, 0, 100), (1920, 1080), "zero_or_negative_dimensions"),
        ((100, 100, -50, 50), (1920, 1080), "zero_or_negative_dimensions"),
        ((float("nan"), 100, 100, 100), (1920, 1080), "non_finite_coordinates"),
        ((0, float("inf"), 100, 100), (1920, 1080), "non_finite_coordinates"),
        ((0, 0, 1800, 1000), (1920, 1080), "suspiciously_large_coverage_ratio"),
        ((2000, 0, 10, 10), (1920, 1080), "box_completely_outside_image"),
        ((0, 0, 10, 10), (0, 1080), "invalid_target_dimensions"),
        ((920, 950, 120, 100), (1000, 1000), (920, 950, 80, 50)),
        ((420, 180, 120, 120), (1920, 1080), (420, 180, 120, 120)),
    ],
)
def test_box_rules(spark, box, size, want):
    v = one(spark, boxes.validated(*[F.lit(float(x)) for x in box], *[F.lit(x) for x in size]))
    assert v.reason == want if isinstance(want, str) else (v.valid, v.x, v.y, v.width, v.height) == (True, *want)


@pytest.mark.parametrize(("box", "source", "target", "want"), [((100, 50, 80, 80), (1280, 720), (2560, 1440), (200, 100, 160, 160)), ((320, 200, 160, 160), (1280, 800), (1920, 1080), (480, 270, 240, 216))])
def test_box_scaling(spark, box, source, target, want):
    v = one(spark, boxes.normalised(*[F.lit(x) for x in box], *[F.lit(float(x)) for x in (*source, *target)], F.lit(False)))
    assert (v.x, v.y, v.width, v.height) == want


def test_suppression_keeps_no_overlapping_pair(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 3, i, i, float(rng.integers(5)), *[int(v) for v in rng.integers(0, 300, 2)], *[int(v) for v in rng.integers(20, 200, 2)]) for i in range(150)]
    df = spark.createDataFrame(rows, "page int, id int, ord int, score double, x int, y int, w int, h int")
    kept = boxes.suppressed(df).select("id")
    assert 3 < kept.count() < 150 and boxes.overlaps(df.join(kept, "id"), 0.55).count() == 0


def test_truth_table(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(TRUTH)], "n int, t string, c string")
    out = {r.n: r.d for r in rows.select("n", redaction.detections(F.col("t"), F.col("c")).alias("d")).collect()}
    for i, (_, _, kind, score, value) in enumerate(TRUTH):
        assert [(d.type, d.value, d.confidence) for d in out[i]] == ([(kind, value, score)] if kind else []), TRUTH[i]


def test_gate_is_closed_for_leaks(spark):
    def leaks(text, values):
        return one(spark, redaction.gate(F.lit(text), F.lit(text), F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")))

    assert leaks("all clean", ["ana@example.com"]) == []
    assert leaks("to ana@example.com", ["ana@example.com"]) == ["value:ana***"]
    assert leaks("data:image/png;base64,AAAA", []) == ["image_in_text", "image_in_payload"]
    assert leaks("1234 5678 9012 3456", []) == ["card_number"] and leaks("sk-" + "a" * 24, []) == ["api_key"] and leaks("a button", ["button"]) == []


def test_streaks(spark):
    s = spark.createDataFrame([(1, i, "a", x) for i, x in enumerate("ppqqqp", 1)], "task int, seq int, action string, state string")
    assert [r.streak for r in trajectory.streaks(s).orderBy("seq").collect()] == [1, 2, 1, 2, 3, 1]


def test_first_seen_depths_caps_and_versions(spark):
    s = spark.createDataFrame([(1, i, "a" if i < 3 else "done", x, f"u{i}") for i, x in enumerate(["p", "q", "p", "", "r"], 1)], "task int, seq int, action string, state string, url string")
    seen = {r.state: (r.parent, r.depth, r.url, r.visits) for r in trajectory.first_seen(s).collect()}
    assert seen == {"p": (None, 0, "u3", 2), "q": ("p", 1, "u2", 1), "": ("p", 1, "u4", 1), "r": ("", 2, "u5", 1)}
    assert [tuple(r) for r in trajectory.capped(s, 2).collect()] == [(1, 2, "max_iterations")] and trajectory.capped(s).first().status == "done"
    pages = spark.createDataFrame([("g", 1, "u", "m"), ("g", 2, "u", "m"), ("g", 3, "u", "n"), ("g", 4, None, "n"), ("g", 5, None, "n")], "grp string, seq int, url string, mark string")
    assert [r.version for r in trajectory.versions(pages).orderBy("seq").collect()] == [1, 1, 2, 3, 3]


def test_covers_stay_in_the_image():
    image = np.zeros((4, 6, 4), np.uint8)
    mask = raster.mask_of([(-5, -5, 7, 6), (4.5, 2.2, 100, 100), (1, 1, 0, 3)], 4, 6)
    assert mask.sum() == 2 + 2 * 2 and (raster.covered(image, mask)[mask] == raster.COVER).all() and not image.any()


def test_breadcrumbs_match_the_stack(spark):
    rng = np.random.default_rng(6)
    runs = [[str(x) for x in rng.integers(0, 6, rng.integers(1, 25))] for _ in range(40)]
    rows = [(k, i, x) for k, r in enumerate(runs) for i, x in enumerate(r)]
    got = {r.task: r.crumbs for r in trajectory.breadcrumbs(spark.createDataFrame(rows, "task int, seq int, state string")).collect()}
    for k, run in enumerate(runs):
        stack = []
        for x in run:
            stack = stack[: stack.index(x) + 1] if x in stack else [*stack, x]
        assert got[k] == " > ".join(f"{i}. {x}" for i, x in enumerate(stack, 1))


def test_png_round_trip_and_regions():
    image = np.full((300, 400, 4), 255, np.uint8)
    assert raster.regions(image) == []
    image[100:135, 100:101, :3] = image[100:135, 199:200, :3] = image[100:101, 100:200, :3] = image[134:135, 100:200, :3] = 20
    again = png.decode(png.encode(image))
    assert (again == image).all() and png.decode(b"no") is None
    found = raster.regions(again)
    assert len(found) == 1
    _, x, y, w, h, *rest = found[0]
    assert x >= 0 and y >= 0 and x + w <= 400 and y + h <= 300 and abs(w - 100) < 6 and abs(h - 35) < 6 and all(v >= 0 for v in rest)


def test_labels_match_flood_fill():
    rng = np.random.default_rng(1)
    for corners in (True, False):
        mask = rng.random((40, 50)) < 0.45
        labels, n = raster.labelled(mask, corners)
        seen = np.zeros_like(mask)
        count = 0
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
        for y, x in np.argwhere(mask):
            if not seen[y, x]:
                count += 1
                todo, own = [(y, x)], set()
                seen[y, x] = True
                while todo:
                    i, j = todo.pop()
                    own.add(int(labels[i, j]))
                    for a, b in steps:
                        p, q = i + a, j + b
                        if 0 <= p < 40 and 0 <= q < 50 and mask[p, q] and not seen[p, q]:
                            seen[p, q] = True
                            todo.append((p, q))
                assert len(own) == 1
        assert count == n


def test_blur_only_changes_its_box():
    image = np.random.default_rng(2).integers(0, 255, (40, 40, 4), np.uint8)
    out = raster.blurred(image, 10, 12, 9, 7, 2, 2)
    same = out == image
    same[12:19, 10:19] = True
    assert same.all() and out[12:19, 10:19].std() < image[12:19, 10:19].std()


def test_markup():
    rows = markup.parse("<div id=a><p>one<p>two <b>x</b></p><script>if (a</p>b) no</script></div><br>")
    assert [(r[3], r[9]) for r in rows] == [("div", None), ("p", "one"), ("p", "two"), ("b", "x"), ("script", None), ("br", None)]
    assert rows[3][1] == 2 and rows[3][2] == 2 and markup.parse(None) == []


def test_occlusion(spark):
    rows = [("p", 1, 10, 10, 100, 100), ("p", 2, 0, 0, 300, 300), ("p", 3, 500, 500, 10, 10), ("p", 4, 5000, 5, 10, 10)]
    df = spark.createDataFrame(rows, "page string, ord int, x int, y int, w int, h int")
    assert {r.ord: r.occlusion for r in pages.occlusion(df, 1920, 1080).collect()} == {1: "OCCLUDED", 2: "NOT_OCCLUDED", 3: "NOT_OCCLUDED", 4: "UNKNOWN"}
