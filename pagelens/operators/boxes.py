"""Boxes: validation, normalisation, proximity, containment, overlap and coverage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.columns import cell_of, fixed, iou, js_round

CANONICAL = "m1-screenshot-pixels"
#: Share of the image from which a box is refused, and pixels a clamp may move.
MOST_COVERAGE, TOLERANCE = 0.45, 2


def validated(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct(valid, reason, x, y, width, height, coverage, clamped) of a box on an image.

    The first failing rule gives the reason: null box, not finite, no size, no image, fully
    outside, too large. y isn't bounded by the image's height before its size is.
    """
    x, y, w, h = (c.cast("double") for c in (x, y, w, h))
    inf = float("inf")
    finite = ~(F.isnan(x) | F.isnan(y) | F.isnan(w) | F.isnan(h)) & (F.abs(x) < inf) & (F.abs(y) < inf) & (F.abs(w) < inf) & (F.abs(h) < inf)
    cx = F.greatest(F.lit(0.0), F.least(width - 1.0, js_round(x).cast("double")))
    cy = F.greatest(F.lit(0.0), js_round(y).cast("double"))
    cw = F.greatest(F.lit(1.0), F.least(width - cx, js_round(w).cast("double")))
    ch = F.greatest(F.lit(1.0), F.least(height - cy, js_round(h).cast("double")))
    cover = fixed(cw * ch / F.when(width * height > 0, width * height), 4)
    early = (
        F.when(x.isNull() | y.isNull() | w.isNull() | h.isNull(), "box_null_or_invalid_type")
        .when(~finite, "non_finite_coordinates")
        .when((w <= 0) | (h <= 0), "zero_or_negative_dimensions")
        .when(F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0)) <= 0, "invalid_target_dimensions")
        .when((x >= width) | (y >= height) | (x + w <= 0) | (y + h <= 0), "box_completely_outside_image")
    )
    reason = F.coalesce(early, F.when(cover >= MOST_COVERAGE, "suspiciously_large_coverage_ratio"))
    some = lambda v: F.when(early.isNull(), v)
    moved = (F.abs(cx - x) > TOLERANCE) | (F.abs(cy - y) > TOLERANCE) | (F.abs(cw - w) > TOLERANCE) | (F.abs(ch - h) > TOLERANCE)
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"), some(cx).cast("int").alias("x"), some(cy).cast("int").alias("y"), some(cw).cast("int").alias("width"), some(ch).cast("int").alias("height"), some(cover).alias("coverage"), some(moved).alias("clamped"))


def normalised(x: Column, y: Column, w: Column, h: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column, canonical: Column) -> Column:
    """The box scaled from its source size into the target's, then validated.

    Nothing is scaled where the box is canonical and the source size is unknown or equal.
    """
    same = canonical & (from_w.isNull() | from_h.isNull() | ((from_w == to_w) & (from_h == to_h)))
    sx, sy = F.when(same, 1.0).otherwise(to_w / from_w), F.when(same, 1.0).otherwise(to_h / from_h)
    scaled = [js_round(v * s).cast("double") for v, s in ((x, sx), (y, sy), (w, sx), (h, sy))]
    return validated(*[F.when(same, v.cast("double")).otherwise(z) for v, z in zip((x, y, w, h), scaled, strict=True)], to_w, to_h)


def nearby(left: DataFrame, right: DataFrame, dx: int = 120, dy: int = 60) -> DataFrame:
    """left (page, id, x, y) with `near`, the first right row (by ord) within dx and dy.

    An equi-join on grid cells of that size: a left corner looks into its own and the eight
    cells around, so the work grows with the boxes, not with their pairs. Pages or cells
    with many rows are split by Spark's adaptive skew handling.
    """
    cell = lambda c, size: F.floor(F.col(c) / size)
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    probe = left.withColumn("_cx", cell("x", dx)).withColumn("_cy", cell("y", dy)).withColumn("_i", around).withColumn("_j", around)
    probe = probe.select(*left.columns, (F.col("_cx") + F.col("_i")).alias("_cx"), (F.col("_cy") + F.col("_j")).alias("_cy"))
    held = right.where("x is not null and y is not null").select("page", F.col("id").alias("_rid"), F.col("ord").alias("_rord"), F.col("x").alias("_rx"), F.col("y").alias("_ry"), cell("x", dx).alias("_cx"), cell("y", dy).alias("_cy"))
    pairs = probe.join(held, ["page", "_cx", "_cy"]).where((F.abs(F.col("_rx") - F.col("x")) < dx) & (F.abs(F.col("_ry") - F.col("y")) < dy))
    first = pairs.groupBy("page", "id").agg(F.min_by("_rid", "_rord").alias("near"))
    return left.join(first, ["page", "id"], "left")


def containing(points: DataFrame, boxes: DataFrame, cell: int = 256) -> DataFrame:
    """points (page, id, px, py) with `inside`, the first box (by ord) that holds the point.

    A box is listed in every grid cell it covers, a point in one; edges count as inside.
    """
    probe = points.withColumn("_cx", cell_of(F.col("px"), cell)).withColumn("_cy", cell_of(F.col("py"), cell))
    held = boxes.where("w > 0 and h > 0").select("page", F.col("id").alias("_bid"), F.col("ord").alias("_bord"), "x", "y", "w", "h")
    held = held.withColumn("_cx", F.explode(F.sequence(cell_of(F.col("x"), cell), cell_of(F.col("x") + F.col("w"), cell)))).withColumn("_cy", F.explode(F.sequence(cell_of(F.col("y"), cell), cell_of(F.col("y") + F.col("h"), cell))))
    hit = probe.join(held, ["page", "_cx", "_cy"]).where(F.col("px").between(F.col("x"), F.col("x") + F.col("w")) & F.col("py").between(F.col("y"), F.col("y") + F.col("h")))
    first = hit.groupBy("page", "id").agg(F.min_by("_bid", "_bord").alias("inside"))
    return points.join(first, ["page", "id"], "left")


def overlaps(boxes: DataFrame, least: float, cell: int = 256) -> DataFrame:
    """(page, a, b, iou) of pairs of boxes of a page whose IoU exceeds `least`, a < b.

    Pairs come from shared grid cells; a pair that shares several is taken in the cell of
    its common corner only, so nothing has to be made distinct.
    """
    held = boxes.where("w > 0 and h > 0").select("page", "id", "x", "y", "w", "h")
    held = held.withColumn("_cx", F.explode(F.sequence(cell_of(F.col("x"), cell), cell_of(F.col("x") + F.col("w"), cell)))).withColumn("_cy", F.explode(F.sequence(cell_of(F.col("y"), cell), cell_of(F.col("y") + F.col("h"), cell))))
    a, b = held.alias("a"), held.alias("b")
    corner = (cell_of(F.greatest("a.x", "b.x"), cell) == F.col("a._cx")) & (cell_of(F.greatest("a.y", "b.y"), cell) == F.col("a._cy"))
    value = iou(*[F.col(f"{s}.{c}") for s in "ab" for c in "xywh"])
    pairs = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")) & (F.col("a.id") < F.col("b.id"))).where(corner)
    return pairs.select(F.col("a.page").alias("page"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), value.alias("iou")).where(F.col("iou") > least)


#: Overlap beyond which a box gives way to a better one.
MOST_OVERLAP = 0.55


def suppressed(boxes: DataFrame, most: float = MOST_OVERLAP) -> DataFrame:
    """Greedy suppression: by score downwards a box stays if no kept one of its page overlaps it more.

    Boxes has page, id, ord, score, x, y, w, h; ties go to the lower ord. The greedy order
    is inherently sequential within a page, so pages are read one at a time from sorted
    rows; a page's kept boxes are looked up by grid cell.
    """
    names = ["page", "id", "score"]

    def overlap(p: tuple, q: tuple) -> float:
        w = min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0])
        h = min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / (p[2] * p[3] + q[2] * q[3] - w * h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid = None, {}
        for batch in batches:
            out = []
            for page, ident, score, *box in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page != now:
                    now, grid = page, {}
                left, top, right, bottom = (int(max(-64, min(64, v // 256))) for v in (box[0], box[1], box[0] + box[2], box[1] + box[3]))
                cells = [(i, j) for i in range(left, right + 1) for j in range(top, bottom + 1)]
                if not any(overlap(box, k) > most for c in cells for k in grid.get(c, ())):
                    for c in cells:
                        grid.setdefault(c, []).append(box)
                    out.append((page, ident, score))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], batch.schema.field(i).type) for i in range(3)], names)

    rows = boxes.where("w > 0 and h > 0").select("page", "id", "score", *[F.col(c).cast("double") for c in "xywh"], "ord")
    rows = rows.repartition("page").sortWithinPartitions("page", F.col("score").desc(), "ord").drop("ord")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page {kinds['page']}, id {kinds['id']}, score {kinds['score']}")
