"""Queries over images. The tables hold none, so a page's boxes are drawn as its screenshot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagelens.operators import raster
from pagelens.plans.pages import elements
from pagelens.sources import markup, png
from pagelens.sources.tables import table

WIDTH, HEIGHT, SCALE = 1920, 1080, 4


def screenshots(spark, d):
    """(page, image): a PNG of each capture at a quarter of its size, boxes as outlines."""
    boxes = elements(spark, d).where("w > 0 and h > 0").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for listed in batch.column(1).to_pylist():
                canvas = np.full((HEIGHT // SCALE, WIDTH // SCALE, 4), 245, np.uint8)
                canvas[..., 3] = 255
                for b in listed:
                    x, y, w, h = (b[c] // SCALE for c in "xywh")
                    x1, y1 = min(x + w, canvas.shape[1] - 3), min(y + h, canvas.shape[0] - 3)
                    x, y = max(x, 2), max(y, 2)
                    if x1 - x > 3 and y1 - y > 3:
                        canvas[y:y1, x : x + 1, :3] = canvas[y:y1, x1 - 1 : x1, :3] = (40, 60, 200)
                        canvas[y : y + 1, x:x1, :3] = canvas[y1 - 1 : y1, x:x1, :3] = (40, 60, 200)
                images.append(png.encode(canvas))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], ["page", "image"])

    return boxes.repartition(2 * spark.sparkContext.defaultParallelism, "page").mapInArrow(run, "page string, image binary")


def _headers(spark, d):
    s = screenshots(spark, d)
    return s.select("page", png.header(png.from_data_url(png.data_url(F.col("image")))).alias("h")).select("page", "h.width", "h.height")


def _regions(spark, d):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page", "ord", "x", "y", "w", "h", "edge", "variance", "chroma", "rect", "strength"]
        kinds = [pa.string(), *[pa.int32()] * 5, *[pa.float64()] * 5]
        for batch in batches:
            rows = []
            for page, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pixels = png.decode(image)
                rows += [] if pixels is None else [(page, *r) for r in raster.regions(pixels, WIDTH, HEIGHT)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = screenshots(spark, d).mapInArrow(run, "page string, ord int, x int, y int, w int, h int, edge double, variance double, chroma double, rect double, strength double")
    kind = raster.region_class(F.col("w"), F.col("h"), WIDTH, HEIGHT, F.col("edge"), F.col("variance"), F.col("chroma"))
    return found.withColumn("class", kind).withColumn("confidence", raster.region_confidence(F.col("class"), F.col("strength"), F.col("rect"), F.col("variance")))


def _classify(spark, d):
    e = elements(spark, d).where("w > 0 and h > 0")
    edge, variance, chroma = F.col("row_id") % 50 / 100.0, F.col("row_id") % 70 / 100.0, F.col("row_id") % 41
    kind = raster.region_class(F.col("w"), F.col("h"), WIDTH, HEIGHT, edge, variance, chroma)
    out = e.select("row_id", kind.alias("class"), variance.alias("v"), (F.col("row_id") % 90 / 100.0).alias("s"), (F.col("row_id") % 100 / 100.0).alias("r"))
    return out.select("row_id", "class", raster.region_confidence(F.col("class"), F.col("s"), F.col("r"), F.col("v")).alias("confidence"))


def _skin(spark, d):
    e = elements(spark, d).where("x is not null")
    colours = [(F.col(a) * m + F.col("row_id") * k) % 256 for a, m, k in (("x", 3, 1), ("y", 5, 2), ("w", 7, 3))]
    return e.select("row_id", raster.is_skin(*colours).alias("skin"))


def _faces(spark, d):
    """Faces drawn into the boxes of images: skin with two dark spots, or without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, w, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, h = min(w, 120), min(h, 120)
                image = np.full((400, 400, 4), 255, np.uint8)
                yy, xx = np.mgrid[0:h, 0:w]
                image[50 : 50 + h, 50 : 50 + w, :3] = np.stack([210 - yy % 12, 160 - xx % 9, np.full((h, w), 130)], axis=2)
                if key % 2 and h >= 12 and w >= 12:
                    image[50 + int(h * 0.35) : 50 + int(h * 0.45), 50 + w // 4 : 50 + w // 4 + 3, :3] = 60
                    image[50 + int(h * 0.35) : 50 + int(h * 0.45), 50 + w - w // 4 - 3 : 50 + w - w // 4, :3] = 60
                ok, why, sure = raster.face(image, 50, 50, w, h)
                soft = raster.blurred(image, 50, 50, w, h, 3, 2) if ok else image
                out.append((key, ok, why, sure, float(raster.luminance(soft)[50 : 50 + h, 50 : 50 + w].std())))
            names, kinds = ["row_id", "face", "path", "confidence", "spread_after"], [pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    e = elements(spark, d).where("tag = 'img' and w > 0 and h > 0").select("row_id", "w", "h")
    return e.mapInArrow(run, "row_id long, face boolean, path string, confidence double, spread_after double")


def _redacted(spark, d):
    """Each page's screenshot with its face candidates covered, written as PNG and read back.

    inside: whether all that lies in a box is covered; outside: whether all else is as it was.
    """
    from pagelens.plans.gate import _faces as candidates

    boxes = candidates(spark, d).groupBy("page").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, image, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before = png.decode(image)
                mask = raster.mask_of([(b["x"] / SCALE, b["y"] / SCALE, b["w"] / SCALE, b["h"] / SCALE) for b in listed], *before.shape[:2])
                after = png.decode(png.encode(raster.covered(before, mask)))
                rows.append((page, len(listed), bool((after[mask] == raster.COVER).all()), bool((after[~mask] == before[~mask]).all())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], ["page", "boxes", "inside", "outside"])

    return screenshots(spark, d).join(boxes, "page").select("page", "image", "b").mapInArrow(run, "page string, boxes long, inside boolean, outside boolean")


def _region_checks(spark, d):
    """What no region may be: out of the image, of a class or confidence that isn't one, or one of more than 100."""
    r = _regions(spark, d)
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") <= 0) | (F.col("h") <= 0) | (F.col("x") + F.col("w") > WIDTH) | (F.col("y") + F.col("h") > HEIGHT)
    per = r.groupBy("page").agg(F.count("*").alias("n"), F.count_if(out).alias("out"), F.count_if(~F.col("confidence").between(0.4, 0.96)).alias("unsure"), F.count_if(~F.col("class").endswith("region")).alias("unknown"))
    return per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("out", "unsure", "unknown")], F.count_if(F.col("n") > 100).alias("many"))


def _markup(spark, d):
    t = table(spark, d, "documents").where(F.col("text").rlike("<[A-Za-z]"))  # without this there is no tag to parse
    return markup.elements(t, "doc_id", "text").select(F.col("key").alias("doc_id"), "ord", "parent", "depth", "tag", "path", "text")


def _paragraphs(spark, d):
    return _markup(spark, d).where("tag in ('p', 'div', 'br')").groupBy("tag").agg(F.count("*").alias("n"))


QUERIES = {
    "png_headers": _headers,
    "raster_regions": _regions,
    "region_classify": _classify,
    "skin_pixel_mask": _skin,
    "raster_faces_blur": _faces,
    "raster_redacted": _redacted,
    "raster_region_checks": _region_checks,
    "dom_html_elements": _markup,
    "dom_html_tags": _paragraphs,
}

SQL = {
    # invariants: nothing left to see inside, nothing changed outside; no region that can't be one
    "raster_region_checks": "SELECT CAST(0 AS BIGINT) AS out, CAST(0 AS BIGINT) AS unsure, CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS many",
    "png_headers": "SELECT DISTINCT perception_cycle_id AS page, 480 AS width, 270 AS height FROM dom_elements WHERE bounds.width > 0 AND bounds.height > 0",
    "region_classify": """
WITH e AS (SELECT row_id, bounds.width AS w, bounds.height AS h, floor(bounds.width / bounds.height::DOUBLE * 100 + 0.5) / 100 AS a, floor(bounds.width / 1920::DOUBLE * 1000 + 0.5) / 1000 AS rw, floor(bounds.height / 1080::DOUBLE * 1000 + 0.5) / 1000 AS rh,
  row_id % 50 / 100.0::DOUBLE AS edge, row_id % 70 / 100.0::DOUBLE AS v, row_id % 41 AS chroma, row_id % 90 / 100.0::DOUBLE AS s, row_id % 100 / 100.0::DOUBLE AS r FROM dom_elements WHERE bounds.width > 0 AND bounds.height > 0),
c AS (SELECT *, CASE WHEN rw > 0.32 AND rh > 0.14 THEN 'container-like-region' WHEN w BETWEEN 120 AND 700 AND h BETWEEN 90 AND 650 AND a BETWEEN 0.4 AND 2.8 AND rw <= 0.65 THEN 'card-like-region'
  WHEN a BETWEEN 1 AND 6 AND h BETWEEN 18 AND 72 AND w BETWEEN 32 AND 340 THEN 'button-like-region' WHEN a BETWEEN 0.65 AND 1.5 AND w BETWEEN 14 AND 52 AND h BETWEEN 14 AND 52 THEN 'icon-button-like-region'
  WHEN a BETWEEN 0.6 AND 2.4 AND w BETWEEN 10 AND 36 AND h BETWEEN 10 AND 28 AND (chroma > 20 OR v > 0.3 OR edge > 0.25) THEN 'badge-like-region' WHEN a BETWEEN 2.5 AND 18 AND h BETWEEN 20 AND 72 AND v <= 0.38 THEN 'input-like-region'
  WHEN a >= 1.8 AND h BETWEEN 8 AND 34 AND edge >= 0.14 THEN 'text-like-region' WHEN (chroma > 30 OR v > 0.42) AND w >= 28 AND h >= 28 THEN 'image-like-region' ELSE 'region' END AS class FROM e)
SELECT row_id, class, floor(greatest(0.4::DOUBLE, least(0.96::DOUBLE, s * 0.26::DOUBLE + r * 0.22::DOUBLE + 0.48::DOUBLE + CASE WHEN class IN ('button-like-region', 'icon-button-like-region') THEN 0.04::DOUBLE WHEN class = 'input-like-region' THEN (1 - v) * 0.04::DOUBLE ELSE 0::DOUBLE END)) * 100 + 0.5) / 100 AS confidence FROM c""",
    "skin_pixel_mask": """
WITH p AS (SELECT row_id, (bounds.x * 3 + row_id) % 256 AS r, (bounds.y * 5 + row_id * 2) % 256 AS g, (bounds.width * 7 + row_id * 3) % 256 AS b FROM dom_elements WHERE bounds.x IS NOT NULL)
SELECT row_id, (r > 80 AND g > 30 AND b > 10 AND greatest(r, g, b) - least(r, g, b) > 10 AND abs(r - g) > 10 AND r > g AND r > b) OR (r > 200 AND g > 190 AND b > 145 AND abs(r - g) <= 20 AND r > b AND g > b)
  OR (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE > 25 AND 128 - r * 0.168736::DOUBLE - g * 0.331264::DOUBLE + b * 0.5::DOUBLE BETWEEN 70 AND 145 AND 128 + r * 0.5::DOUBLE - g * 0.418688::DOUBLE - b * 0.081312::DOUBLE BETWEEN 125 AND 188) AS skin FROM p""",
    "dom_html_tags": r"""
WITH m AS (SELECT lower(unnest(regexp_extract_all(text, '(?i)<(p|div|br)[\s/>]', 1))) AS tag FROM documents)
SELECT tag, count(*) AS n FROM m GROUP BY 1""",
}
