"""Screenshots: regions by gradients and components, their classes, skin, faces and blur.

The planes are numpy arrays inside Arrow batches, one image at a time; everything that
can be said of a region's figures is a column expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.columns import fixed

# Thresholds of the region search.
LEAST_EDGE, MOST_EDGE, SPREAD = 6.0, 38.0, 0.35
X_GAP, Y_GAP, MOST_RATIO, APART = 8, 6, 4.0, 1.6
MOST_REGIONS = 100


def luminance(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def gradient(lum: np.ndarray) -> np.ndarray:
    """The larger of the 1- and 2-pixel central differences; 0 on a border of two."""
    out = np.zeros_like(lum)
    if min(lum.shape) < 5:
        return out
    c = lum
    near = np.hypot(c[2:-2, 3:-1] - c[2:-2, 1:-3], c[3:-1, 2:-2] - c[1:-3, 2:-2])
    wide = np.hypot((c[2:-2, 4:] - c[2:-2, :-4]) * 0.5, (c[4:, 2:-2] - c[:-4, 2:-2]) * 0.5)
    out[2:-2, 2:-2] = np.maximum(near, wide)
    return out


def threshold(grad: np.ndarray) -> float:
    inner = grad[2:-2, 2:-2]
    return float(np.clip(inner.mean() + SPREAD * inner.std(), LEAST_EDGE, MOST_EDGE)) if inner.size else LEAST_EDGE


def labelled(mask: np.ndarray, corners: bool = True) -> tuple[np.ndarray, int]:
    """Components of a mask, numbered in scan order from 1: runs of rows joined by union-find."""
    h, w = mask.shape
    labels = np.zeros((h, w), np.int32)
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if corners else 0
    before: list[tuple[int, int, int]] = []
    runs: list[tuple[int, int, int, int]] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        now = []
        k = 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            me = len(parent)
            parent.append(me)
            while k < len(before) and before[k][1] + reach <= a:
                k += 1
            j = k
            while j < len(before) and before[j][0] < b + reach:
                r, s = root(before[j][2]), root(me)
                parent[max(r, s)] = min(r, s)
                j += 1
            now.append((a, b, me))
            runs.append((y, a, b, me))
        before = now
    number: dict[int, int] = {}
    for y, a, b, me in runs:
        labels[y, a:b] = number.setdefault(root(me), len(number) + 1)
    return labels, len(number)


def merged(parts: list[dict]) -> list[dict]:
    """Fragments joined to regions: close, of comparable size, and neither inside the other.

    In order, and again while something joined; a region's box grows as it goes.
    """
    if not parts:
        return []
    box = np.array([(p["x0"], p["x1"], p["y0"], p["y1"]) for p in parts], np.int64)
    open_ = np.ones(len(parts), bool)
    out = []
    for i in range(len(parts)):
        if not open_[i]:
            continue
        open_[i] = False
        b, at, start, grew = dict(parts[i]), box[i].copy(), 0, False
        while True:
            rest = np.flatnonzero(open_[start:]) + start
            near = rest[_joins(at, box[rest])] if len(rest) else rest
            if len(near):  # the first in order; the box has grown for those after it
                j = int(near[0])
                open_[j] = False
                at = np.array([min(at[0], box[j, 0]), max(at[1], box[j, 1]), min(at[2], box[j, 2]), max(at[3], box[j, 3])])
                for k in ("n", "lum", "lum2", "chroma", "grad"):
                    b[k] += parts[j][k]
                start, grew = j + 1, True
            elif grew:
                start, grew = 0, False
            else:
                break
        b |= dict(zip(("x0", "x1", "y0", "y1"), map(int, at), strict=True))
        out.append(b)
    return out


def _joins(b: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Which of the boxes o (x0, x1, y0, y1 each) join the box b."""
    area_b, area_o = (b[1] - b[0] + 1) * (b[3] - b[2] + 1), (o[:, 1] - o[:, 0] + 1) * (o[:, 3] - o[:, 2] + 1)
    ratio = np.maximum(area_b, area_o) / (np.minimum(area_b, area_o) + 1)
    holds = (b[0] <= o[:, 0]) & (b[1] >= o[:, 1]) & (b[2] <= o[:, 2]) & (b[3] >= o[:, 3])
    held = (b[0] >= o[:, 0]) & (b[1] <= o[:, 1]) & (b[2] >= o[:, 2]) & (b[3] <= o[:, 3])
    across, down = np.minimum(b[1], o[:, 1]) - np.maximum(b[0], o[:, 0]), np.minimum(b[3], o[:, 3]) - np.maximum(b[2], o[:, 2])
    close = ((-across <= X_GAP) & (down > 4)) | ((-down <= Y_GAP) & (across > 6))
    return close & (ratio <= MOST_RATIO) & ~((ratio > APART) & (holds | held))


def regions(pixels: np.ndarray, width: int | None = None, height: int | None = None) -> list[tuple]:
    """(ord, x, y, w, h, edge, variance, chroma, rect, strength) of the regions of an image.

    Boxes are in the original's pixels (width, height). A component keeps all its pixels,
    however many. At most 100 regions in scan order; blank images have none.
    """
    h, w = pixels.shape[:2]
    lum, rgb = luminance(pixels), pixels[..., :3].astype(np.float64)
    chroma, grad = rgb.max(axis=2) - rgb.min(axis=2), gradient(lum)
    limit = threshold(grad)
    labels, n = labelled(grad >= limit)
    if not n:
        return []
    flat = labels.ravel()
    ys, xs = np.nonzero(labels)
    of = flat[ys * w + xs]
    sums = {k: np.bincount(flat, v.ravel(), n + 1) for k, v in (("n", np.ones_like(lum)), ("lum", lum), ("lum2", lum**2), ("chroma", chroma), ("grad", grad))}
    low = lambda v: np.minimum.reduceat(v[order], cuts)
    high = lambda v: np.maximum.reduceat(v[order], cuts)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0])
    x0, x1, y0, y1 = low(xs), high(xs), low(ys), high(ys)
    parts = [{"x0": int(x0[i]), "x1": int(x1[i]), "y0": int(y0[i]), "y1": int(y1[i]), **{k: float(v[i + 1]) for k, v in sums.items()}} for i in range(n) if x1[i] - x0[i] >= 2 and y1[i] - y0[i] >= 2]
    full_w, full_h = width or w, height or h
    sx, sy = full_w / w, full_h / h
    half_up = lambda v: int(np.floor(v + 0.5))
    cut2 = lambda v: np.floor(v * 100 + 0.5) / 100
    out = []
    for b in merged(parts):
        bw, bh = b["x1"] - b["x0"] + 1, b["y1"] - b["y0"] + 1
        x, y = min(max(0, half_up(b["x0"] * sx)), full_w - 1), min(max(0, half_up(b["y0"] * sy)), full_h - 1)
        rw, rh = max(4, min(half_up(bw * sx), full_w - x)), max(4, min(half_up(bh * sy), full_h - y))
        if rw * rh < 64 or (rw >= full_w * 0.98 and rh >= full_h * 0.98):
            continue
        mean = b["lum"] / b["n"]
        spread = np.sqrt(max(0.0, b["lum2"] / b["n"] - mean * mean))
        out.append((len(out), x, y, rw, rh, float(cut2(min(1.0, b["n"] / (bw * bh)))), float(cut2(min(1.0, spread / 128))), float(b["chroma"] / b["n"]), float(cut2(min(1.0, b["n"] * sx * sy / (rw * rh * 0.35 + 1)))), float(min(1.0, b["grad"] / (b["n"] + 1) / (limit * 2.2)))))
        if len(out) == MOST_REGIONS:
            break
    return out


def region_class(w: Column, h: Column, width: Column | int, height: Column | int, edge: Column, variance: Column, chroma: Column) -> Column:
    """The first class whose rule holds; ratios are rounded before the rules."""
    ratio, rel_w, rel_h = fixed(w / h, 2), fixed(w / width, 3), fixed(h / height, 3)
    return (
        F.when((rel_w > 0.32) & (rel_h > 0.14), "container-like-region")
        .when(w.between(120, 700) & h.between(90, 650) & ratio.between(0.4, 2.8) & (rel_w <= 0.65), "card-like-region")
        .when(ratio.between(1.0, 6.0) & h.between(18, 72) & w.between(32, 340), "button-like-region")
        .when(ratio.between(0.65, 1.5) & w.between(14, 52) & h.between(14, 52), "icon-button-like-region")
        .when(ratio.between(0.6, 2.4) & w.between(10, 36) & h.between(10, 28) & ((chroma > 20) | (variance > 0.3) | (edge > 0.25)), "badge-like-region")
        .when(ratio.between(2.5, 18.0) & h.between(20, 72) & (variance <= 0.38), "input-like-region")
        .when((ratio >= 1.8) & h.between(8, 34) & (edge >= 0.14), "text-like-region")
        .when(((chroma > 30) | (variance > 0.42)) & (w >= 28) & (h >= 28), "image-like-region")
        .otherwise("region")
    )


def region_confidence(kind: Column, strength: Column, rect: Column, variance: Column) -> Column:
    """0.48 + 0.26 edge + 0.22 shape, with small additions, between 0.40 and 0.96."""
    bonus = F.when(kind.isin("button-like-region", "icon-button-like-region"), 0.04).when(kind == "input-like-region", (1 - variance) * 0.04).otherwise(0.0)
    return fixed(F.greatest(F.lit(0.4), F.least(F.lit(0.96), strength * 0.26 + rect * 0.22 + 0.48 + bonus)), 2)


def is_skin(r: Column, g: Column, b: Column) -> Column:
    """Skin by even or side light in RGB, or by chrominance."""
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    even = (r > 80) & (g > 30) & (b > 10) & (spread > 10) & (F.abs(r - g) > 10) & (r > g) & (r > b)
    side = (r > 200) & (g > 190) & (b > 145) & (F.abs(r - g) <= 20) & (r > b) & (g > b)
    y = r * 0.299 + g * 0.587 + b * 0.114
    cb = F.lit(128) - r * 0.168736 - g * 0.331264 + b * 0.5
    cr = F.lit(128) + r * 0.5 - g * 0.418688 - b * 0.081312
    return even | side | ((y > 25) & cb.between(70, 145) & cr.between(125, 188))


def skin_mask(pixels: np.ndarray) -> np.ndarray:
    r, g, b = (pixels[..., i].astype(np.float64) for i in range(3))
    spread = np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
    even = (r > 80) & (g > 30) & (b > 10) & (spread > 10) & (abs(r - g) > 10) & (r > g) & (r > b)
    side = (r > 200) & (g > 190) & (b > 145) & (abs(r - g) <= 20) & (r > b) & (g > b)
    cb, cr = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    return even | side | ((luminance(pixels) > 25) & (cb >= 70) & (cb <= 145) & (cr >= 125) & (cr <= 188))


def face(pixels: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[bool, str, float]:
    """(is a face, path or reason, confidence) of a box: rejections in order, then three tiers."""
    full_h, full_w = pixels.shape[:2]
    cover = w * h / max(1, full_w * full_h)
    for bad, reason in ((w < 10 or h < 10, "too_small"), (cover >= 0.45, "suspiciously_large_coverage_ratio"), (w > full_w * 0.5 or h > full_h * 0.5, "dimensions_exceed_face_limit"), (not 0.3 <= w / max(h, 1) <= 3.2, "aspect_ratio_out_of_range")):
        if bad:
            return False, reason, 0.0
    part = pixels[y : y + h, x : x + w]
    if part.shape[:2] != (h, w):
        return False, "outside_image", 0.0
    lum, skin = luminance(part), float(skin_mask(part).mean())
    std = float(lum.std())
    if skin < 0.16:
        return False, "insufficient_skin", 0.0
    if std < 4 and skin > 0.93:
        return False, "flat_inanimate_surface", 0.0
    half = lambda v: int(np.floor(v + 0.5))
    brow = max(2, half(h * 0.25))
    eyes = slice(brow, max(brow + 2, half(h * 0.55)))
    mid, side = half(w / 2), max(1, half(w * 0.15))
    top = lum[:brow, 2 : w - 2]
    bright = float(top.mean()) if top.size else float(lum.mean())
    left, right, nose = lum[eyes, side : mid - 1], lum[eyes, mid + 2 : w - side], lum[eyes, mid - 1 : mid + 2]
    drop = [bright - float(v.min()) if v.size else -np.inf for v in (left, right)]
    ridge = min(float(nose.max()) - float(v.min()) if v.size and nose.size else -np.inf for v in (left, right))
    cavities = drop[0] >= 4 and drop[1] >= 4 and ridge >= 2
    a, b = lum[:, :mid], lum[:, ::-1][:, :mid]
    total = float((a + b).sum())
    symmetry = 1 - float(abs(a - b).sum()) / total if total > 0 else 0.0
    two = lambda v, lo, hi: float(np.floor(min(hi, max(lo, v)) * 100 + 0.5) / 100)
    if cavities and symmetry >= 0.5:
        return True, "strict_biometric", two(0.15 + min(0.35, sum(drop) / 40 * 0.35) + min(0.3, symmetry * 0.3) + min(0.25, skin * 0.25), 0.55, 0.97)
    if skin >= 0.26 and std >= 5 and max(drop) >= 2:
        return True, "fallback_skin_texture", two(0.2 + min(0.3, skin * 0.3) + min(0.2, std / 60 * 0.2), 0.45, 0.85)
    if std >= 3 and cover < 0.2 and w <= 450 and h <= 450:
        return True, "skin_only_low_bar", two(0.2 + skin * 0.25, 0.35, 0.55)
    return False, "insufficient_bilateral_symmetry" if cavities else "missing_bilateral_eye_cavities", 0.0


def blurred(pixels: np.ndarray, x: int, y: int, w: int, h: int, radius: int, passes: int = 5) -> np.ndarray:
    """The image with a box blurred: separable means over 2r + 1 pixels, edges repeated."""
    out = pixels.copy()
    part = out[y : y + h, x : x + w].astype(np.float64)
    if not part.size:
        return out
    size = 2 * radius + 1
    for _ in range(passes):
        for axis in (1, 0):
            wide = np.pad(part, [(radius + 1, radius) if i == axis else (0, 0) for i in range(3)], mode="edge")
            total = np.cumsum(wide, axis=axis)
            n = part.shape[axis]
            take = lambda lo, t=total, a=axis, k=n: np.take(t, np.arange(lo, lo + k), axis=a)
            part = np.floor((take(size) - take(0)) / size)
    out[y : y + h, x : x + w] = part.astype(np.uint8)
    return out


#: The colour that covers what is redacted.
COVER = (17, 24, 39, 255)


def mask_of(boxes: list[tuple[float, float, float, float]], height: int, width: int) -> np.ndarray:
    """Which pixels any of the boxes (x, y, w, h) touches; parts beyond the image are cut."""
    mask = np.zeros((height, width), bool)
    for x, y, w, h in boxes:
        if w > 0 and h > 0:
            mask[max(0, int(np.floor(y))) : max(0, int(np.ceil(y + h))), max(0, int(np.floor(x))) : max(0, int(np.ceil(x + w)))] = True
    return mask


def covered(pixels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The image with everything under the mask in one colour."""
    out = pixels.copy()
    out[mask] = COVER
    return out
